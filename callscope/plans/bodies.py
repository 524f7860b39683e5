"""Queries over bodies as trees, GraphQL arguments and whole shell scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators import frontend, graphql, shapes, shell
from callscope.plans.fixture import Fixture, golden
from callscope.plans.registry import query

GRAPHQL = Fixture(
    "graphql_arguments",
    "path string, body string",
    [
        ("a", 'query Recent($c: String) { plants(first: 20, after: $c, key: CREATED, on: true, filter: { tags: ["f", "m"], price: { lt: 9.5 }, owner: null }) { nodes { id photos(size: 64) { url } } } }'),
        ("b", 'query Card { plant(id: "{id}") { name small: photo(size: 64) { url } large: photo(size: 512) { url } photo { url } } }'),
        ("c", 'mutation In { signIn(email: "g@example.com", password: "hunter2", device: { apiKey: "k-1" }) { id } }'),
        ("d", '{ invite(code: "d41d8cd98f00b204e9800998ecf8427e") { id } ...F } fragment F on Q { extra(n: 1) }'),
        ("e", "query Names { plants { name } }"),
        ("f", "query {"),
    ],
)


@query(
    "opn03_arguments",
    golden(
        "path, type, name, arguments, problem",
        [
            ("a", "query", "Recent", '{"plants":{"first":20,"after":"$c","key":"CREATED","on":true,"filter":{"tags":["f","m"],"price":{"lt":9.5},"owner":null}},"plants.nodes.photos":{"size":64}}', None),
            ("b", "query", "Card", '{"plant":{"id":"{id}"},"plant.photo":[{"size":64},{"size":512},{}]}', None),
            ("c", "mutation", "In", '{"signIn":{"email":"g@example.com","password":"<redacted>","device":{"apiKey":"<redacted>"}}}', None),
            ("d", "query", "invite", '{"invite":{"code":"<redacted>"},"extra":{"n":1}}', None),
            ("e", "query", "Names", None, None),
            ("f", None, None, None, "not-graphql"),
        ],
    ),
)
def opn03_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontend.scan_files(GRAPHQL.df(spark), graphql.operation_arguments, "type string, name string, arguments string, problem string")


BODIES = Fixture(
    "bodies",
    "id bigint, encoding string, body string",
    [
        (1, "json", '{"a": 1, "b": [{"c": "x"}, {"c": null, "d": true}], "e": 2.5}'), (2, "form", "q=a+b&n={x}&flag&=1"), (3, "xml", '<?xml version="1.0"?><s:Envelope xmlns:s="u"><s:Body><Track id="7"><No>{no}</No><Kind>fast</Kind></Track></s:Body></s:Envelope>'),
        (4, None, "<html><p>x</p></html>"), (5, "json", "{broken"), (6, None, "k=v&l=w"), (7, "xml", "<!DOCTYPE a><a/>"), (8, "json", '{"x":{"x":{"x":{"x":{"x":{"x":{"x":{"x":1}}}}}}}}'), (9, None, None),
    ],
)


@query(
    "res18_body_nodes",
    golden(
        "id, path, kind, value",
        [
            (1, "$", "object", None), (1, "$.a", "integer", "1"), (1, "$.b", "array", None), (1, "$.b[]", "object", None), (1, "$.b[].c", "string", "x"), (1, "$.b[].c", "null", None), (1, "$.b[].d", "boolean", "true"), (1, "$.e", "number", "2.5"),
            (2, "$", "object", None), (2, "$.q", "string", "a b"), (2, "$.n", "string", None), (2, "$.flag", "string", None),
            (3, "$.Envelope", "xml", None), (3, "$.Envelope.Body", "xml", None), (3, "$.Envelope.Body.Track", "xml", None), (3, "$.Envelope.Body.Track.@id", "string", "7"), (3, "$.Envelope.Body.Track.No", "xml", None), (3, "$.Envelope.Body.Track.Kind", "xml", "fast"),
            (4, "$", "string", "<html><p>x</p></html>"), (5, "$", "unknown", None), (6, "$", "object", None), (6, "$.k", "string", "v"), (6, "$.l", "string", "w"), (7, "$", "unknown", None),
            (8, "$", "object", None), (8, "$.x", "object", None), (8, "$.x.x", "object", None), (8, "$.x.x.x", "object", None), (8, "$.x.x.x.x", "object", None), (8, "$.x.x.x.x.x", "object", None), (8, "$.x.x.x.x.x.x", "object", None), (8, "$.x.x.x.x.x.x.x", "unknown", None),
        ],
    ),
)
def res18_body_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of three encodings as trees in a table."""
    return shapes.body_nodes(BODIES.df(spark))


@query("res21_event_props", "SELECT event_id, '$.k' AS path, 'integer' AS kind, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, '$', 'object', NULL FROM events")
def res21_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of all events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.lit("json").alias("encoding"), F.col("props").alias("body"))
    return shapes.body_nodes(rows, "event_id")


NODES = Fixture(
    "shape_nodes", "id bigint, alt int, path string, kind string, value string",
    [(1, 0, "$", "object", None), (1, 0, "$.a", "string", "x"), (1, 0, "$.b", "integer", "1"), (1, 1, "$", "object", None), (1, 1, "$.a", "string", "y"), (1, 1, "$.c", "null", None), (1, 1, "$.b", "string", None), (2, 0, "$", "array", None), (2, 0, "$[]", "null", None)],
)


@query(
    "res20_union",
    f"WITH {NODES.sql}, n AS (SELECT id, count(DISTINCT alt) AS n FROM shape_nodes GROUP BY id) SELECT s.id, path, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (kind <> 'null'), '') AS kinds, bool_or(kind = 'null') AS nullable, "
    "CASE WHEN bool_and(value IS NOT NULL OR kind = 'null') THEN string_agg(DISTINCT value, ',' ORDER BY value) END AS enum, count(DISTINCT alt) = any_value(n.n) AS required FROM shape_nodes s JOIN n ON s.id = n.id GROUP BY s.id, path",
)
def res20_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.union(NODES.df(spark)).withColumns({"kinds": F.array_join("kinds", ","), "enum": F.array_join("enum", ",")})


OMITTED = Fixture("omitted", "id bigint, name string", [(1, "a"), (2, "none")])


@query("res20_wrap_omit", f"WITH {NODES.sql} SELECT id, alt, '$.in' || substr(path, 2) AS path, kind, value FROM shape_nodes WHERE NOT (id = 1 AND path = '$.a') UNION ALL SELECT id, alt, '$', 'object', NULL FROM shape_nodes WHERE path = '$'")
def res20_wrap_omit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.wrap(shapes.omit(NODES.df(spark), OMITTED.df(spark)), F.lit("in"))


SCRIPTS = Fixture(
    "shell_files",
    "path string, body string",
    [
        (
            "bin/run.sh",
            "#!/bin/bash\nsource ./lib.sh\nREPO=\"acme/widgets\"\n# curl https://no.io\napi() {\n  local path=\"$1\"\n  shift\n  curl -sSf \\\n    -H \"Authorization: Bearer ${T}\" \"https://api.github.com/${path}\" \"$@\"\n}\nlatest=$(api \"repos/${REPO}/latest\" | jq -r .tag)\napi \"repos/${REPO}/issues\" -X POST -d '{\"title\": \"x\"}'\n"
            'request() {\n  case "$1" in\n    get) curl "$BASE/$2" ;;\n    post) curl -X POST "$BASE/$2" ;;\n    *) wget "$BASE/other" ;;\n  esac\n}\nrequest post items\nrequest list\nif [ "$REPO" = "none" ]; then\n  curl https://never.io\nelse\n  curl -I https://always.io\nfi\ncat <<EOF\ncurl https://text.io\nEOF\nhttp POST "$BASE/h" a=1\n',
        ),
        ("bin/lib.sh", "BASE=https://api.acme.io\nhelper() { curl \"$BASE/helper/$1\"; }\n"),
        ("bin/use.sh", ". lib.sh\nhelper 7\ncurl ${HOST:-https://dflt.io}/x\n"),
    ],
)


@query(
    "low08_shell_scripts",
    golden(
        "path, line, client, method, url, headers, body_keys",
        [
            ("bin/run.sh", 8, "curl", "GET", "https://api.github.com/{1}", "authorization", ""), ("bin/run.sh", 11, "curl", "GET", "https://api.github.com/repos/acme/widgets/latest", "authorization", ""), ("bin/run.sh", 12, "curl", "POST", "https://api.github.com/repos/acme/widgets/issues", "authorization", "title"),
            ("bin/run.sh", 15, "curl", "GET", "https://api.acme.io/{2}", "", ""), ("bin/run.sh", 16, "curl", "POST", "https://api.acme.io/{2}", "", ""), ("bin/run.sh", 17, "wget", "GET", "https://api.acme.io/other", "", ""),
            ("bin/run.sh", 20, "curl", "POST", "https://api.acme.io/items", "", ""), ("bin/run.sh", 21, "wget", "GET", "https://api.acme.io/other", "", ""), ("bin/run.sh", 25, "curl", "HEAD", "https://always.io", "", ""), ("bin/run.sh", 30, "httpie", "POST", "https://api.acme.io/h", "", "a"),
            ("bin/lib.sh", 2, "curl", "GET", "https://api.acme.io/helper/{1}", "", ""), ("bin/use.sh", 2, "curl", "GET", "https://api.acme.io/helper/7", "", ""), ("bin/use.sh", 3, "curl", "GET", "https://dflt.io/x", "", ""),
        ],
    ),
)
def low08_shell_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions at their own lines and at their calls, branches by the call's argument, sourced files."""
    return shell.shell_calls(SCRIPTS.df(spark))


@query("det17_branches", golden("line, client, method, url", [(20, "curl", "POST", "https://api.acme.io/items"), (21, "wget", "GET", "https://api.acme.io/other"), (25, "curl", "HEAD", "https://always.io")]))
def det17_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a wrapper reach the branch that their argument takes; a test that holds never runs the other side."""
    found = shell.shell_calls(SCRIPTS.df(spark).filter("path <> 'bin/use.sh'"))
    return found.filter("path = 'bin/run.sh' and line between 20 and 25").select("line", "client", "method", "url")
