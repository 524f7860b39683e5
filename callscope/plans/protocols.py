"""Queries over source text and protocol operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.functions import fixed, text, urls
from callscope.operators import facts, frontend, operations
from callscope.plans.calls import line_order
from callscope.plans.fixture import Fixture, golden
from callscope.plans.registry import query

PYTHON = Fixture(
    "py",
    "path string, body string",
    [
        (
            "app/client.py",
            'import os\nimport requests as rq\nfrom httpx import post\nBASE = os.getenv("API_URL", "https://x.io")\ndef load(user):\n    url = f"{BASE}/users/{user.id}"\n    return rq.get(url, headers={"X-Key": "1"})\ndef save(d):\n    post("https://api.acme.com/v1/items", json={"name": d, "n": 1})\n    rq.request("delete", "https://api.acme.com/v1/%s" % d)\n    rq.request(d, url="https://api.acme.com/" + "v2")\nprint("requests.get")\n',
        ),
        ("app/bad.py", "def (:\n"),
        ("app/none.py", "import json\njson.loads('{}')\n"),
    ],
)
_CALL = "line long, client string, method string, url string, headers string, body_keys string, problem string"


@query(
    "low02_python_calls",
    golden(
        "path, line, client, method, url, headers, body_keys, problem",
        [
            ("app/client.py", 7, "requests", "GET", "{env:API_URL}/users/{id}", "x-key", "", None),
            ("app/client.py", 9, "httpx", "POST", "https://api.acme.com/v1/items", "", "name,n", None),
            ("app/client.py", 10, "requests", "DELETE", "https://api.acme.com/v1/{d}", "", "", None),
            ("app/client.py", 11, "requests", "DYNAMIC", "https://api.acme.com/v2", "", "", None),
            ("app/bad.py", 1, None, None, None, None, None, "syntax-error"),
        ],
    ),
)
def low02_python_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontend.scan_files(PYTHON.df(spark), frontend.python_calls, _CALL)


@query(
    "out01_assembled_calls",
    golden("path, line, method, host_kind, host, url_path, provider", [("app/client.py", 7, "GET", "env", None, "/users/{id}", "env:API_URL"), ("app/client.py", 9, "POST", "literal", "api.acme.com", "/v1/items", "api.acme.com"), ("app/client.py", 10, "DELETE", "literal", "api.acme.com", "/v1/{d}", "api.acme.com"), ("app/client.py", 11, "DYNAMIC", "literal", "api.acme.com", "/v2", "api.acme.com")]),
)
def out01_assembled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text to call rows: front end, URL shape, provider."""
    from callscope.operators import providers

    found = frontend.scan_files(PYTHON.df(spark), frontend.python_calls, _CALL).filter("problem is null")
    shaped = urls.with_shape(found, F.col("url"), F.lit(False))
    rows = shaped.select(F.col("path"), "line", "method", "u.host_kind", "u.host", "u.env_name", F.col("u.path").alias("url_path"), F.lit(None).cast("string").alias("sdk_provider"))
    none = spark.createDataFrame([], "name string, provider string")
    return providers.resolve(rows, providers.provider_hosts(spark), none).select("path", "line", "method", "host_kind", "host", "url_path", "provider")


SHELL = Fixture(
    "sh",
    "path string, body string",
    [
        (
            "a.sh",
            'curl -s https://api.github.com/repos\ncurl -X POST "https://api.acme.com/v1" -H "Authorization: Bearer $TOKEN" \\\n  -d \'{"a": 1, "b": 2}\'\ncurl -G api.acme.com/search -d state=open -d per_page=5\n# curl https://no.io\ncurl -I "$BASE/health" | jq .\nwget --post-data "x=1&y=2" https://w.io/p',
        )
    ],
)


@query(
    "det14_shell_commands",
    golden(
        "path, line, client, method, url, headers, body_keys, problem",
        [
            ("a.sh", 1, "curl", "GET", "https://api.github.com/repos", "", "", None), ("a.sh", 2, "curl", "POST", "https://api.acme.com/v1", "authorization", "a,b", None),
            ("a.sh", 4, "curl", "GET", "http://api.acme.com/search?state=open&per_page=5", "", "", None), ("a.sh", 6, "curl", "HEAD", "{env:BASE}/health", "", "", None), ("a.sh", 7, "wget", "POST", "https://w.io/p", "", "x,y", None),
        ],
    ),
)
def det14_shell_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontend.scan_files(SHELL.df(spark), frontend.shell_calls, _CALL)


DOCUMENTS = Fixture(
    "gql",
    "path string, body string",
    [
        ("a", "query Shop($id: ID!) { shop(id: $id) { name owner { ...P } } me: viewer { login } }\nfragment P on User { email, id }"),
        ("b", "{ shop { id } locations(first: 3) { edges { node { id } } } }"),
        ("c", "mutation M @live { save(input: {a: 1}) { ok } } # c"),
        ("d", "select * from t"),
    ],
)


@query(
    "opn03_graphql_documents",
    golden("path, type, name, fields, problem", [("a", "query", "Shop", "shop.name,shop.owner.email,shop.owner.id,viewer.login", None), ("b", "query", "locations,shop", "locations.edges.node.id,shop.id", None), ("c", "mutation", "M", "save.ok", None), ("d", None, None, None, "not-graphql")]),
)
def opn03_graphql_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontend.scan_files(DOCUMENTS.df(spark), frontend.graphql_operations, "type string, name string, fields string, problem string")


NOTEBOOKS = Fixture("nb", "path string, body string", [("a.ipynb", '{"cells": [{"cell_type": "code", "source": ["import requests\\n", "%time x\\n", "requests.get(u)"]}, {"cell_type": "markdown", "source": "t"}, {"cell_type": "code", "source": "!ls"}]}'), ("b.ipynb", "{")])


@query("src13_notebooks", golden("path, cell, text, problem", [("a.ipynb", 0, "import requests\n\nrequests.get(u)", None), ("a.ipynb", 2, "", None), ("b.ipynb", None, None, "not-a-notebook")]))
def src13_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontend.scan_files(NOTEBOOKS.df(spark), frontend.notebook_source, "cell long, text string, problem string")


BODIES = Fixture(
    "bodies",
    "id bigint, body string",
    [
        (1, '{"jsonrpc": "2.0", "method": "getBalance", "params": []}'),
        (2, '[{"jsonrpc": "2.0", "method": "getBalance"}, {"jsonrpc": "2.0", "method": "getSlot"}, {"jsonrpc": "2.0", "method": "getBalance"}]'),
        (3, '{"method": "sum", "params": [1], "id": 1}'),
        (4, '{"method": "POST", "params": {}, "id": 1}'),
        (5, '{"a": 1}'),
        (6, "not json"),
        (7, '{"jsonrpc": "2.0", "method": "tools/call", "params": {"name": "search"}, "id": 3}'),
    ],
)


@query("opn02_json_rpc", golden("id, name, batch, target", [(1, "getBalance", False, None), (2, "getBalance", True, None), (2, "getSlot", True, None), (3, "sum", False, None), (7, "tools/call", False, "search")]))
def opn02_json_rpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.json_rpc(BODIES.df(spark))


SOAP = Fixture(
    "soap",
    "id bigint, action string, content_type string, body string",
    [
        (1, "http://x/Track", None, None), (2, None, 'application/soap+xml; action="urn:Cancel"', None), (3, None, "text/xml", "<s:Envelope><s:Header/><s:Body><t:Ship a='1'><x/></t:Ship></s:Body></s:Envelope>"),
        (4, None, "application/json", "{}"), (5, "", "text/xml", "<Envelope><Body><Get/></Body></Envelope>"),
    ],
)


@query("opn06_soap", golden("id, name, origin", [(1, "Track", "header"), (2, "Cancel", "header"), (3, "Ship", "body"), (5, "Get", "body")]))
def opn06_soap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.soap(SOAP.df(spark))


ACTIONS = Fixture("acts", "id bigint, provider string, query string, form string", [(1, "aws", "Action=DescribeInstances&Version=1", ""), (2, "flickr", "", "method=flickr.photos.search&x=1"), (3, "stripe", "Action=No", ""), (4, "aws", "", "")])
ACTION_PARAMS = Fixture("params", "provider string, param string", [("aws", "Action"), ("flickr", "method")])


@query("opn07_action", golden("id, name, origin", [(1, "DescribeInstances", "query"), (2, "flickr.photos.search", "body")]))
def opn07_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.action(ACTIONS.df(spark), ACTION_PARAMS.df(spark))


TRANSPORTS = Fixture("tr", "id bigint, host_kind string, path string, named string", [(1, "literal", "/mcp", None), (2, "literal", "/v1/sse/x", None), (3, "literal", "/{p}", None), (4, "env", "/mcp", None), (5, "env", "/mcp", "streamableHttp"), (6, "const", "/sse", "nope")])


@query("opn08_mcp_transport", golden("id, kind", [(1, "streamable-http"), (2, "sse"), (3, None), (4, None), (5, "streamable-http"), (6, "sse")]))
def opn08_mcp_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in fixed.MCP_TRANSPORTS.items() for x in pair])
    by_path = F.when(~F.col("host_kind").isin("literal", "const"), None).when(F.col("path").rlike(r"/sse(?:/|\z)"), "sse").when(~F.col("path").contains("{"), "streamable-http")
    return TRANSPORTS.df(spark).select("id", F.coalesce(F.try_element_at(kinds, F.col("named")), by_path).alias("kind"))


CARDS = Fixture("cards", "id bigint, name string, path string", [(1, "GetAgentCard", "/a2a/"), (2, "GetAgentCard", "/x/card.json"), (3, "SendMessage", "/a/.well-known/agent-card.json"), (4, "SendMessage", "/a2a"), (5, "SendMessage", "/.well-known/agent.json")])


@query("opn09_a2a_path", golden("id, method, path", [(1, "GET", "/a2a/.well-known/agent-card.json"), (2, "GET", "/x/card.json"), (3, "POST", "/a"), (4, "POST", "/a2a"), (5, "POST", "/")]))
def opn09_a2a_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = F.col("name") == "GetAgentCard"
    without = F.regexp_replace("path", r"/\.well-known/agent(?:-card)?\.json\z", "")
    fetch = F.when(F.col("path").endswith(".json"), F.col("path")).otherwise(F.concat(F.regexp_replace("path", r"/\z", ""), F.lit("/.well-known/agent-card.json")))
    return CARDS.df(spark).select("id", F.when(card, "GET").otherwise("POST").alias("method"), F.when(card, fetch).otherwise(F.when(without == "", "/").otherwise(without)).alias("path"))


HEADERS = Fixture("hd", "call bigint, ord int, name string, value string", [(1, 0, "Authorization", "Bearer {token}"), (1, 1, "Accept", "application/json"), (1, 2, "accept", "text/plain"), (2, 0, "X-Api-Key", "abc"), (3, 0, "Content-Type", "text/xml"), (3, 1, "X-Sig", "0123456789abcdef0123456789abcdef"), (4, 0, "Authorization", "token {t}")])


@query("res15_headers", golden("call, names, shown, auth", [(1, "authorization,accept", "accept=text/plain", "bearer"), (2, "x-api-key", "", "apikey"), (3, "content-type,x-sig", "content-type=text/xml", "none"), (4, "authorization", "", "apikey")]))
def res15_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.headers(HEADERS.df(spark)).select("call", F.array_join("names", ",").alias("names"), F.array_join("shown", ",").alias("shown"), "auth")


METHODS = Fixture("md", "id bigint, implied string, said string", [(1, "GET", "post"), (2, None, "post"), (3, None, "{method}"), (4, None, None)])


@query("res14_method", f"WITH {METHODS.sql} SELECT id, coalesce(implied, CASE WHEN said NOT LIKE '%{{%' THEN upper(said) END, 'DYNAMIC') AS method FROM md")
def res14_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return METHODS.df(spark).select("id", facts.method(F.col("implied"), F.col("said")).alias("method"))


PARTS = Fixture("pt", "id bigint, ord int, kind string, text string", [(1, 0, "static", "https://a.io/"), (1, 1, "dynamic", "id"), (2, 0, "env", "BASE"), (2, 1, "static", "/x"), (3, 0, "static", "a"), (3, 1, "static", "b")])


@query("res08_parts_template", f"WITH {PARTS.sql} SELECT id, string_agg(CASE kind WHEN 'static' THEN text WHEN 'env' THEN '{{env:' || text || '}}' ELSE '{{' || text || '}}' END, '' ORDER BY ord) AS template, CASE WHEN bool_and(kind = 'static') THEN string_agg(text, '' ORDER BY ord) END AS static FROM pt GROUP BY id")
def res08_parts_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.templates(PARTS.df(spark))


BRANCHES = Fixture("br", "id bigint, a string, b string", [(1, "https://a.io", "https://b.io"), (2, "{x}/p", "https://b.io/q"), (3, "{env:BASE}/p", "/q"), (4, "{a}", "{b}")])


@query("res07_pick_branch", golden("id, picked", [(1, "https://a.io"), (2, "https://b.io/q"), (3, "{env:BASE}/p"), (4, None)]))
def res07_pick_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BRANCHES.df(spark).select("id", facts.pick_branch(F.col("a"), F.col("b")).alias("picked"))


FORM = Fixture("fm", "id bigint, body string", [(1, "a=1&b={x}&c"), (2, "=2&d=4=5"), (3, "")])


@query("res22_form_string", golden("id, keys, static", [(1, "a,b,c", "a=1"), (2, "d", "d=4=5"), (3, "", "")]))
def res22_form_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FORM.df(spark).select("id", F.array_join(facts.form_keys(F.col("body")), ",").alias("keys"), F.array_join(facts.form_static(F.col("body")), ",").alias("static"))


@query("res21_json_props", "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS is_integer FROM events")
def res21_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of a JSON value: keys, a value, its type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props", F.expr("try_parse_json(props)").alias("v"))
    k = F.expr("try_variant_get(v, '$.k', 'bigint')")
    return events.select("event_id", F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("keys"), k.alias("k"), (F.schema_of_variant(F.expr("try_variant_get(v, '$.k', 'variant')")) == "BIGINT").alias("is_integer"))


EDITS = Fixture("ed", "call bigint, ord int, op string, key string, branch string, branches int", [(1, 0, "set", "a", None, None), (1, 1, "set", "b", "if", 2), (1, 2, "set", "b", "else", 2), (1, 3, "set", "c", "if", 2), (1, 4, "del", "a", None, None), (2, 0, "set", "z", None, None)])


@query("res24_edits", golden("call, key, required", [(1, "b", True), (1, "c", False), (2, "z", True)]))
def res24_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys left after edits in order; a key set in every branch of its group, or outside any, is required."""
    rows = EDITS.df(spark)
    last_del = F.max(F.when((F.col("op") == "del") & F.col("branch").isNull(), F.col("ord"))).over(Window.partitionBy("call", "key"))
    alive = rows.withColumn("gone", last_del).filter("op = 'set' and ord > coalesce(gone, -1)")
    return alive.groupBy("call", "key").agg((F.bool_or(F.col("branch").isNull()) | (F.count_distinct("branch") >= F.max("branches"))).alias("_r"), F.bool_or(F.col("branch").isNull()).alias("_plain")).select("call", "key", F.coalesce(F.col("_r"), F.col("_plain")).alias("required"))


CONFIG = Fixture("cf", "id bigint, value string", [(1, "${env:TOKEN}/x"), (2, "${HOST:-localhost}:80"), (3, "{env:BASE}/y"), (4, "${input:key}"), (5, "plain")])


@query("res31_config_placeholders", golden("id, template, fallback", [(1, "{env:TOKEN}/x", None), (2, "{env:HOST}:80", "localhost"), (3, "{env:BASE}/y", None), (4, "{key}", None), (5, "plain", None)]))
def res31_config_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.regexp_replace("value", r"\$\{input:([^}]+)\}", "{$1}")
    v = F.regexp_replace(F.regexp_replace(v, r"\$\{env:([^}]+)\}", "{env:$1}"), r"\$\{([A-Za-z_]\w*)(?::-[^}]*)?\}", "{env:$1}")
    return CONFIG.df(spark).select("id", v.alias("template"), F.nullif(F.regexp_extract("value", r"\$\{[A-Za-z_]\w*:-([^}]*)\}", 1), F.lit("")).alias("fallback"))


@query("res32_safe_keys", "SELECT p_name, p_name NOT IN ('__proto__', 'constructor', 'prototype') AS safe FROM part UNION ALL SELECT 'constructor', false")
def res32_safe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([("constructor",)], "p_name string")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").union(more).select("p_name", urls.safe_key(F.col("p_name")).alias("safe"))


QUERY = Fixture("qy", "id bigint, url string, given array<string>", [(1, "https://a.io/x?a=1&b=2", ["b", "c"]), (2, "https://a.io/x", ["z"]), (3, "/r?q=1", [])])


@query("res17_query_names", golden("id, names", [(1, "a,b,c"), (2, "z"), (3, "q")]))
def res17_query_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_distinct(F.concat("u.query", "given"))
    return urls.with_shape(QUERY.df(spark), F.col("url"), F.lit(False)).select("id", F.array_join(names, ",").alias("names"))


CURL = Fixture("cu", "id bigint, method string, url string, body string", [(1, "GET", "https://a.io/x", None), (2, "POST", "https://a.io/it's", '{"q": "it\'s"}')])


@query("out06_curl", golden("id, command", [(1, "curl 'https://a.io/x'"), (2, "curl -X POST 'https://a.io/it'\\''s' --data '{\"q\": \"it'\\''s\"}'")]))
def out06_curl(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = text.shell_quote
    parts = F.concat_ws(" ", F.lit("curl"), F.when(F.col("method") != "GET", F.concat(F.lit("-X "), "method")), q(F.col("url")), F.when(F.col("body").isNotNull(), F.concat(F.lit("--data "), q(F.col("body")))))
    return CURL.df(spark).select("id", parts.alias("command"))
