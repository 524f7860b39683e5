"""Further queries: file scopes, configuration values, detection against dimensions, examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.functions import text
from callscope.operators import detect, examples, facts, frontend, shapes
from callscope.plans.fixture import Fixture, golden
from callscope.plans.registry import query
from callscope.sources import config

FILES = Fixture(
    "files",
    "path string, body string",
    [
        ("src/app.ts", "const a = 1;\n"), ("src/app.test.ts", "x"), ("src/types.d.ts", "x"), ("dist/x.js", "x"), ("lib/jquery.min.js", "x"), ("lib/bundle.js", "a" * 6000), ("web/index.html", "<p>"),
        ("a.py", "x"), (".mcp.json", "{}"), (".cursor/mcp.json", "{}"), ("opencode.jsonc", "{}"), ("x/.mcp.json.bak", "{}"), ("big.json", "y" * 5000), ("notes.txt", "n" * 3000),
    ],
)


@query("src04_typescript_scope", golden("path", [("src/app.ts",), ("web/index.html",)]))
def src04_typescript_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.typescript_scope(FILES.df(spark)).select("path")


@query("src06_mcp_config_files", golden("path", [(".mcp.json",), (".cursor/mcp.json",), ("opencode.jsonc",)]))
def src06_mcp_config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FILES.df(spark).filter(config.is_mcp_config(F.col("path"))).select("path")


@query("src07_text_files", golden("path", [(".cursor/mcp.json",), (".mcp.json",), ("a.py",)]))
def src07_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a size, the first few by path."""
    return config.first_files(FILES.df(spark).filter(F.octet_length("body") <= 2048), 3).select("path")


@query("src08_bounded_config", golden("path", [(".mcp.json",), (".cursor/mcp.json",)]))
def src08_bounded_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FILES.df(spark).filter(F.col("path").endswith(".json") & (F.octet_length("body") <= 4096)).select("path")


COMPONENTS = Fixture("comp", "path string, body string", [("A.vue", '<template><p/></template>\n<script setup lang="ts">\nconst a = 1\n</script>'), ("B.svelte", "<script>let b</script><p/>"), ("C.astro", "---\nconst c = 3\n---\n<p/>"), ("D.vue", "<template/>")])


@query("src12_components", golden("path, script", [("A.vue", "const a = 1"), ("B.svelte", "let b"), ("C.astro", "const c = 3"), ("D.vue", "")]))
def src12_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    front = F.when(F.col("path").endswith(".astro"), F.regexp_extract("body", r"(?s)^---\s*\n(.*?)\n---", 1)).otherwise("")
    scripts = F.array_join(F.regexp_extract_all("body", F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1)), "\n")
    return COMPONENTS.df(spark).select("path", F.trim(F.regexp_replace(F.concat(front, scripts), r"^\s+|\s+\z", "")).alias("script"))


JSONC = Fixture("jc", "id bigint, body string", [(1, '{"a": "x//y", /* c */ "b": [1, 2,], }'), (2, '{"a": "q\\"//", // end\n "b": [3]}'), (3, "{")])


@query("src14_jsonc", golden("id, a, n", [(1, "x//y", 2), (2, 'q"//', 1), (3, None, None)]))
def src14_jsonc(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.from_json(config.plain_json(F.col("body")), "struct<a:string,b:array<int>>")
    return JSONC.df(spark).withColumn("j", j).select("id", F.col("j.a").alias("a"), F.when(F.col("j.b").isNotNull(), F.size("j.b")).cast("long").alias("n"))


LOADED = Fixture("loaded", "src string, literal string, key string", [("app/main.py", "conf/x.json", "$.api.url"), ("app/main.py", "../root.json", "$.k"), ("app/main.py", "none.json", "$.k")])
CONFS = Fixture("confs", "path string, body string", [("app/conf/x.json", '{"api": {"url": "https://a.io"}}'), ("root.json", '{"k": 5}')])


@query("src16_loaded_config", golden("src, key, value", [("app/main.py", "$.api.url", "https://a.io"), ("app/main.py", "$.k", "5"), ("app/main.py", "$.k", None)]))
def src16_loaded_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.loaded_values(LOADED.df(spark), CONFS.df(spark)).select("src", "key", "value")


SPRING = Fixture("spring", "path string, body string", [("application.properties", "api.base-url=https://a.io\n# c\nserver.port = 80"), ("application-dev.properties", "api.baseUrl=https://dev.io")])


@query("src17_spring_properties", golden("key, value", [("api.baseurl", "https://dev.io"), ("server.port", "80")]))
def src17_spring_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.spring_properties(SPRING.df(spark), ["dev"])


CLASSES = Fixture("classes", "cls string, ord int, base string", [("C", 0, "B"), ("C", 1, "X"), ("B", 0, "A"), ("A", 0, "B"), ("X", 0, None)])
FIELDS = Fixture("fields", "cls string, name string, value string", [("A", "url", "a"), ("X", "url", "x"), ("X", "key", "k"), ("C", "own", "c")])


@query("res03_class_members", golden("cls, name, value", [("A", "url", "a"), ("B", "url", "a"), ("C", "own", "c"), ("C", "url", "x"), ("C", "key", "k"), ("X", "url", "x"), ("X", "key", "k")]))
def res03_class_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members through base classes, the nearest first, then the earlier base."""
    return detect.class_members(CLASSES.df(spark), FIELDS.df(spark))


ENCODINGS = Fixture("enc", "id bigint, role string, serializer string, content_type string", [(1, "json", None, None), (2, "body", "JSON.stringify", None), (3, "body", None, "application/x-www-form-urlencoded; charset=x"), (4, "body", None, "Application/SOAP+XML"), (5, "files", None, None), (6, "body", None, None), (7, None, None, None), (8, "data", "URLSearchParams", None)])


@query("res19_body_encoding", golden("id, encoding", [(1, "json"), (2, "json"), (3, "form"), (4, "xml"), (5, "multipart"), (6, "raw"), (7, "none"), (8, "form")]))
def res19_body_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ENCODINGS.df(spark).select("id", detect.body_encoding(F.col("role"), F.col("serializer"), F.col("content_type")).alias("encoding"))


SHAPES = Fixture("shapes", "call bigint, branch int, path string, kind string", [(1, 0, "$.a", "string"), (1, 1, "$.a", "number"), (1, 0, "$.b", "string"), (1, 1, "$.c.d", "string"), (2, 0, "$.a", "string")])


@query("res20_union_shapes", golden("call, path, kinds, required", [(1, "$.a", "number|string", True), (1, "$.b", "string", False), (1, "$.c.d", "string", False), (2, "$.a", "string", True)]))
def res20_union_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of a body's alternatives: kinds of each path, required where every branch has it."""
    rows = SHAPES.df(spark).withColumnRenamed("branch", "alt").withColumn("value", F.lit(None).cast("string"))
    return shapes.union(rows, "call").select("call", "path", F.array_join("kinds", "|").alias("kinds"), "required")


XML = Fixture("xml", "id bigint, body string", [(1, "<a><b>1</b><c/></a>"), (2, "<!DOCTYPE html><html/>"), (3, "plain"), (4, "<svg></svg>"), (5, " <ns:Order id='1'/>")])


@query("res23_xml_root", golden("id, root", [(1, "a"), (5, "ns:Order")]))
def res23_xml_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root element of XML bodies; HTML and SVG are none."""
    return XML.df(spark).select("id", facts.xml_root(F.col("body")).alias("root")).filter("root is not null")


TABLE = Fixture("tbl", "call bigint, key string, ord int, name string, host string", [(1, None, 0, "openai", "api.openai.com"), (1, None, 1, "groq", "api.groq.com"), (2, "groq", 0, "openai", "api.openai.com"), (2, "groq", 1, "groq", "api.groq.com")])


@query("res26_table_read", golden("call, host", [(1, "api.openai.com"), (1, "api.groq.com"), (2, "api.groq.com")]))
def res26_table_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read with a known key takes its entry, one with an unknown key all of them."""
    rows = TABLE.df(spark).withColumn("table", F.col("call"))
    return facts.table_reads(rows.select("call", "table", "key").distinct(), rows.select("table", "name", "host"))


POINTS = Fixture("points", "id bigint, type string, qualifier string", [(1, "Api", None), (2, "Api", "b"), (3, "Db", None), (4, "No", None)])
PROVIDED = Fixture("provided", "type string, qualifier string, value string", [("Api", "a", "https://a.io"), ("Api", "b", "https://b.io"), ("Db", None, "https://d.io")])


@query("res30_injection", golden("id, value", [(2, "https://b.io"), (3, "https://d.io")]))
def res30_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one value provided for a type, or for a type under a qualifier; several leave a point open."""
    return facts.injected(POINTS.df(spark), PROVIDED.df(spark))


SDK_CALLS = Fixture("sdk_calls", "call bigint, root string, segs string", [(1, "stripe", "customers.create"), (2, "stripe", "customers.x.list"), (3, "stripe", "charges.capture"), (4, "axios", "get"), (5, "stripe", "v2.core.events.list")])
SDK = Fixture("sdk", "root string, pattern string, method string, path string, ord int", [("stripe", "customers.create", "POST", "/v1/customers", 0), ("stripe", "customers.*.list", "GET", "/v1/customers/{id}/x", 1), ("stripe", "charges.*", "POST", "/v1/charges/{op}", 2), ("stripe", "v2.**", "GET", "/v2/{path}", 3)])


FOUND = Fixture("cands", "call bigint, detector int, client string", [(1, 2, "axios"), (1, 0, "sdk"), (2, 1, "fetch"), (2, 3, "xhr")])


@query("det03_first_detector", f"WITH {FOUND.sql} SELECT call, arg_min(client, detector) AS client FROM cands GROUP BY call")
def det03_first_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.first_detector(FOUND.df(spark))


CLIENTS = Fixture("clients", "repo string, client string, endpoint string", [("a", "apollo", "https://a.io/graphql"), ("a", "apollo", "https://a.io/graphql"), ("b", "apollo", "https://x.io"), ("b", "urql", "https://y.io")])


@query("det09_single_client", "WITH clients(repo, client, endpoint) AS (VALUES ('a', 'apollo', 'https://a.io/graphql'), ('a', 'apollo', 'https://a.io/graphql'), ('b', 'apollo', 'https://x.io'), ('b', 'urql', 'https://y.io')) SELECT repo, min(endpoint) AS endpoint FROM clients GROUP BY repo HAVING count(DISTINCT endpoint) = 1")
def det09_single_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.agreed(CLIENTS.df(spark), "repo", "endpoint")


CARDS = Fixture("cards", "path string, body string", [("a.json", '{"name": "x", "version": "1.0", "protocolVersion": "0.3", "url": "https://a.io", "skills": [], "capabilities": {}}'), ("b.json", "{}"), ("c.json", "[")])


@query("fn19_card_facts", golden("path, name, version, protocol", [("a.json", "x", "1.0", "0.3")]))
def fn19_card_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.from_json("body", "struct<name:string,version:string,protocolVersion:string>")
    return CARDS.df(spark).withColumn("j", j).filter("j.protocolVersion is not null").select("path", F.col("j.name").alias("name"), F.col("j.version").alias("version"), F.col("j.protocolVersion").alias("protocol"))


@query("fn21_seeded_numbers")
def fn21_seeded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded generator of 32-bit numbers, from a text's hash; the same in every run."""
    return examples.numbers(spark.createDataFrame([("",), ("a.ts:1:2",), ("é😀",)], "seed string"))


FIELDS_ = Fixture("params", "call string, path string, kind string, required boolean", [("c1", "email", "string", True), ("c1", "count", "integer", True), ("c1", "note", "string", False), ("c2", "isActive", "boolean", True)])


@query("fn22_examples")
def fn22_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A minimal and a full example body of each call."""
    return examples.bodies(FIELDS_.df(spark))


OPS = Fixture("ops", "call bigint, rpc string, graphql string, soap string, action string, sdk boolean", [(1, "getSlot", None, "x", None, False), (2, None, "Shop", None, None, False), (3, None, None, None, "Describe", False), (4, "m", None, None, None, True), (5, None, None, None, None, False)])


@query("opn01_dispatch", f"WITH {OPS.sql} SELECT call, coalesce(rpc, graphql, soap, action) AS name, CASE WHEN rpc IS NOT NULL THEN 'json-rpc' WHEN graphql IS NOT NULL THEN 'graphql' WHEN soap IS NOT NULL THEN 'soap' ELSE 'action' END AS protocol FROM ops WHERE NOT sdk AND coalesce(rpc, graphql, soap, action) IS NOT NULL")
def opn01_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first protocol that names an operation; SDK calls have their own."""
    return facts.dispatch(OPS.df(spark))


NAMES = Fixture("shp", "call bigint, ord int, value string, kind string", [(1, 0, "getSlot", "enum"), (1, 1, "getBalance", "enum"), (2, 0, "get{kind}Info", "template"), (3, 0, None, "dynamic")])


@query("opn10_names", golden("call, names, dynamic", [(1, "getSlot,getBalance", False), (2, "get{kind}Info", True), (3, "", True)]))
def opn10_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = NAMES.df(spark).groupBy("call").agg(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("ord", "value")))).alias("v"), F.bool_or(F.col("kind") != "enum").alias("dynamic"))
    return rows.select("call", F.array_join(F.transform("v", lambda x: x["value"]), ",").alias("names"), "dynamic")


@query("sort02_front_end_order", golden("place, language", [(0, "typescript"), (1, "python"), (2, "shell")]))
def sort02_front_end_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order carried as a number, as tables have none."""
    order = spark.createDataFrame([(0, "typescript"), (1, "python"), (5, "shell"), (3, "php")], "ord int, language string")
    seen = spark.createDataFrame([("shell",), ("python",), ("typescript",), ("python",)], "language string").distinct()
    return order.join(seen, "language").select((F.row_number().over(Window.orderBy("ord")) - 1).cast("long").alias("place"), "language")


HTTPIE = Fixture("ht", "path string, body string", [("a.sh", "http POST api.acme.com/v1 name=x n:=1 X-Key:abc\nhttps a.io q==1\nhttp :3000/x\nls | grep http\n# http no.io")])


@query("det16_httpie", golden("line, method, url, headers, body_keys", [(1, "POST", "http://api.acme.com/v1", "x-key", "name,n"), (2, "GET", "https://a.io?q=1", "", ""), (3, "GET", "http://localhost:3000/x", "", "")]))
def det16_httpie(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "line long, client string, method string, url string, headers string, body_keys string, problem string"
    return frontend.scan_files(HTTPIE.df(spark), frontend.httpie_calls, schema).select("line", "method", "url", "headers", "body_keys")


TAGGED = Fixture("tagged", "id bigint, code string", [(1, "var a = {{ user.id }};"), (2, "x(<%= y\nz %>, 1)"), (3, "plain"), (4, "{% if a %}f(){% endif %}")])


@query("low10_template_tags", golden("id, code", [(1, "var a = " + "_" * 13 + ";"), (2, "x(_____\n____, 1)"), (3, "plain"), (4, "_" * 10 + "f()" + "_" * 11)]))
def low10_template_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TAGGED.df(spark).select("id", text.without_templates(F.col("code")).alias("code"))


ENVELOPES = Fixture("env", "path string, body string", [("1", '{"query": "query A { a { b } }", "variables": {}}'), ("2", '[{"query": "{ x }"}, {"query": "mutation M { y }"}]'), ("3", '{"operationName": "P", "extensions": {"persistedQuery": {"sha256Hash": "0"}}}'), ("4", '{"q": 1}')])


@query("opn04_graphql_envelope", golden("path, type, name, fields", [("1", "query", "A", "a.b"), ("2", "query", "x", "x"), ("2", "mutation", "M", "y"), ("3", None, "P", None)]))
def opn04_graphql_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of GraphQL bodies: one document, a batch, or a persisted query by its name."""
    shape = "struct<query:string,operationName:string,extensions:struct<persistedQuery:string>>"
    batch = F.ltrim("body").startswith("[")
    many = F.coalesce(F.when(batch, F.from_json("body", f"array<{shape}>")), F.array(F.from_json("body", shape)))
    each = ENVELOPES.df(spark).select("path", F.explode(many).alias("r"))
    documents = each.filter("r.query is not null").select("path", F.col("r.query").alias("body"))
    found = frontend.scan_files(documents, frontend.graphql_operations, "type string, name string, fields string, problem string").filter("problem is null").drop("problem")
    named = each.filter("r.query is null and r.extensions.persistedQuery is not null").select("path", F.lit(None).cast("string").alias("type"), F.col("r.operationName").alias("name"), F.lit(None).cast("string").alias("fields"))
    return found.union(named)


KEYS = Fixture(
    "example_keys", "seed string, key string, kind string",
    [("a", k, kind) for k, kind in [("currency", "string"), ("apiKey", "string"), ("api_key", "number"), ("model", "string"), ("role", "string"), ("country_code", "string"), ("active", "boolean"), ("shape", "string"), ("locale", "string"), ("cardNumber", "string"), ("status", "string"), ("contentType", "string")]],
)


@query(
    "fn20_by_name",
    golden("key, kind, value", [("currency", "string", "usd"), ("apiKey", "string", "<apiKey>"), ("api_key", "number", None), ("model", "string", "gpt-4o"), ("role", "string", "user"), ("country_code", "string", "US"), ("active", "boolean", None), ("shape", "string", None), ("locale", "string", "en-US"), ("cardNumber", "string", "4242424242424242"), ("status", "string", "active")]),
)
def fn20_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a name settles without drawing; ``contentType`` is drawn, as its name holds ``content``."""
    return examples.named_values(KEYS.df(spark)).filter("key <> 'contentType'").select("key", "kind", "value")
