"""Queries over call rows: numbering, joins, statistics. ``events`` and the order tables stand in for calls where size matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators import facts, joins, requests
from callscope.plans.fixture import Fixture, golden
from callscope.plans.registry import query

_T = """t AS (SELECT event_id AS seq, 'f' || (user_id % 20) || '.ts:' || (event_id % 7) || ':1' AS place, CASE WHEN event_id % 3 = 0 THEN event_type END AS name,
  CASE WHEN event_id % 3 = 0 THEN '{"name":"' || event_type || '"}' ELSE 'null' END AS op, 's' || (event_id % 5) AS sent FROM events),
u AS (SELECT seq, place, substr(sha1(place || coalesce(' ' || name, '')), 1, 12) AS id, op, name, sent FROM t)"""


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call rows made of events: a site, perhaps an operation, and what is sent."""
    named = F.col("event_id") % 3 == 0
    place = F.concat(F.lit("f"), F.col("user_id") % 20, F.lit(".ts:"), F.col("event_id") % 7, F.lit(":1"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"),
        place.alias("place"),
        F.when(named, F.col("event_type")).alias("name"),
        F.when(named, F.concat(F.lit('{"name":"'), "event_type", F.lit('"}'))).otherwise("null").alias("op"),
        F.concat(F.lit("s"), F.col("event_id") % 5).alias("sent"),
    )
    return rows.withColumn("id", requests.call_id(F.col("place"), F.lit(0), F.col("name")))


@query(
    "win01_one_per_request",
    f"WITH {_T}, k AS (SELECT *, row_number() OVER (PARTITION BY id, op, sent ORDER BY seq) rn FROM u), d AS (SELECT * FROM k WHERE rn = 1), f AS (SELECT *, min(seq) OVER (PARTITION BY place, sent) first_seq FROM d), "
    "g AS (SELECT *, CASE WHEN name <> '' THEN row_number() OVER (PARTITION BY id ORDER BY seq) - 1 ELSE dense_rank() OVER (PARTITION BY place ORDER BY first_seq) - 1 END AS n FROM f) "
    "SELECT seq, n::BIGINT AS n, CASE WHEN n = 0 THEN id ELSE substr(sha1(place || '#' || n || coalesce(' ' || name, '')), 1, 12) END AS id FROM g",
)
def win01_one_per_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.one_per_request(raw_calls(spark, sf_dir)).select("seq", "n", "id")


@query("win02_call_id", f"WITH {_T} SELECT seq, id FROM u UNION ALL SELECT -1, 'aadec4f50865'")
def win02_call_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.range(1).select(F.lit(-1).cast("long").alias("seq"), requests.call_id(F.lit("a.ts:1:2"), F.lit(0), F.lit(None).cast("string")).alias("id"))
    return raw_calls(spark, sf_dir).select("seq", "id").union(known)


def line_order() -> Column:
    """A total order of an order's lines (their numbers repeat)."""
    return F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 100000 + F.col("l_suppkey")


@query(
    "win03_candidates",
    "WITH c AS (SELECT l_orderkey AS raw_id, 'h' || (l_suppkey % 40) AS host, min(l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey) AS ord FROM lineitem GROUP BY 1, 2), d AS (SELECT *, count(*) OVER (PARTITION BY raw_id) AS hosts, row_number() OVER (PARTITION BY raw_id ORDER BY ord) AS k FROM c) "
    "SELECT raw_id, host, ord, hosts >= 2 AND hosts <= 5 AS candidate, hosts > 5 AS limited FROM d WHERE hosts <= 5 OR k = 1",
)
def win03_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("raw_id"), F.concat(F.lit("h"), F.col("l_suppkey") % 40).alias("host"), line_order().alias("ord"))
    return requests.candidates(rows, limit=5)


@query(
    "win04_diverse",
    "WITH e AS (SELECT l_orderkey AS call_id, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS ord, l_shipmode AS path FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY call_id, path ORDER BY ord) AS again FROM e), p AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY again, ord, path) AS rank FROM r) SELECT call_id, ord, path, rank FROM p WHERE rank <= 3",
)
def win04_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("call_id"), line_order().alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("path"))
    return requests.diverse(rows)


SETS = Fixture("sets", "id bigint, a string, b string", [(1, "limit,page", "page,q"), (2, "", "x"), (3, "z,z,y", "y,a"), (4, "", "")])


@query("set02_ordered_union", golden("id, names", [(1, "limit,page,q"), (2, "x"), (3, "z,y,a"), (4, "")]))
def set02_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return SETS.df(spark).select("id", F.array_join(F.array_distinct(F.concat(items("a"), items("b"))), ",").alias("names"))


IMPORTS = Fixture("imports", "name string", [("google.cloud.storage.client",), ("google.genai.types",), ("requests.sessions",), ("googleapis",), ("app.openai",), ("openai.resources",)])
ROOTS = Fixture(
    "roots",
    "root string, package string, declared boolean, own boolean",
    [("google", "google-api", False, False), ("google.cloud", "google-cloud", True, False), ("google.cloud.storage", "google-cloud-storage", False, False), ("google.genai", "google-genai", False, False), ("requests", "requests", True, False), ("openai", "openai", False, False)],
)


@query(
    "join02_longest_prefix",
    f"WITH {IMPORTS.sql}, {ROOTS.sql} SELECT name, arg_max(package, length(root) + CASE WHEN declared THEN 1000 ELSE 0 END + CASE WHEN own THEN 1000 ELSE 0 END) AS package FROM imports LEFT JOIN roots ON name = root OR starts_with(name, root || '.') GROUP BY name",
)
def join02_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.longest_prefix(IMPORTS.df(spark), ROOTS.df(spark))


@query(
    "join04_as_of",
    "WITH u AS (SELECT event_id AS use_id, user_id, ts FROM events WHERE event_id % 3 = 0), a AS (SELECT user_id, ts, event_id AS value FROM events WHERE event_id % 3 = 1), "
    "m AS (SELECT use_id, u.user_id, u.ts, value, a.ts AS assigned, row_number() OVER (PARTITION BY use_id ORDER BY (a.ts < u.ts) DESC, CASE WHEN a.ts < u.ts THEN epoch_us(u.ts) - epoch_us(a.ts) ELSE epoch_us(a.ts) - epoch_us(u.ts) END) AS k FROM u JOIN a ON u.user_id = a.user_id) "
    "SELECT u.use_id, m.assigned AS assigned_at FROM u LEFT JOIN m ON u.use_id = m.use_id AND k = 1",
)
def join04_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    uses = events.filter("event_id % 3 = 0").select(F.col("event_id").alias("use_id"), "user_id", F.col("ts").alias("at"))
    assigns = events.filter("event_id % 3 = 1").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("value"))
    return joins.as_of(uses, assigns, ["user_id"]).select("use_id", "assigned_at")


ENTRIES = Fixture("entries", "entry bigint, repo string, file string, line int", [(0, "r", "a.ts", 10), (1, "r", "a.ts", 11), (2, "r", "a.ts", 40), (3, "r", "b.ts", 5), (4, "r", "c.ts", 1)])
CALLS = Fixture("found", "call bigint, repo string, file string, line int, via boolean", [(100, "r", "a.ts", 11, False), (101, "r", "a.ts", 12, False), (102, "r", "a.ts", 44, False), (103, "r", "b.ts", 5, True), (104, "r", "b.ts", 4, False)])


@query("join05_match_inventory", golden("entry, call, distance", [(0, 101, 2), (1, 100, 0), (2, None, None), (3, 103, 0), (4, None, None)]))
def join05_match_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.match_inventory(ENTRIES.df(spark), CALLS.df(spark)).select("entry", "call", "distance")


ITEMS = Fixture("items", "path string, key string", [("app/web/src/a.ts", "MODEL"), ("app/api/b.ts", "MODEL"), ("c.ts", "MODEL"), ("app/web/src/a.ts", "REGION")])
SETTINGS = Fixture("settings", "dir string, key string, value string", [("", "MODEL", "gpt-4o"), ("app/web", "MODEL", "claude-3"), ("lib", "MODEL", "x")])


@query(
    "join06_nearest_up",
    f"WITH {ITEMS.sql}, {SETTINGS.sql} SELECT path, items.key AS key, arg_max(value, length(dir)) AS value, max(dir) AS dir FROM items LEFT JOIN settings ON items.key = settings.key AND (dir = '' OR starts_with(path, dir || '/')) GROUP BY 1, 2",
)
def join06_nearest_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_up(ITEMS.df(spark), SETTINGS.df(spark))


@query(
    "join07_changed_scope",
    "SELECT c_custkey FROM customer WHERE c_custkey % 10 = 1 OR c_custkey IN (SELECT o_custkey FROM orders WHERE (o_orderkey % (SELECT count(*) FROM customer)) % 10 = 1 AND o_orderkey % (SELECT count(*) FROM customer) IN (SELECT c_custkey FROM customer))",
)
def join07_changed_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for files, orders for imports of the file numbered by the order's key."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("path"))
    n = customers.count()
    imports = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("path"), (F.col("o_orderkey") % n).alias("target"))
    return joins.changed_scope(customers, imports, customers.filter("path % 10 = 1")).select(F.col("path").alias("c_custkey"))


NAMED = Fixture("named_hosts", "host string", [("api.acme.com",), ("eu.api.acme.com",), ("api.mailgun.net",), ("x.beta.io",), ("deep.x.beta.io",), ("beta.io",)])
CALLED = Fixture("called", "host string", [("API.acme.com:443",), ("{region}.beta.io",), ("{host}",), (None,)])


@query("join08_unexplained_hosts", golden("host", [("eu.api.acme.com",), ("api.mailgun.net",), ("beta.io",)]))
def join08_unexplained_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.unexplained_hosts(NAMED.df(spark), CALLED.df(spark))


@query("join09_template_hosts", golden("host, explained", [("api.acme.com", True), ("eu.api.acme.com", False), ("api.mailgun.net", False), ("x.beta.io", True), ("deep.x.beta.io", True), ("beta.io", False)]))
def join09_template_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = NAMED.df(spark)
    return named.join(joins.unexplained_hosts(named, CALLED.df(spark)).withColumn("_no", F.lit(True)), "host", "left").select("host", F.col("_no").isNull().alias("explained"))


KNOWN = Fixture("known", "package string, provider string, supported boolean", [("openai", "openai", True), ("stripe", "stripe", True), ("sdk-x", "x", False), ("twilio", "twilio", True), ("unused", "u", True)])
DECLARED = Fixture("declared", "package string", [("openai",), ("stripe",), ("left-pad",), ("openai",)])
USED = Fixture("used", "package string, file string", [("openai", "a.ts"), ("openai", "b.ts"), ("openai", "a.ts"), ("sdk-x", "c.ts"), ("twilio", "d.ts"), ("react", "e.ts")])
SDK_CALLS = Fixture("sdk_calls", "package string", [("openai",), ("openai",), ("sdk-x",)])


@query(
    "join10_sdk_coverage",
    f"WITH {KNOWN.sql}, {DECLARED.sql}, {USED.sql}, {SDK_CALLS.sql}, s AS (SELECT package, count(DISTINCT file) AS n FROM used GROUP BY 1), c AS (SELECT package, count(*) AS n FROM sdk_calls GROUP BY 1) "
    "SELECT k.package, provider, k.package IN (SELECT package FROM declared) AS declared, s.n IS NOT NULL AS imported, coalesce(s.n, 0) AS import_sites, coalesce(c.n, 0) AS calls, "
    "CASE WHEN s.n IS NULL THEN 'declared-not-imported' WHEN NOT supported THEN 'unsupported' WHEN c.n > 0 THEN 'ok' ELSE 'imported-no-calls' END AS status "
    "FROM known k LEFT JOIN s ON k.package = s.package LEFT JOIN c ON k.package = c.package WHERE s.n IS NOT NULL OR k.package IN (SELECT package FROM declared)",
)
def join10_sdk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.sdk_coverage(KNOWN.df(spark), DECLARED.df(spark), USED.df(spark), SDK_CALLS.df(spark))


WRAPPED = Fixture("wrapped", "call bigint, fn string", [(1, "get"), (2, "rpc"), (3, "loop"), (4, "none")])
INNER = Fixture("inner_calls", "fn string, ord int, target string, request string", [("get", 0, "send", None), ("send", 0, None, "GET /a"), ("send", 1, "retry", None), ("retry", 0, "send", None), ("retry", 1, None, "GET /a"), ("rpc", 0, None, "POST /rpc"), ("rpc", 1, "get", None), ("loop", 0, "loop", None), ("loop", 1, None, "GET /l")])


@query("join11_expand_wrappers", golden("call, request, hops", [(1, "GET /a", 2), (2, "POST /rpc", 1), (2, "GET /a", 3), (3, "GET /l", 1)]))
def join11_expand_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.expand_wrappers(WRAPPED.df(spark), INNER.df(spark))


@query(
    "join13_file_groups",
    "WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders UNION ALL SELECT 'c' || c_custkey, 'c' || (c_custkey + 1) FROM customer WHERE c_custkey % 5 <> 0), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(file, reach) AS (SELECT DISTINCT a, a FROM s UNION SELECT r.file, s.b FROM r JOIN s ON r.reach = s.a) "
    'SELECT file, min(reach) AS "group" FROM r GROUP BY file',
)
def join13_file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as files that import their customer's, and customers as files that import the next one's, five in a row."""
    file = lambda kind, c: F.concat(F.lit(kind), F.col(c) if isinstance(c, str) else c)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(file("o", "o_orderkey").alias("src"), file("c", "o_custkey").alias("dst"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 5 <> 0").select(file("c", "c_custkey").alias("src"), file("c", F.col("c_custkey") + 1).alias("dst"))
    return joins.file_groups(orders.union(customers))


MODELS = Fixture("models", "call bigint, ord int, value string, origin string, dynamic boolean", [(1, 0, "gpt-4o", "default", False), (1, 1, "gpt-4o-mini", "literal", False), (1, 2, "gpt-4o", "literal", False), (2, 0, None, "param", True), (3, 0, "claude-3", "env", False)])


@query("agg10_model_fact", golden("call, model_values, source, dynamic", [(1, "gpt-4o,gpt-4o-mini", "literal", False), (2, "", "param", True), (3, "claude-3", "env", False)]))
def agg10_model_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct model names in first-seen order; a literal source beats others."""
    return facts.model_facts(MODELS.df(spark)).select("call", F.array_join("values", ",").alias("model_values"), "source", "dynamic")
