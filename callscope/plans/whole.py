"""Queries of joins and call-row operators over relations that whole tables make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import hosts, text, urls
from callscope.operators import callrows, detect, examples, facts, javascript, joins, operations, requests, shapes
from callscope.plans.fixture import Made
from callscope.plans.registry import query

CHAINS = Made("chains", "SELECT o_orderkey AS call, 'lib' || (o_custkey % 30) || '.' || lower(o_orderstatus) || CASE WHEN o_orderkey % 3 = 0 THEN '.x' ELSE '' END || '.k' || (o_orderkey % 7) AS chain FROM orders")
METHODS = Made(
    "methods",
    "SELECT n_nationkey AS entry, 'lib' || n_nationkey AS root, CASE n_nationkey % 4 WHEN 0 THEN 'o.k1' WHEN 1 THEN '*.k2' WHEN 2 THEN '**.k3' ELSE '**' END AS key, 'p' || n_regionkey AS provider, n_name AS package, 'h.io' AS host, 'GET' AS method, '/' AS path FROM nation "
    "UNION ALL SELECT 100 + n_nationkey, 'lib' || n_nationkey, 'f.*', 'q', 'second', 'h.io', 'PUT', '/q' FROM nation",
)


@query(
    "join01_registry_of_nations",
    f"WITH {CHAINS.sql}, {METHODS.sql}, m AS (SELECT call, substr(chain, length(root) + 2) AS rest, methods.* FROM chains JOIN methods ON starts_with(chain, root || '.')), "
    "f AS (SELECT *, CASE WHEN rest = key THEN 0 ELSE 1 END AS rank FROM m WHERE rest = key OR contains(key, '*') AND regexp_full_match(rest, replace(replace(replace(replace(key, '.', '\\.'), '**', '#'), '*', '[^.]+'), '#', '.+'))) "
    "SELECT call, arg_min(package, rank * 1000 + entry) AS package, arg_min(rest, rank * 1000 + entry) AS key, arg_min(provider, rank * 1000 + entry) AS provider, arg_min(method, rank * 1000 + entry) AS method, arg_min(path, rank * 1000 + entry) AS path FROM f GROUP BY call",
)
def join01_registry_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls of chains, nations as SDKs with exact and starred methods."""
    return callrows.match_registry(CHAINS.df(spark, sf_dir), METHODS.df(spark, sf_dir)).drop("host")


NAMES = Made("names", "SELECT DISTINCT 'c' || (o_custkey % 40) || '.' || o_orderstatus || '.k' || (o_orderkey % 5) || '.m' AS name FROM orders")
ROOTS = Made(
    "roots",
    "SELECT 'c' || n_nationkey AS root, n_name AS package, n_regionkey = 1 AS declared, n_nationkey = 7 AS own FROM nation UNION ALL SELECT 'c' || n_nationkey || '.O', n_name || '-o', n_regionkey = 2, false FROM nation UNION ALL SELECT 'c' || n_nationkey || '.F.k1', n_name || '-k', false, false FROM nation",
)


@query(
    "join02_roots_of_nations",
    f"WITH {NAMES.sql}, {ROOTS.sql} SELECT name, arg_max(package, length(root) + CASE WHEN declared THEN 1000 ELSE 0 END + CASE WHEN own THEN 1000 ELSE 0 END) AS package FROM names LEFT JOIN roots ON name = root OR starts_with(name, root || '.') GROUP BY name",
)
def join02_roots_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.longest_prefix(NAMES.df(spark, sf_dir), ROOTS.df(spark, sf_dir))


ITEMS = Made("items", "SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey || '.ts' AS path, 'K' || (c_custkey % 9) AS key FROM customer JOIN nation ON c_nationkey = n_nationkey")
SETTINGS = Made(
    "settings",
    "SELECT dir, key, min(value) AS value FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'r' || n_regionkey ELSE 'r' || n_regionkey || '/n' || n_nationkey END AS dir, 'K' || (s_suppkey % 7) AS key, s_name AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey) t GROUP BY dir, key",
)


@query(
    "join06_settings_of_suppliers",
    f"WITH {ITEMS.sql}, {SETTINGS.sql} SELECT path, items.key AS key, arg_max(value, length(dir)) AS value, arg_max(dir, length(dir)) AS dir FROM items LEFT JOIN settings ON items.key = settings.key AND (dir = '' OR starts_with(path, dir || '/')) GROUP BY 1, 2",
)
def join06_settings_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files in folders of regions and nations, suppliers' names as settings above them."""
    return joins.nearest_up(ITEMS.df(spark, sf_dir), SETTINGS.df(spark, sf_dir))


_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
NAMED = Made("named", f"SELECT DISTINCT {_HOST} AS host FROM pages")
CALLED = Made(
    "called",
    f"SELECT CASE WHEN page_id % 25 = 0 THEN upper({_HOST}) || ':443' WHEN page_id % 60 = 1 THEN '{{region}}.' || regexp_replace({_HOST}, '^[^.]+[.]', '') END AS host FROM pages",
)


@query(
    "join08_unexplained_page_hosts",
    f"WITH {NAMED.sql}, {CALLED.sql}, c AS (SELECT DISTINCT lower(regexp_replace(host, ':[0-9]+$', '')) AS t FROM called WHERE host IS NOT NULL) SELECT host FROM named WHERE NOT EXISTS (SELECT 1 FROM c WHERE t = host OR starts_with(t, '{{') AND ends_with(host, regexp_extract(t, '\\}}(.*)$', 1)))",
)
def join08_unexplained_page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of all pages; some pages call theirs, others a template of the domain above."""
    called = CALLED.df(spark, sf_dir)
    return joins.unexplained_hosts(NAMED.df(spark, sf_dir), called)


KNOWN = Made("known", "SELECT n_name AS package, 'p' || n_regionkey AS provider, n_nationkey % 2 = 0 AS supported FROM nation")
DECLARED = Made("declared", "SELECT n_name AS package FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 UNION ALL SELECT r_name FROM region")
USED = Made("used", "SELECT n_name AS package, 'f' || (c_custkey % 170) AS file FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3")
SDK_CALLS = Made("sdk_calls", "SELECT n_name AS package FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 2")
_COVERAGE = (
    f"{KNOWN.sql}, {DECLARED.sql}, {USED.sql}, {SDK_CALLS.sql}, s AS (SELECT package, count(DISTINCT file) AS n FROM used GROUP BY 1), c AS (SELECT package, count(*) AS n FROM sdk_calls GROUP BY 1), "
    "covered AS (SELECT k.package, provider, k.package IN (SELECT package FROM declared) AS declared, s.n IS NOT NULL AS imported, coalesce(s.n, 0) AS import_sites, coalesce(c.n, 0) AS calls, "
    "CASE WHEN s.n IS NULL THEN 'declared-not-imported' WHEN NOT supported THEN 'unsupported' WHEN c.n > 0 THEN 'ok' ELSE 'imported-no-calls' END AS status "
    "FROM known k LEFT JOIN s ON k.package = s.package LEFT JOIN c ON k.package = c.package WHERE s.n IS NOT NULL OR k.package IN (SELECT package FROM declared))"
)


@query("join10_coverage_of_nations", f"WITH {_COVERAGE} SELECT * FROM covered")
def join10_coverage_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as SDKs: suppliers declare them, customers import them, orders call them."""
    return joins.sdk_coverage(*[m.df(spark, sf_dir) for m in (KNOWN, DECLARED, USED, SDK_CALLS)])


@query(
    "out07_warnings_of_nations",
    f"WITH {_COVERAGE} SELECT package, package || ' imported in ' || import_sites || CASE WHEN import_sites = 1 THEN ' file' ELSE ' files' END || CASE status WHEN 'unsupported' THEN ', no registry: its calls are not listed' ELSE ', but no call was found (used through a wrapper?)' END AS text FROM covered WHERE status IN ('unsupported', 'imported-no-calls')",
)
def out07_warnings_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callrows.coverage_warnings(join10_coverage_of_nations(spark, sf_dir))


WRAPPED = Made("wrapped", "SELECT o_orderkey AS call, 'f' || o_custkey AS fn FROM orders")
INNER = Made(
    "inner_calls",
    "SELECT 'f' || c_custkey AS fn, 0 AS ord, 'f' || (c_custkey - c_custkey % 10) AS target, CAST(NULL AS STRING) AS request FROM customer UNION ALL SELECT 'f' || c_custkey, 1, 'f' || (c_custkey % 97), NULL FROM customer "
    "UNION ALL SELECT 'f' || c_custkey, 2, NULL, 'GET /' || c_mktsegment FROM customer WHERE c_nationkey % 3 = 0 UNION ALL SELECT 'f' || c_custkey, 3, NULL, 'POST /late' FROM customer",
)


@query(
    "join11_wrappers_of_customers",
    f"WITH RECURSIVE {WRAPPED.sql}, {INNER.sql}, i AS (SELECT * FROM inner_calls QUALIFY row_number() OVER (PARTITION BY fn ORDER BY ord) <= 3), "
    "w(call, fn, path, hops) AS (SELECT call, fn, [fn], 1 FROM wrapped UNION ALL SELECT call, target, list_append(path, target), hops + 1 FROM w JOIN i USING (fn) WHERE target IS NOT NULL AND NOT list_contains(path, target) AND hops < 4) "
    "SELECT call, request, min(hops) AS hops FROM w JOIN i USING (fn) WHERE request IS NOT NULL GROUP BY 1, 2",
)
def join11_wrappers_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call functions named by customers, which call others before they send requests."""
    return joins.expand_wrappers(WRAPPED.df(spark, sf_dir), INNER.df(spark, sf_dir))


USES = Made("uses", "SELECT o_orderkey AS use, 'f' || o_custkey AS fn, 'p' || (o_orderkey % 2) AS param, 'k' || (o_orderkey % 40) AS key, 'r' || (o_custkey % 5) AS repo FROM orders")
PASSED = Made("passed", "SELECT 'f' || o_custkey AS fn, 'p' || (l_orderkey % 2) AS param, l_orderkey * 1000000000 + l_partkey * 1000 + l_suppkey AS ord, CASE WHEN l_partkey % 9 = 0 THEN 'c' || (l_suppkey % 6) END AS client FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
KEYS = Made("sdk_keys", "SELECT 'r' || (s_suppkey % 5) AS repo, 'k' || (s_suppkey % 60) AS key, s_name AS package FROM supplier UNION ALL SELECT 'r0', 'k5', r_name FROM region")


@query(
    "join12_clients_of_lines",
    f"WITH {USES.sql}, {PASSED.sql}, {KEYS.sql}, fifty AS (SELECT * FROM passed QUALIFY row_number() OVER (PARTITION BY fn, param ORDER BY ord) <= 50), p AS (SELECT fn, param, client, row_number() OVER (PARTITION BY fn, param ORDER BY min(ord)) AS k FROM fifty WHERE client IS NOT NULL GROUP BY 1, 2, 3), a AS (SELECT use, client, 'caller' AS source FROM uses JOIN p USING (fn, param) WHERE k <= 4), "
    "s AS (SELECT repo, key, min(package) AS client FROM sdk_keys GROUP BY 1, 2 HAVING count(DISTINCT package) = 1) SELECT * FROM a UNION ALL SELECT use, client, 'manifest' FROM uses JOIN s USING (repo, key) WHERE use NOT IN (SELECT use FROM a)",
)
def join12_clients_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callrows.receivers(USES.df(spark, sf_dir), PASSED.df(spark, sf_dir), KEYS.df(spark, sf_dir))


SETUPS = Made("setups", "SELECT 'r' || (o_custkey * 7 % 5000) AS repo, o_orderstatus AS value FROM orders")


@query("join14_setups_of_orders", f"WITH {SETUPS.sql} SELECT repo, min(value) AS value FROM setups GROUP BY 1 HAVING count(*) = 1")
def join14_setups_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callrows.single_setup(SETUPS.df(spark, sf_dir))


IMPORTED = Made("imported", "SELECT n_name AS package, 'f' || (c_custkey % 170) AS file FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2")
MADE = Made("made", "SELECT n_name AS package FROM supplier JOIN nation ON s_nationkey = n_nationkey")
ALIASES = Made("aliases", "SELECT a.n_name AS package, b.n_name AS alias FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 3) % 25 OR b.n_nationkey = (a.n_nationkey + 9) % 25")
STATED = Made("stated", "SELECT n_name AS package FROM nation WHERE n_nationkey % 3 <> 0")


@query(
    "agg07_imports_of_nations",
    f"WITH {IMPORTED.sql}, {MADE.sql}, {ALIASES.sql}, {STATED.sql}, s AS (SELECT package, count(DISTINCT file) AS import_sites FROM imported GROUP BY 1), "
    "c AS (SELECT package, count(*) AS calls FROM (SELECT package FROM made UNION ALL SELECT alias FROM made JOIN aliases USING (package) WHERE package NOT IN (SELECT package FROM stated) AND alias IN (SELECT package FROM stated)) GROUP BY 1) "
    "SELECT coalesce(s.package, c.package) AS package, coalesce(import_sites, 0) AS import_sites, coalesce(calls, 0) AS calls FROM s FULL JOIN c ON s.package = c.package",
)
def agg07_imports_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callrows.import_sites(*[m.df(spark, sf_dir) for m in (IMPORTED, MADE, ALIASES, STATED)])


MATCHES = Made(
    "matches",
    "SELECT 'n' || c_nationkey AS repo, CAST(o_orderkey % 100 AS INT) AS entry_line, CASE o_orderkey % 5 WHEN 0 THEN 'third-party' WHEN 1 THEN 'own' WHEN 2 THEN 'external' ELSE '' END AS kind, "
    "CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'N' || c_nationkey WHEN 2 THEN 'Backend' ELSE c_mktsegment END AS service, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 100 + o_custkey % 3 AS INT) END AS call_line, "
    "CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_custkey % 4 = 0 THEN 'internal' WHEN o_custkey % 4 = 1 THEN 'unknown' WHEN o_custkey % 4 = 2 THEN 'env:URL' ELSE 'stripe' END AS provider, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 6 = 0 END AS via FROM orders JOIN customer ON o_custkey = c_custkey",
)


@query(
    "agg12_totals_of_orders",
    f"WITH {MATCHES.sql}, m AS (SELECT *, call_line IS NOT NULL AS hit, CASE WHEN provider IN ('internal', 'unknown') THEN provider WHEN starts_with(provider, 'env:') THEN 'env' ELSE 'resolved' END AS cls, "
    "CASE WHEN kind IN ('third-party', 'external') THEN 'third' WHEN kind = 'own' THEN 'own' WHEN coalesce(service, '') = '' THEN 'silent' WHEN lower(service) IN ('internal', 'first-party', 'own', 'self', 'backend', lower(repo)) THEN 'own' ELSE 'third' END AS says FROM matches), "
    "t AS (SELECT *, hit AND (says = 'third' OR says = 'silent' AND cls <> 'internal') AS third FROM m) "
    "SELECT repo, count(*) AS entries, count(*) FILTER (hit) AS matched, count(*) FILTER (call_line = entry_line) AS same_line, count(*) FILTER (via) AS through_wrapper, count(*) FILTER (hit AND cls = 'resolved') AS resolved, count(*) FILTER (hit AND cls = 'internal') AS internal, "
    "count(*) FILTER (hit AND cls = 'unknown') AS unknown, count(*) FILTER (hit AND cls = 'env') AS env, count(*) FILTER (third AND says = 'third') AS third_by_inventory, count(*) FILTER (third AND says = 'silent') AS third_by_report, count(*) FILTER (third AND cls IN ('unknown', 'env')) AS third_unresolved FROM t GROUP BY ROLLUP (repo)",
)
def agg12_totals_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callrows.evaluation_totals(MATCHES.df(spark, sf_dir))


GIVEN = Made("given", "SELECT l_orderkey AS call, CASE l_linenumber % 4 WHEN 0 THEN 'X-Mode' WHEN 1 THEN 'Accept' WHEN 2 THEN 'x-mode' ELSE 'Authorization' END AS header, l_partkey * 100000 + l_suppkey AS ord, CASE WHEN l_returnflag <> 'R' THEN l_linestatus || (l_suppkey % 3) END AS value FROM lineitem")


@query(
    "res16_headers_of_lines",
    f"WITH {GIVEN.sql}, v AS (SELECT call, lower(header) AS header, ord, CASE WHEN lower(header) <> 'authorization' THEN value END AS value FROM given), o AS (SELECT call, header, value, min(ord) AS ord FROM v GROUP BY 1, 2, 3), "
    "a AS (SELECT call, header, bool_or(value IS NULL) AS unread, coalesce(list(value ORDER BY ord, value) FILTER (value IS NOT NULL), []) AS known FROM o GROUP BY 1, 2) SELECT call, header, CASE WHEN NOT unread THEN known[1] END AS value, CASE WHEN length(known) > 1 OR unread AND length(known) > 0 THEN array_to_string(known, ',') END AS alternatives FROM a",
)
def res16_headers_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callrows.header_values(GIVEN.df(spark, sf_dir)).withColumn("alternatives", F.when(F.col("alternatives").isNotNull(), F.array_join("alternatives", ",")))


PARAM_CALLS = Made("param_calls", "SELECT 'p' || o_custkey AS param, o_orderkey AS ord, o_orderstatus <> 'P' AS given, o_orderkey % 13 = 0 AS spread, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 4 <> 0 THEN o_orderpriority END AS value FROM orders")
DEFAULTS = Made("defaults", "SELECT 'p' || c_custkey AS param, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS value FROM customer")


@query(
    "res25_params_of_orders",
    f"WITH {PARAM_CALLS.sql}, {DEFAULTS.sql}, r AS (SELECT *, row_number() OVER (PARTITION BY param ORDER BY ord) AS k, count(*) OVER (PARTITION BY param) AS n FROM param_calls), t AS (SELECT param, string_agg(value, ',' ORDER BY ord) FILTER (given) AS told, bool_or(NOT given AND spread) OR max(n) > 20 AS unread, bool_or(NOT given AND NOT spread) AS omitted FROM r WHERE k <= 20 GROUP BY 1), "
    "j AS (SELECT coalesce(t.param, d.param) AS param, CASE WHEN coalesce(omitted, true) THEN d.value END AS first, told, coalesce(unread, false) AS unread FROM t FULL JOIN defaults d ON t.param = d.param) SELECT param, coalesce(concat_ws(',', first, told), '') AS found, unread FROM j WHERE first IS NOT NULL OR told IS NOT NULL OR unread",
)
def res25_params_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callrows.param_values(PARAM_CALLS.df(spark, sf_dir), DEFAULTS.df(spark, sf_dir)).withColumn("found", F.array_join("found", ","))


ENV_CALLS = Made("env_calls", "SELECT c_custkey AS id, 'URL_' || (c_custkey % 400) AS env_name FROM customer")
HINTS = Made("hints", "SELECT 'URL_' || page_id AS env_name, url AS value FROM pages")


@query(
    "res27_hints_of_pages",
    f"WITH {ENV_CALLS.sql}, {HINTS.sql} SELECT id, lower(nullif(regexp_extract(value, '(?i)^https?://(?:[^/?#@]*@)?([^/?#]+)', 1), '')) AS hint_host, CASE WHEN regexp_matches(value, '(?i)^https?://') THEN regexp_replace(regexp_extract(value, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/$', '') END AS hint_path, lower(nullif(regexp_extract(value, '(?i)^(https?)://', 1), '')) AS hint_scheme FROM env_calls LEFT JOIN hints USING (env_name)",
)
def res27_hints_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages as example values of variables."""
    return callrows.with_env_hints(ENV_CALLS.df(spark, sf_dir), HINTS.df(spark, sf_dir)).drop("env_name")


CALL_SITES = Made(
    "call_sites",
    "SELECT o_orderkey AS site, CASE o_orderkey % 5 WHEN 0 THEN 'import' WHEN 1 THEN 'field' ELSE 'param' END AS root_kind, CASE o_custkey % 4 WHEN 0 THEN 'fetchImpl' WHEN 1 THEN 'cache' WHEN 2 THEN 'http' ELSE 'deps' END AS root, "
    "CASE o_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'get' WHEN 2 THEN 'post' WHEN 3 THEN 'render' WHEN 4 THEN 'doRequest' WHEN 5 THEN 'head' ELSE 'send' END AS verb, CASE o_orderkey % 3 WHEN 0 THEN 'https://a.io' WHEN 1 THEN 'text' END AS first_text, "
    "CASE o_orderkey % 4 WHEN 0 THEN 'baseUrl' WHEN 1 THEN 'name' END AS first_name FROM orders",
)
DETECTED = Made("detected", "SELECT l_orderkey AS site FROM lineitem WHERE l_returnflag = 'A'")


@query(
    "det27_sites_of_orders",
    f"WITH {CALL_SITES.sql}, {DETECTED.sql}, l AS (SELECT *, coalesce(regexp_matches(first_text, '^(?:(?:https?:)?//|/)'), false) AS literal, coalesce(regexp_matches(first_name, '(?i)url|uri|href|endpoint|path|link|route'), false) AS named FROM call_sites WHERE root_kind IN ('param', 'field') AND site NOT IN (SELECT site FROM detected)), "
    "r AS (SELECT site, CASE WHEN verb IS NULL THEN CASE WHEN regexp_matches(root, '(?i)fetch|request|http') THEN 'injected-fetch' END WHEN verb NOT IN ('post', 'put', 'patch', 'delete', 'request', 'send', 'get', 'head', 'options', 'stream') THEN CASE WHEN regexp_matches(verb, '(?i)fetch|request|http') THEN 'injected-fetch' END "
    "WHEN verb IN ('post', 'put', 'patch', 'delete', 'request', 'send') OR literal THEN 'injected-client' END AS reason FROM l WHERE literal OR named) SELECT * FROM r WHERE reason IS NOT NULL",
)
def det27_sites_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callrows.unfollowed(CALL_SITES.df(spark, sf_dir), DETECTED.df(spark, sf_dir))


MODEL_CALLS = Made("model_calls", "SELECT min(l_partkey * 100000 + l_suppkey) AS ord, 'r' || l_orderkey AS request, CASE WHEN l_partkey % 4 <> 0 THEN 'm' || (l_suppkey % 5) END AS model FROM lineitem GROUP BY 2, 3")


@query(
    "win03_models_of_lines",
    f"WITH {MODEL_CALLS.sql}, f AS (SELECT request, string_agg(model, ',' ORDER BY ord, model) AS models FROM model_calls WHERE model IS NOT NULL GROUP BY 1) SELECT min(c.ord) AS ord, c.request, coalesce(any_value(f.models), '') AS models FROM model_calls c LEFT JOIN f ON f.request = c.request GROUP BY c.request",
)
def win03_models_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.merge_models(MODEL_CALLS.df(spark, sf_dir)).withColumn("models", F.array_join("models", ","))


HOST_CALLS = Made("host_calls", "SELECT DISTINCT l_orderkey - l_orderkey % 8 AS raw_id, 'h' || l_suppkey AS host, min(l_partkey * 100000 + l_suppkey) AS ord FROM lineitem GROUP BY 1, 2")


@query(
    "win03_host_tables",
    f"WITH {HOST_CALLS.sql}, d AS (SELECT *, count(*) OVER (PARTITION BY raw_id) AS hosts, row_number() OVER (PARTITION BY raw_id ORDER BY ord) AS k FROM host_calls) "
    "SELECT raw_id, host, ord, hosts >= 2 AND hosts <= 20 AS candidate, hosts > 20 AS limited FROM d WHERE hosts <= 20 OR k = 1",
)
def win03_host_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host tables of neighbouring orders' suppliers; twenty hosts are the most that are listed."""
    return requests.candidates(HOST_CALLS.df(spark, sf_dir))


HOSTS = Made(
    "made_hosts",
    "SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'localhost:11434' WHEN 1 THEN '127.0.0.1:' || (8180 + c_nationkey) WHEN 2 THEN 'x' || c_custkey || '.local' WHEN 3 THEN '[::1]:80' WHEN 4 THEN 'api' || c_custkey || '.io' WHEN 5 THEN '{x}.Vendor' || c_custkey || '.com:443' WHEN 6 THEN 'a.{y}' ELSE 'localhost.' || c_mktsegment || '.com' END AS host FROM customer",
)


@query(
    "fn03_hosts_of_customers",
    f"WITH {HOSTS.sql}, n AS (SELECT id, host, CASE WHEN regexp_matches(host, '^\\[[^\\]]+\\]') THEN regexp_extract(host, '^\\[([^\\]]+)\\]', 1) ELSE split_part(lower(host), ':', 1) END AS name FROM made_hosts), l AS (SELECT id, host, name IN ('localhost', '127.0.0.1', '0.0.0.0', '::1') OR ends_with(name, '.local') OR ends_with(name, '.localhost') AS local FROM n) "
    "SELECT id, local, CASE WHEN local AND ends_with(host, ':11434') THEN 'ollama' WHEN local AND ends_with(host, ':8188') THEN 'comfyui' END AS service, nullif(regexp_extract(regexp_replace(lower(host), ':[0-9]+$', ''), '\\}\\.([a-z0-9_-]+(?:\\.[a-z0-9_-]+)+)$', 1), '') AS vendor FROM l",
)
def fn03_hosts_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local hosts, their services, and the vendors of templated ones."""
    h = F.col("host")
    return HOSTS.df(spark, sf_dir).select("id", hosts.is_localhost(h).alias("local"), hosts.local_service(h).alias("service"), hosts.vendor_domain(h).alias("vendor"))


SCRIPTS = Made("scripts", "SELECT 'src/p' || page_id || '.js' AS path, url, page_id FROM pages")


@query(
    "low09_scripts_of_pages",
    f"WITH {SCRIPTS.sql} SELECT path, 2 AS line, 'fetch' AS client, 'GET' AS method, url FROM scripts UNION ALL SELECT path, 3, 'axios', 'POST', url FROM scripts WHERE page_id % 3 = 0 UNION ALL SELECT path, 5, 'fetch', 'PUT', 'https://api.acme.io/v1/' || page_id FROM scripts",
)
def low09_scripts_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for every page that fetches its URL, posts to it, and builds one from constants."""
    made = SCRIPTS.df(spark, sf_dir)
    post = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('axios.post("'), "url", F.lit('", { a: 1 });\n'))).otherwise("\n")
    body = F.concat(
        F.lit('import axios from "axios";\nfetch("'), "url", F.lit('");\n'), post, F.lit('const BASE = "https://api.acme.io";\nfetch(`${BASE}/v1/'), F.col("page_id").cast("string"), F.lit('`, { method: "PUT" });\n')
    )
    return javascript.javascript_calls(made.select("path", body.alias("body"))).select("path", "line", "client", "method", "url")


EXAMPLE_KEYS = Made(
    "example_keys",
    "SELECT 's' || o_orderkey AS seed, CASE o_orderkey % 9 WHEN 0 THEN 'currency' WHEN 1 THEN 'apiKey' WHEN 2 THEN 'model' WHEN 3 THEN 'country_code' WHEN 4 THEN 'status' WHEN 5 THEN 'access_token' WHEN 6 THEN 'active' WHEN 7 THEN 'zzz' ELSE 'cardNumber' END AS key, CASE WHEN o_orderkey % 9 = 6 THEN 'boolean' WHEN o_custkey % 5 = 0 THEN 'number' ELSE 'string' END AS kind FROM orders",
)


@query(
    "fn20_names_of_orders",
    f"WITH {EXAMPLE_KEYS.sql} SELECT seed, key, kind, CASE WHEN kind = 'string' THEN CASE key WHEN 'currency' THEN 'usd' WHEN 'apiKey' THEN '<apiKey>' WHEN 'model' THEN 'gpt-4o' WHEN 'country_code' THEN 'US' WHEN 'status' THEN 'active' WHEN 'access_token' THEN '<access_token>' WHEN 'cardNumber' THEN '4242424242424242' END END AS value FROM example_keys",
)
def fn20_names_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that settle a value without a draw."""
    return examples.named_values(EXAMPLE_KEYS.df(spark, sf_dir))


SAID = Made("said_methods", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'GET' END AS implied, CASE o_orderkey % 4 WHEN 0 THEN 'post' WHEN 1 THEN '{method}' WHEN 2 THEN o_orderpriority END AS said FROM orders")


@query("res14_methods_of_orders", f"WITH {SAID.sql} SELECT id, coalesce(implied, CASE WHEN said NOT LIKE '%{{%' THEN upper(said) END, 'DYNAMIC') AS method FROM said_methods")
def res14_methods_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SAID.df(spark, sf_dir).select("id", facts.method(F.col("implied"), F.col("said")).alias("method"))


PARTS = Made("made_parts", "SELECT l_orderkey AS id, l_partkey * 100000 + l_suppkey AS ord, min(CASE l_linenumber % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'env' ELSE CASE WHEN l_orderkey % 5 = 0 THEN 'static' ELSE 'dynamic' END END) AS kind, 't' || l_partkey AS text FROM lineitem GROUP BY 1, 2, 4")


@query("res08_templates_of_lines", f"WITH {PARTS.sql} SELECT id, string_agg(CASE kind WHEN 'static' THEN text WHEN 'env' THEN '{{env:' || text || '}}' ELSE '{{' || text || '}}' END, '' ORDER BY ord) AS template, CASE WHEN bool_and(kind = 'static') THEN string_agg(text, '' ORDER BY ord) END AS static FROM made_parts GROUP BY id")
def res08_templates_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.templates(PARTS.df(spark, sf_dir))


BRANCHES = Made(
    "made_branches",
    "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'https://a.io/' || o_custkey WHEN 1 THEN '{x}/p' WHEN 2 THEN '{env:BASE}/p' WHEN 3 THEN '{a}' ELSE 'https://{h}/x' END AS a, CASE o_custkey % 4 WHEN 0 THEN 'https://b.io/' || o_orderkey WHEN 1 THEN '/q' WHEN 2 THEN '{env:B}/q' ELSE '{b}' END AS b FROM orders",
)


@query(
    "res07_branches_of_orders",
    f"WITH {BRANCHES.sql} SELECT id, CASE WHEN NOT contains(a, '{{') AND NOT contains(b, '{{') THEN a WHEN regexp_matches(a, '^[a-z]+://[^{{/]') THEN a WHEN regexp_matches(b, '^[a-z]+://[^{{/]') THEN b WHEN starts_with(a, '{{env:') THEN a WHEN starts_with(b, '{{env:') THEN b END AS picked FROM made_branches",
)
def res07_branches_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BRANCHES.df(spark, sf_dir).select("id", facts.pick_branch(F.col("a"), F.col("b")).alias("picked"))


FORMS = Made("made_forms", "SELECT event_id AS id, 'a=' || event_id || '&' || event_type || '={x}&=lost&b' || (event_id % 3) || '&a=2&' || event_type || '=4=5' AS body FROM events")


@query(
    "res22_forms_of_events",
    f"WITH {FORMS.sql}, p AS (SELECT id, unnest(string_split(body, '&')) AS pair, unnest(range(len(string_split(body, '&')))) AS i FROM made_forms), k AS (SELECT id, split_part(pair, '=', 1) AS name, min(i) AS i FROM p WHERE pair <> '' AND NOT starts_with(pair, '=') GROUP BY 1, 2) "
    "SELECT k.id, any_value(s.static) AS static, string_agg(name, ',' ORDER BY i) AS keys FROM k JOIN (SELECT id, coalesce(string_agg(pair, ',' ORDER BY i) FILTER (contains(pair, '=') AND NOT contains(pair, '{') AND NOT starts_with(pair, '=')), '') AS static FROM p GROUP BY id) s ON s.id = k.id GROUP BY k.id",
)
def res22_forms_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FORMS.df(spark, sf_dir).select("id", F.array_join(facts.form_keys(F.col("body")), ",").alias("keys"), F.array_join(facts.form_static(F.col("body")), ",").alias("static"))


READS = Made("made_reads", "SELECT o_orderkey AS call, 't' || (o_custkey % 5) AS table, CASE WHEN o_orderkey % 3 <> 0 THEN 'n' || (o_custkey % 30) END AS key FROM orders")
ENTRIES = Made("made_entries", "SELECT 't' || n_regionkey AS table, 'n' || n_nationkey AS name, n_name || '.io' AS host FROM nation")


@query("res26_tables_of_nations", f"WITH {READS.sql}, {ENTRIES.sql} SELECT call, host FROM made_reads r JOIN made_entries e ON r.table = e.table AND (key IS NULL OR key = name)")
def res26_tables_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as tables of their nations' hosts, read by orders with a known or an unknown key."""
    return facts.table_reads(READS.df(spark, sf_dir), ENTRIES.df(spark, sf_dir))


POINTS = Made("made_points", "SELECT o_orderkey AS id, 'T' || (o_custkey % 120) AS type, CASE WHEN o_orderkey % 2 = 0 THEN 'q' || (o_orderkey % 7) END AS qualifier FROM orders")
PROVIDED = Made("made_provided", "SELECT 'T' || (s_suppkey % 70) AS type, 'q' || (s_suppkey % 7) AS qualifier, s_name AS value FROM supplier UNION ALL SELECT 'T' || (n_nationkey + 60), NULL, n_name FROM nation")


@query("res30_injection_of_suppliers", f"WITH {POINTS.sql}, {PROVIDED.sql} SELECT id, min(value) AS value FROM made_points p JOIN made_provided v ON p.type = v.type AND (p.qualifier IS NULL OR p.qualifier = v.qualifier) GROUP BY id HAVING count(*) = 1")
def res30_injection_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.injected(POINTS.df(spark, sf_dir), PROVIDED.df(spark, sf_dir))


MODELS = Made(
    "made_models",
    "SELECT l_orderkey AS call, l_partkey * 100000 + l_suppkey AS ord, CASE WHEN l_partkey % 5 <> 0 THEN 'm' || (l_suppkey % 4) END AS value, min(CASE l_returnflag WHEN 'A' THEN 'literal' WHEN 'R' THEN 'env' ELSE 'param' END) AS origin, max(l_linestatus) = 'O' AS dynamic FROM lineitem GROUP BY 1, 2, 3",
)


@query(
    "agg10_models_of_lines",
    f"WITH {MODELS.sql}, f AS (SELECT call, value, min(ord) AS ord FROM made_models WHERE value IS NOT NULL GROUP BY 1, 2), n AS (SELECT call, string_agg(value, ',' ORDER BY ord) AS names FROM f GROUP BY 1), "
    "s AS (SELECT call, origin, row_number() OVER (PARTITION BY call ORDER BY origin <> 'literal', ord) AS k, bool_or(dynamic) OVER (PARTITION BY call) AS dynamic FROM made_models) SELECT s.call, coalesce(names, '') AS model_values, origin AS source, dynamic FROM s LEFT JOIN n ON n.call = s.call WHERE k = 1",
)
def agg10_models_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.model_facts(MODELS.df(spark, sf_dir)).select("call", F.array_join("values", ",").alias("model_values"), "source", "dynamic")


FOUND = Made("made_found", "SELECT DISTINCT l_orderkey AS call, l_suppkey AS detector, 'c' || l_suppkey AS client FROM lineitem")


@query("det03_detectors_of_lines", f"WITH {FOUND.sql} SELECT call, arg_min(client, detector) AS client FROM made_found GROUP BY call")
def det03_detectors_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.first_detector(FOUND.df(spark, sf_dir))


CLIENTS = Made("made_clients", "SELECT 'r' || o_custkey AS repo, 'apollo' AS client, 'https://e' || (o_orderkey * o_custkey % 3) || '.io' AS endpoint FROM orders")


@query("det09_endpoints_of_orders", f"WITH {CLIENTS.sql} SELECT repo, min(endpoint) AS endpoint FROM made_clients GROUP BY repo HAVING count(DISTINCT endpoint) = 1")
def det09_endpoints_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.agreed(CLIENTS.df(spark, sf_dir), "repo", "endpoint")


OPS = Made("made_ops", "SELECT o_orderkey AS call, CASE WHEN o_orderkey % 2 = 0 THEN 'm' || o_custkey END AS rpc, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS graphql, CASE WHEN o_orderkey % 5 = 0 THEN 's' END AS soap, CASE WHEN o_orderkey % 7 = 0 THEN 'Describe' END AS action, o_custkey % 4 = 0 AS sdk FROM orders")


@query("opn01_dispatch_of_orders", f"WITH {OPS.sql} SELECT call, coalesce(rpc, graphql, soap, action) AS name, CASE WHEN rpc IS NOT NULL THEN 'json-rpc' WHEN graphql IS NOT NULL THEN 'graphql' WHEN soap IS NOT NULL THEN 'soap' ELSE 'action' END AS protocol FROM made_ops WHERE NOT sdk AND coalesce(rpc, graphql, soap, action) IS NOT NULL")
def opn01_dispatch_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.dispatch(OPS.df(spark, sf_dir))


PACKAGES = Made("made_packages", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'pypi' WHEN 1 THEN 'crates' WHEN 2 THEN 'go' ELSE 'maven' END AS ecosystem, p_brand || '_.-' || p_type AS name FROM part")


@query("fn15_packages_of_parts", f"WITH {PACKAGES.sql} SELECT id, CASE ecosystem WHEN 'pypi' THEN regexp_replace(lower(name), '[-_.]+', '-', 'g') WHEN 'crates' THEN replace(lower(name), '_', '-') WHEN 'go' THEN name ELSE lower(name) END AS normal FROM made_packages")
def fn15_packages_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PACKAGES.df(spark, sf_dir).select("id", text.normalise_package(F.col("ecosystem"), F.col("name")).alias("normal"))


CASED = Made("made_cased", "SELECT p_partkey AS id, lower(p_brand) || p_name || CASE WHEN p_size % 2 = 0 THEN 'URLId' ELSE 'a1B' END AS k FROM part")


@query("fn23_keys_of_parts", f"WITH {CASED.sql} SELECT id, lower(regexp_replace(k, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS wire FROM made_cased")
def fn23_keys_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CASED.df(spark, sf_dir).select("id", text.snake_case(F.col("k")).alias("wire"))


FILLS = Made("made_fills", "SELECT o_orderkey AS id, '/v1/{a}/x/{b}/{c}' AS path, CASE WHEN o_custkey % 2 = 0 THEN 'a,b' ELSE 'z,c' END AS ks, o_orderkey || ',' || o_orderstatus AS vs FROM orders")


@query("fn24_templates_of_orders", f"WITH {FILLS.sql} SELECT id, replace(replace(path, '{{' || split_part(ks, ',', 1) || '}}', split_part(vs, ',', 1)), '{{' || split_part(ks, ',', 2) || '}}', split_part(vs, ',', 2)) AS filled FROM made_fills")
def fn24_templates_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FILLS.df(spark, sf_dir).select("id", facts.fill_template(F.col("path"), F.split("ks", ","), F.split("vs", ",")).alias("filled"))


PATHS = Made("made_paths", "SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '//x//{env:T}/' WHEN 2 THEN regexp_replace(url, '^[A-Za-z]+://', '') || '/' ELSE '' END AS p FROM pages")


@query(
    "res12_paths_of_pages",
    f"WITH {PATHS.sql}, a AS (SELECT id, regexp_replace(regexp_replace(p, '\\{{env:([^}}]+)\\}}', '{{\\1}}', 'g'), '/+', '/', 'g') AS q FROM made_paths), b AS (SELECT id, CASE WHEN starts_with(q, '/') THEN q ELSE '/' || q END AS q FROM a) "
    "SELECT id, CASE WHEN length(q) > 1 AND ends_with(q, '/') THEN left(q, length(q) - 1) ELSE q END AS path FROM b",
)
def res12_paths_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PATHS.df(spark, sf_dir).select("id", urls.canonical_path(F.col("p")).alias("path"))


JOINED = Made("made_joins", "SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN url ELSE url || '/' END AS base, CASE page_id % 5 WHEN 0 THEN 'v1/x' WHEN 1 THEN '/v1' WHEN 2 THEN '?q=1' WHEN 3 THEN 'https://b.io/z' ELSE '' END AS p FROM pages")


@query("res10_bases_of_pages", f"WITH {JOINED.sql} SELECT id, CASE WHEN regexp_matches(p, '^[a-z]+://') OR base = '' THEN p WHEN right(base, 1) <> '/' AND left(p, 1) NOT IN ('/', '?', '') THEN base || '/' || p ELSE base || p END AS url FROM made_joins")
def res10_bases_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JOINED.df(spark, sf_dir).select("id", urls.join_url(F.col("base"), F.col("p")).alias("url"))


HOLED = Made("made_holes", "SELECT c_custkey AS id, '/{a' || c_nationkey || '}/x{env:' || c_mktsegment || '}/{}/}{b' AS template FROM customer")


@query("res13_placeholders_of_customers", f"WITH {HOLED.sql} SELECT id, array_to_string(regexp_extract_all(template, '\\{{([^}}]+)\\}}', 1), ',') AS names FROM made_holes")
def res13_placeholders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HOLED.df(spark, sf_dir).select("id", F.array_join(urls.placeholders(F.col("template")), ",").alias("names"))


SHAPED = Made(
    "made_shapes",
    "SELECT DISTINCT l_suppkey AS id, l_orderkey AS alt, '$.f' || (l_partkey % 9) AS path, CASE l_linenumber % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN 'null' ELSE 'string' END AS kind, CASE WHEN l_linenumber % 4 = 0 THEN l_returnflag END AS value FROM lineitem",
)


@query(
    "res20_unions_of_lines",
    f"WITH {SHAPED.sql}, n AS (SELECT id, count(DISTINCT alt) AS n FROM made_shapes GROUP BY id) SELECT s.id, path, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (kind <> 'null'), '') AS kinds, bool_or(kind = 'null') AS nullable, "
    "CASE WHEN bool_and(value IS NOT NULL OR kind = 'null') THEN string_agg(DISTINCT value, ',' ORDER BY value) END AS enum, count(DISTINCT alt) = any_value(n.n) AS required FROM made_shapes s JOIN n ON s.id = n.id GROUP BY s.id, path",
)
def res20_unions_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.union(SHAPED.df(spark, sf_dir)).withColumns({"kinds": F.array_join("kinds", ","), "enum": F.array_join("enum", ",")})


SOAP_CALLS = Made("soap_calls", "SELECT l_orderkey * 1000000000 + l_partkey * 1000 + l_suppkey AS call, 's' || l_suppkey AS client, min(CASE l_linenumber % 4 WHEN 0 THEN 'Op' || (l_partkey % 9) || 'Async' WHEN 1 THEN 'Op' || (l_partkey % 9) WHEN 2 THEN 'Svc.Port.Op' || (l_partkey % 9) ELSE 'setSecurity' END) AS chain FROM lineitem GROUP BY 1, 2")
SOAP_CLIENTS = Made("soap_clients", "SELECT 's' || s_suppkey AS client, 'n' || s_nationkey || '.wsdl' AS path, CASE WHEN s_suppkey % 3 = 0 THEN 'https://own.io/' || s_suppkey END AS endpoint FROM supplier")
SERVICES = Made("soap_services", "SELECT 'n' || n_nationkey || '.wsdl' AS path, 'Op' || r_regionkey AS operation, 'https://' || n_nationkey || '.io/svc' AS address FROM nation JOIN region ON n_nationkey % 4 <> r_regionkey")


@query(
    "det26_soap_clients_of_suppliers",
    f"WITH {SOAP_CALLS.sql}, {SOAP_CLIENTS.sql}, {SERVICES.sql}, o AS (SELECT call, client, regexp_replace(regexp_replace(chain, '^.*[.]', ''), 'Async$', '') AS operation FROM soap_calls WHERE chain <> 'setSecurity') "
    "SELECT call, operation, EXISTS (SELECT 1 FROM soap_services v WHERE v.path = c.path AND v.operation = o.operation) AS declared, coalesce(endpoint, (SELECT min(address) FROM soap_services v WHERE v.path = c.path)) AS url FROM o JOIN soap_clients c ON c.client = o.client",
)
def det26_soap_clients_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines call operations of suppliers' services, which nations describe."""
    return facts.soap_client_calls(*[m.df(spark, sf_dir) for m in (SOAP_CALLS, SOAP_CLIENTS, SERVICES)])


TOOLKIT = Made("toolkit_calls", "SELECT o_orderkey AS call, o_orderkey % 4 = 0 AS agent FROM orders")
PICKED = Made(
    "picked_models",
    "SELECT l_orderkey AS call, l_partkey * 100000 + l_suppkey AS ord, CASE WHEN max(l_suppkey) % 3 <> 0 THEN '@sdk/' || (max(l_suppkey) % 30) END AS package, CASE WHEN max(l_linenumber) % 2 = 0 THEN 'chat' ELSE 'other' END AS member, 'm' || (max(l_partkey) % 20) AS model FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2",
)
MODEL_ENTRIES = Made(
    "model_entries",
    "SELECT '@sdk/' || n_nationkey AS package, 'chat' AS member, n_name AS provider, n_nationkey || '.io' AS host, '/chat' AS path FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT '@sdk/' || n_nationkey, '', n_name, n_nationkey || '.io', '/v1' FROM nation UNION ALL SELECT '', '', r_name, 'gateway.io', '/v1/ai' FROM region WHERE r_regionkey = 0",
)


@query(
    "det06_models_of_lines",
    f"WITH {TOOLKIT.sql}, {PICKED.sql}, {MODEL_ENTRIES.sql}, k AS (SELECT t.call, agent, coalesce(ord, 0) AS ord, CASE WHEN m.call IS NOT NULL THEN coalesce(package, '') END AS key, member, model FROM toolkit_calls t LEFT JOIN picked_models m ON m.call = t.call) "
    "SELECT call, ord, CASE WHEN agent AND key = '' THEN 'llm-router' ELSE coalesce(x.provider, r.provider, 'unknown') END AS provider, CASE WHEN NOT (agent AND key IS NOT NULL AND key = '') THEN coalesce(x.host, r.host) END AS host, coalesce(x.path, r.path, '/') AS path, model "
    "FROM k LEFT JOIN model_entries x ON x.package = key AND x.member = k.member AND x.member <> '' LEFT JOIN model_entries r ON r.package = key AND r.member = ''",
)
def det06_models_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call an AI toolkit, their lines are the models it may pick, nations the packages that name them."""
    return facts.model_calls(*[m.df(spark, sf_dir) for m in (TOOLKIT, PICKED, MODEL_ENTRIES)])


SHOWN = Made("shown", "SELECT o_orderkey AS element, '@ui/' || (o_custkey % 30) AS package, CASE o_orderkey % 3 WHEN 0 THEN 'Upload' WHEN 1 THEN 'Map' ELSE 'Button' END AS name, o_orderpriority AS style, CAST(o_custkey AS STRING) AS place FROM orders")
COMPONENTS = Made("components", "SELECT '@ui/' || n_nationkey AS package, 'Upload' AS name, n_name AS provider, 'POST' AS method, '/up/{style}/{rest}' AS path FROM nation UNION ALL SELECT '@ui/' || n_nationkey, 'Map', n_name, 'GET', '/tiles/{place}' FROM nation WHERE n_regionkey < 3")


@query(
    "det08_components_of_orders",
    f"WITH {SHOWN.sql}, {COMPONENTS.sql} SELECT element, provider, method, replace(replace(path, '{{style}}', style), '{{place}}', place) AS path FROM shown JOIN components USING (package, name)",
)
def det08_components_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.create_map(F.lit("style"), F.col("style"), F.lit("place"), F.col("place"))
    return facts.component_calls(SHOWN.df(spark, sf_dir).select("element", "package", "name", props.alias("props")), COMPONENTS.df(spark, sf_dir))
