"""Queries over markup of all pages, declared types and facts in scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators import trees
from callscope.operators.tables import dealt
from callscope.plans.registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TAGS = r"""clean AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<script\b[^>]*>).*?(</script>)', '\1\2', 'g'), '(?is)(<style\b[^>]*>).*?(</style>)', '\1\2', 'g') AS h FROM pages),
listed AS (SELECT page_id, regexp_extract_all(h, '</?[A-Za-z_][\w:.-]*(?:[^<>"'']|"[^"]*"|''[^'']*'')*>') AS tags FROM clean),
tags AS (SELECT page_id, unnest(range(len(tags))) AS node, unnest(tags) AS tag FROM listed),
named AS (SELECT page_id, node, lower(regexp_extract(tag, '^</?([^\s/>]+)', 1)) AS name, CASE WHEN starts_with(tag, '</') THEN -1 WHEN ends_with(tag, '/>') THEN 0 ELSE 1 END AS turn FROM tags),
even AS (SELECT *, sum(turn) OVER (PARTITION BY page_id, name) = 0 AS even FROM named),
kept AS (SELECT page_id, node, name, CASE WHEN even THEN turn ELSE 0 END AS turn FROM even WHERE even OR turn >= 0),
deep AS (SELECT *, sum(turn) OVER (PARTITION BY page_id ORDER BY node)::INT + CASE WHEN turn = 1 THEN 0 ELSE 1 END AS depth FROM kept),
closed AS (SELECT c.page_id, c.name, arg_max(o.name, o.node) AS open_name FROM deep c LEFT JOIN deep o ON o.page_id = c.page_id AND o.turn = 1 AND o.depth = c.depth AND o.node < c.node WHERE c.turn = -1 GROUP BY c.page_id, c.node, c.name),
bad AS (SELECT DISTINCT page_id FROM closed WHERE open_name IS DISTINCT FROM name)"""


@query(
    "res23_element_trees",
    f"WITH {_TAGS} SELECT c.page_id, c.node, c.name, c.depth, max(o.node) AS parent, c.page_id NOT IN (SELECT page_id FROM bad) AS matched "
    "FROM deep c LEFT JOIN deep o ON o.page_id = c.page_id AND o.turn = 1 AND o.depth = c.depth - 1 AND o.node < c.node WHERE c.turn >= 0 GROUP BY c.page_id, c.node, c.name, c.depth",
)
def res23_element_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element tree of every page."""
    return trees.elements(_table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")


_FIELDS = """n AS (SELECT (SELECT max(p_partkey) FROM part) AS np, (SELECT max(s_suppkey) FROM supplier) AS ns),
fields AS (SELECT 'p' || p_partkey AS type, 'name' AS field, 'string' AS kind, NULL AS ref FROM part UNION ALL SELECT 'p' || p_partkey, 'size', 'integer', NULL FROM part
  UNION ALL SELECT 'p' || p_partkey, 'maker', 'object', 's' || (1 + p_partkey % ns) FROM part, n UNION ALL SELECT 'p' || p_partkey, 'of', 'object', 'p' || (p_partkey // 3) FROM part
  UNION ALL SELECT 's' || s_suppkey, 'name', 'string', NULL FROM supplier UNION ALL SELECT 's' || s_suppkey, 'best', 'object', 'p' || (1 + s_suppkey * 7 % np) FROM supplier, n)"""


@query(
    "res18_declared_types",
    f"WITH RECURSIVE {_FIELDS}, walk(type, path, kind, leaf, way, level) AS (SELECT type, field, kind, ref, [type], 1 FROM fields "
    "UNION ALL SELECT w.type, w.path || '.' || f.field, f.kind, f.ref, list_append(way, f.type), level + 1 FROM walk w JOIN fields f ON f.type = w.leaf WHERE level < 6 AND NOT list_contains(way, leaf)) "
    "SELECT type, path, CASE WHEN list_contains(way, leaf) THEN 'circle' WHEN leaf IS NOT NULL AND level >= 6 THEN 'deep' ELSE kind END AS kind, level FROM walk",
)
def res18_declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers declare types that refer to each other, in circles too."""
    parts, suppliers = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "supplier")
    np, ns = parts.agg(F.max("p_partkey")).first()[0], suppliers.agg(F.max("s_suppkey")).first()[0]
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    none = F.lit(None).cast("string")

    def field(rows: DataFrame, own: str, key: str, name: str, kind: str, ref=none) -> DataFrame:
        return rows.select(F.concat(F.lit(own), key).alias("type"), F.lit(name).alias("field"), F.lit(kind).alias("kind"), ref.alias("ref"))

    fields = (
        field(parts, "p", "p_partkey", "name", "string")
        .union(field(parts, "p", "p_partkey", "size", "integer"))
        .union(field(parts, "p", "p_partkey", "maker", "object", F.concat(F.lit("s"), p % ns + 1)))
        .union(field(parts, "p", "p_partkey", "of", "object", F.concat(F.lit("p"), F.expr("p_partkey div 3"))))
        .union(field(suppliers, "s", "s_suppkey", "name", "string"))
        .union(field(suppliers, "s", "s_suppkey", "best", "object", F.concat(F.lit("p"), s * 7 % np + 1)))
    )
    return trees.expand_types(fields)


@query(
    "det10_nearest_scope",
    "WITH facts AS (SELECT 'm' || (l_partkey % 50) AS name, l_returnflag AS value, l_orderkey AS file, o_custkey AS folder, c_nationkey AS repo FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), "
    "calls AS (SELECT o_orderkey AS call, 'm' || (o_orderkey % 50) AS name, o_orderkey AS file, o_custkey AS folder, c_nationkey AS repo FROM orders JOIN customer ON o_custkey = c_custkey), "
    "m AS (SELECT call, 0 AS rank, value FROM calls JOIN facts USING (name, file) UNION ALL SELECT call, 1, value FROM calls JOIN facts USING (name, folder) UNION ALL SELECT call, 2, value FROM calls JOIN facts USING (name, repo) UNION ALL SELECT call, 3, value FROM calls JOIN (SELECT DISTINCT name, value FROM facts) f USING (name)), "
    "s AS (SELECT call, rank, min(value) AS lo, max(value) AS hi FROM m GROUP BY 1, 2), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY call ORDER BY rank) = 1) "
    "SELECT call, ['file', 'folder', 'repo', 'all'][rank + 1] AS scope, CASE WHEN lo = hi THEN lo END AS value FROM calls LEFT JOIN b USING (call)",
)
def det10_nearest_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines say what methods are, in an order, by a customer of a nation; orders ask for one method each."""
    customers, orders = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    where = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("folder"), F.col("c_nationkey").alias("repo"))
    lines = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), F.col("l_partkey") % 50).alias("name"), F.col("l_returnflag").alias("value"), F.col("l_orderkey").alias("file"))
    calls = where.withColumns({"call": F.col("file"), "name": F.concat(F.lit("m"), F.col("file") % 50)})
    return trees.by_nearest_scope(calls, dealt(lines, "file").join(where, "file"))


@query(
    "det10_abi_methods",
    "SELECT DISTINCT 'abi/' || p_partkey || '.json' AS path, p_type AS method, p_size % 2 = 0 AS reads FROM part UNION SELECT DISTINCT 'abi/' || p_partkey || '.json', p_brand, false FROM part",
)
def det10_abi_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part makes a contract interface: a function by its type, one by its brand, and an event."""
    state = F.when(F.col("p_size") % 2 == 0, "view").otherwise("payable")
    entry = lambda kind, name, mutable: F.struct(F.lit(kind).alias("type"), name.alias("name"), mutable.alias("stateMutability"))
    body = F.to_json(F.array(entry("function", F.col("p_type"), state), entry("function", F.col("p_brand"), F.lit("nonpayable")), entry("event", F.col("p_name"), F.lit("view"))))
    return trees.abi_methods(_table(spark, sf_dir, "part").select(F.concat(F.lit("abi/"), "p_partkey", F.lit(".json")).alias("path"), body.alias("body")))
