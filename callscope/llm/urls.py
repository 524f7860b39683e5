"""URL filters by host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.common import lower_ascii, named, others

#: The rules of the query: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the URL is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", digits: int = 8) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``.

    Each distinct (host, path) is expanded into the host suffixes and path prefixes that some rule
    could have (the label counts and path lengths found among the rules), their SHA-256 digests meet
    the rules' digests on the first ``digits`` hex digits, and the full digest confirms. Of the rules
    that fit, the one with the longest host plus path wins; between equally long ones the longer
    host, then ``block``. No rule: ``rule`` is null and ``verdict`` is ``default``.

    Rows are never dropped: null and broken URLs have an empty host and path, repeated URLs are
    judged once and each row gets the result, very long URLs are hashed whole at the few lengths that
    rules have, an empty rule table leaves all at ``default``. Columns of ``pages`` named like the four
    results are replaced; all others may have any names.
    """
    host, path = url_parts(named(url_col))
    kept = others(pages.columns, ("host", "path", "rule", "verdict"))
    # Under numbers until the end, so that no column's name meets a working one.
    parted = pages.select(*[named(c).alias(f"_{i}") for i, c in enumerate(kept)], host.alias("host"), path.alias("path"))
    ruled = rules.select(
        F.coalesce(lower_ascii(F.col("host")), F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).withColumns({"rule": F.concat("r_host", "r_path"), "labels": F.size(F.split("r_host", r"\.")), "chars": F.length("r_path")})
    # Shapes of rules, not rules: at most the greatest label count and path length there are.
    shapes = ruled.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("chars")).alias("chars")).first()
    one_each = parted.select("host", "path").distinct()
    candidates = (
        one_each.withColumn("n", F.explode(F.array([F.lit(x) for x in shapes["labels"]]).cast("array<int>")))
        .filter(F.col("n") <= F.size(F.split("host", r"\.")))
        .withColumn("c", F.explode(F.array([F.lit(x) for x in shapes["chars"]]).cast("array<int>")))
        .filter(F.col("c") <= F.length("path"))
        .withColumn("digest", F.sha2(F.concat(F.expr("substring_index(host, '.', -n)"), F.expr("substring(path, 1, c)")), 256))
        .withColumn("short", F.substring("digest", 1, digits))
    )
    keyed = ruled.withColumn("r_digest", F.sha2("rule", 256)).withColumn("short", F.substring("r_digest", 1, digits))
    rank = F.struct(F.length("rule"), F.length("r_host"), (F.col("r_verdict") == "block"), F.col("rule"))
    best = (
        candidates.join(keyed, "short")
        .filter(F.col("digest") == F.col("r_digest"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", F.col("r_verdict").alias("verdict")), rank).alias("best"))
    )
    met = parted.join(best, ["host", "path"], "left")
    return met.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_VALUES}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, row_number() OVER () AS id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest),
fits AS (
  SELECT id, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY id ORDER BY length(r_host || r_path) DESC, length(r_host) DESC, r_verdict DESC) AS k
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.id = fits.id AND fits.k = 1
"""
