"""Shards of near equal bytes by global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.llm.common import Scratch, materialize, named, others, running_totals, whole_row


def _shard(shards: int, size: Column, before: Column) -> Column:
    """Where the middle byte lies. Decimals, as bytes times shards can pass a long."""
    middle = (before * 2 + size).cast("decimal(38,0)") * F.lit(shards)
    return F.least(F.lit(shards - 1).cast("long"), F.call_function("div", middle, F.col("size_all").cast("decimal(38,0)") * 2)).cast("int")


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Documents are ordered by id (nulls first), then by text hash; sizes (UTF-8 bytes plus 1) are summed
    up over all of them and the line of bytes is cut at ``shards`` equal targets. A document goes
    where its middle byte lies, so each cut is off by half a document at most, however long it is,
    and shards are contiguous. ``slot`` counts from 0 in each shard. Repeated rows get neighbouring
    slots; an empty text has size 1 and checksum 0, a null text size 1 and no checksum (null); an
    empty table gives no rows. Ids are of any ordered type; other columns are not read. Only ids and
    sizes are moved, never texts.
    """
    text = named(text_col)
    sized = docs.select(named(id_col).alias("doc_id"), _size(text).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("tie"))
    placed = running_totals(sized, [F.col("doc_id"), F.col("tie"), F.col("size")], F.col("size"), "shards")
    cut = placed.withColumn("shard", _shard(shards, F.col("size"), F.col("size_before")))
    starts = cut.groupBy("shard").agg(F.min("row_before").alias("start"))
    return cut.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row_before") - F.col("start")).alias("slot"))  # a row for each shard


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot``, as :func:`shard_by_bytes` places them.

    Sums run over ids, sizes and text hashes; repeated rows are one for each part of the input that
    holds some, with their number, so a row that stands very often is numbered in as many tasks. The
    rows are written once with their part, then meet their group's offset. Nulls, empty and very long
    texts, ties, ids of any type and empty tables as there; columns named shard or slot are replaced,
    all others may have any names.
    """
    text, key = named(text_col), ["id", "tie", "part"]
    kept = docs.select(*[named(c) for c in others(docs.columns, ("shard", "slot"))])
    with Scratch(docs.sparkSession) as hold:
        rows = materialize(docs.select(whole_row(kept).alias("row"), named(id_col).alias("id"), F.xxhash64(text).alias("tie"), _size(text).alias("size"), F.spark_partition_id().alias("part")), "shard-rows")
        groups = hold(rows.groupBy(*key, "size").agg(F.count("*").alias("copies")), "shard-copies")
        placed = running_totals(groups, [F.col("id"), F.col("tie"), F.col("size"), F.col("part")], F.col("size") * F.col("copies"), "shard-groups", F.col("copies"))
        placed = materialize(placed, "shard-offsets")
    # Shards change a few times along the groups, so their first rows are found from the groups alone.
    first, last = _shard(shards, F.col("size"), F.col("size_before")), _shard(shards, F.col("size"), F.col("size_before") + (F.col("copies") - 1) * F.col("size"))
    whole = placed.filter(first == last).select(first.alias("shard"), F.col("row_before").alias("row"))
    split = placed.filter(first != last).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))  # groups that a cut goes through
    split = split.select(_shard(shards, F.col("size"), F.col("size_before") + F.col("k") * F.col("size")).alias("shard"), (F.col("row_before") + F.col("k")).alias("row"))
    starts = whole.union(split).groupBy("shard").agg(F.min("row").alias("start"))
    at = placed.select(*[F.col(c).alias(f"g_{c}") for c in key], "row_before", "size_before", "size_all", "copies")
    met = rows.join(at, rows["id"].eqNullSafe(at["g_id"]) & rows["tie"].eqNullSafe(at["g_tie"]) & (rows["part"] == at["g_part"]))
    single = met.filter("copies = 1").withColumn("k", F.lit(0).cast("long"))
    several = met.filter("copies > 1").withColumn("k", (F.row_number().over(Window.partitionBy(*key).orderBy("tie")) - 1).cast("long"))
    met = single.union(several).withColumn("shard", _shard(shards, F.col("size"), F.col("size_before") + F.col("k") * F.col("size")))
    return met.join(F.broadcast(starts), "shard").select("row.*", "shard", (F.col("row_before") + F.col("k") - F.col("start")).alias("slot"))  # a row for each shard


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` in 8 shards under the law ``bytes``. The checksum of a null text is null; ``grown_shard`` is null under this law."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_by_bytes(docs, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same law as one running sum; the checksum byte by byte, as SQL has none.
SQL = r"""
WITH tbl AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
sized AS (SELECT doc_id, text, hex(encode(text)) AS h, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size FROM documents),
line AS (SELECT *, row_number() OVER o - 1 AS place, coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM sized WINDOW o AS (ORDER BY doc_id NULLS FIRST)),
cut AS (SELECT *, least(7, (before * 2 + size) * 8 // (total * 2))::INT AS shard FROM line)
SELECT doc_id, size,
       CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(size - 1), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::UBIGINT)),
         lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT END AS text_crc32,
       'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM cut, tbl
"""
