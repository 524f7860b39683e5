"""What the corpus operators share: names, batches, global order; written tables come from the library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.operators.tables import Scratch, dropped_shuffles, materialize, shared_dir

__all__ = ["Scratch", "dropped_shuffles", "materialize", "shared_dir"]

#: A word: a maximal run of anything but space and U+0009 to U+000D (``bytes.split()`` cuts at the same six).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hold Arrow batches of whole texts to ``rows`` rows, unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def others(columns: Sequence[str], own: Sequence[str]) -> list[str]:
    """``columns`` without those named like one of an operator's ``own``, which replaces it; case does not matter."""
    taken = {c.lower() for c in own}
    return [c for c in columns if c.lower() not in taken]


def named(column: str) -> Column:
    """The column of that very name, whatever marks it holds."""
    return F.col(f"`{column.replace('`', '``')}`")


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets a working column's."""
    return F.struct(*[named(c) for c in docs.columns])


def numbered(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """These columns under numbers, as Arrow functions cannot read all names."""
    return docs.select(*[named(c).alias(f"_{i}") for i, c in enumerate(columns)])


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(column, UPPER, LOWER)


def running_totals(df: DataFrame, order: Sequence[Column], size: Column, label: str, rows: Column | None = None) -> DataFrame:
    """Add ``row_before`` and ``size_before`` (rows, and their sizes' sum, before each row in the order) and ``size_all``.

    Range partitions are totalled one by one, the few totals are summed up front, and each partition
    then counts on from its own offset; no task sees more than a partition. The order has to be total
    (no ties but between equal rows) for reruns to agree. ``rows``: how many rows each one stands for.
    """
    spark = df.sparkSession
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order, strict=True)) | {"_size": size.cast("long"), "_rows": (F.lit(1) if rows is None else rows).cast("long")})
    placed = materialize(
        keyed.repartitionByRange(shuffle_partitions(spark), *[F.col(n).asc_nulls_first() for n in names]).withColumn("_part", F.spark_partition_id()),
        label,
    )
    # One row for each range partition: the only place where all rows of something meet.
    totals = placed.groupBy("_part").agg(F.sum("_rows").alias("_n"), F.sum("_size").alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_off"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_size_off"),
        F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("size_all"),
    )
    inside = Window.partitionBy("_part").orderBy(*[F.col(n).asc_nulls_first() for n in names])
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(offsets), "_part")  # as many rows as there are partitions
        .withColumns(
            {
                "row_before": F.col("_rows_off") + F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
                "size_before": F.col("_size_off") + F.coalesce(F.sum("_size").over(earlier), F.lit(0)),
            }
        )
        .drop(*names, "_size", "_rows", "_part", "_rows_off", "_size_off")
    )
