"""Rows in a global or keyed order: range partitions, and what is carried over their ends.

Sums, hashes and last values run inside each range partition; one row for each partition then tells
what the partitions before it hold of the key it begins with. No task sees more than a partition of
rows, however many rows share a key, and the only window over all partitions has one row for each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.operators.tables import Scratch, materialize


@dataclass(frozen=True)
class Running:
    """A value that runs on along the rows of a key: ``how`` is sum (nulls are none), xor (of longs) or last (not null)."""

    value: Column
    how: str = "sum"

    def over(self, column: str | Column, window) -> Column:
        c = F.col(column) if isinstance(column, str) else column
        if self.how == "last":
            return F.last(c, ignorenulls=True).over(window)
        return (F.bit_xor(c) if self.how == "xor" else F.sum(c)).over(window)

    def total(self, column: str, order: Sequence[str]) -> Column:
        if self.how == "last":
            return F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order)))
        return F.bit_xor(column) if self.how == "xor" else F.sum(column)

    def joined(self, before: Column, inside: Column) -> Column:
        if self.how == "last":
            return F.coalesce(inside, before)
        both = before.bitwiseXOR(inside) if self.how == "xor" else before + inside
        return F.coalesce(both, inside, before)


def range_placed(rows: DataFrame, order: Sequence[Column], label: str, keep: Scratch | None = None) -> DataFrame:
    """Write the rows in range partitions of the order: ``_o0``, ``_o1``, ... (its columns) and ``_part`` come along.

    Every later use reads the same rows from the same part, whatever is pruned from its plan. The order
    should be total but for equal rows; nulls come first. Without ``keep`` the table stays.
    """
    names = [f"_o{i}" for i in range(len(order))]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keyed = rows.withColumns(dict(zip(names, order, strict=True)))
    placed = keyed.repartitionByRange(parts, *[F.col(n).asc_nulls_first() for n in names]).withColumn("_part", F.spark_partition_id())
    return keep(placed, label) if keep is not None else materialize(placed, label)


def order_columns(placed: DataFrame) -> list[str]:
    return [c for c in placed.columns if c[:2] == "_o" and c[2:].isdigit()]


def numbered(placed: DataFrame, name: str = "place", start: int = 1) -> DataFrame:
    """Number the rows of :func:`range_placed` in ``name``, gapless from ``start``; the working columns go."""
    order = order_columns(placed)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    met = placed.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return met.withColumn(name, F.col("_before") + inside + (start - 1)).drop(*order, "_part", "_before")


def run_on(placed: DataFrame, key: int, runs: dict[str, Running], last: str | None = None) -> DataFrame:
    """Add running values along the rows of a key to :func:`range_placed` rows.

    The first ``key`` columns of the order are the key, the others the order inside it. Each of
    ``runs`` becomes a column that includes the row itself; ``last`` names a flag of a key's last row.
    Null keys are a key of their own. The working columns stay, so runs can follow each other.
    """
    order = order_columns(placed)
    keys, inner = order[:key], order[key:]
    values = placed.withColumns({f"_r_{n}": r.value for n, r in runs.items()})
    totals = {n: r.total(f"_r_{n}", inner or keys) for n, r in runs.items()}
    by_key = values.groupBy("_part", *keys).agg(F.count("*").alias("_n"), *[t.alias(f"_t_{n}") for n, t in totals.items()])
    at = F.struct(*keys)
    edges = by_key.groupBy("_part").agg(F.min(at).alias("_first"), F.max(at).alias("_end"), *[F.max_by(f"_t_{n}", at).alias(f"_t_{n}") for n in runs])
    # One row for each partition from here on: its first key, its last one and what it holds of that.
    along = Window.orderBy("_part")
    of_end = Window.partitionBy("_end").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = edges.withColumns({f"_t_{n}": r.over(f"_t_{n}", of_end) for n, r in runs.items()})
    goes_on = F.lag("_end").over(along).eqNullSafe(F.col("_first"))
    edges = edges.select(
        "_part", "_first", F.lead("_first").over(along).alias("_next"), *[F.when(goes_on, F.lag(f"_t_{n}").over(along)).alias(f"_c_{n}") for n in runs]
    )
    window = Window.partitionBy("_part", *keys).orderBy(*[F.col(c).asc_nulls_first() for c in inner or keys])
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {n: r.over(f"_r_{n}", upto) for n, r in runs.items()}
    if last:
        added[last] = F.lead(F.lit(1)).over(window).isNull()
    met = values.withColumns(added).join(F.broadcast(edges), "_part")
    begins = at.eqNullSafe(F.col("_first"))
    out = {n: r.joined(F.when(begins, F.col(f"_c_{n}")), F.col(n)) for n, r in runs.items()}
    if last:
        out[last] = F.col(last) & ~F.coalesce(at.eqNullSafe(F.col("_next")), F.lit(False))
    return met.withColumns(out).drop("_first", "_next", *[f"_{x}_{n}" for n in runs for x in "rc"])
