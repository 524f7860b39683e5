"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.llm.common import WORD, materialize, named, running_totals, whole_row

#: Cells of the sampling histogram: two levels of this many.
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Targets by source. ``sizes``: (source, source_size), one row for each source.

    Sources by code point, null last, take the weights in turn. The targets share all sizes' sum by
    weight; a target above ``max_epochs`` times its source's size is clamped there, and what is left
    is shared again by weight among the others, until none is above. The loop clamps whole sets of
    sources at once; the driver sees two sums a round.
    """
    spark = sizes.sparkSession
    ranked = running_totals(sizes, [F.col("source").isNull(), F.col("source")], F.col("source_size"), "mix-sources")
    weight = F.element_at(F.array([F.lit(w) for w in weights]), (F.col("row_before") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * max_epochs).cast("double").alias("cap")), "mix-weights")
    level, free = None, ranked.agg(F.sum("weight"), F.sum("source_size")).first()
    clamped = 0
    while free[0]:
        level = float(free[1]) / free[0]
        below = F.col("cap") < F.col("weight") * F.lit(level)
        # The water level only rises, so what is clamped stays clamped.
        row = ranked.agg(
            F.coalesce(F.sum(F.when(~below, F.col("weight"))), F.lit(0.0)),
            F.sum("source_size") - F.coalesce(F.sum(F.when(below, F.col("cap"))), F.lit(0.0)),
            F.count(F.when(below, 1)),
        ).first()
        if row[2] == clamped:
            break
        clamped, free = row[2], row
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level or 0.0))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def sample_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_rows: bool = False) -> DataFrame:
    """One row per document: id, ``size`` (words), ``source``, ``source_size``, ``target`` and ``repeats``.

    A source's ratio of target to size gives each of its documents the same whole number of
    repetitions, and one more to a seeded part of them whose words come nearest to the rest. The
    part is the documents with the lowest seeded hash: a histogram over two levels of 4096 cells of
    the hash finds where the sum crosses the rest, so that no task sorts a source. Documents whose
    hashes share the first 24 bits go in or out together, as do repeated rows.

    ``keep_rows``: the rows of ``docs`` themselves instead, each as often as it is taken.

    Null texts and texts without words have size 0; a null source is a source of its own; where all
    sizes are 0, so are the targets. Never more than ``max_epochs`` repetitions. Very long texts are
    documents like others, and a source's words are off its target by half its largest document (or
    group of repeated rows) at most. Ids may be null, repeat and be of any type; an empty table gives
    no rows. Columns may have any names: those not asked for are not read, and with ``keep_rows`` all
    come back as they are.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), named(id_col).cast("string"), F.coalesce(named(text_col), F.lit(""))).cast("binary"))
    cells = F.conv(F.substring(digest, 1, 6), 16, 10).cast("int")
    sized = materialize(
        docs.select(named(id_col).alias("doc_id"), named(source_col).alias("source"), word_count(named(text_col)).alias("size"), cells.alias("cell")), "mix-sizes"
    ).withColumns({"high": F.expr(f"cell div {CELLS}").cast("int"), "low": (F.col("cell") % CELLS).cast("int")})
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = targets.withColumn("whole", F.least(F.floor(ratio), F.lit(max_epochs)).cast("long"))
    wanted = wanted.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    wanted = materialize(wanted.withColumn("rest", F.when(F.col("whole") >= max_epochs, 0.0).otherwise(F.col("rest"))), "mix-targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    def crossing(histogram: DataFrame, cell: str, aim: Column) -> DataFrame:
        """For each source the cell in which its sum crosses ``aim``, and the sum before that cell."""
        w = Window.partitionBy("source").orderBy(cell)
        summed = histogram.withColumn("upto", F.sum("size").over(w)).withColumn("before", F.col("upto") - F.col("size"))
        return summed.filter((F.col("before") <= aim) & (aim < F.col("upto")))

    # At most 4096 rows for a source, summed before they are moved.
    first = sized.groupBy("source", "high").agg(F.sum("size").alias("size"))
    first = first.join(wanted.select("source", "rest"), same(first, wanted)).drop(wanted["source"])
    coarse = crossing(first, "high", F.col("rest")).select(F.col("source").alias("c_source"), F.col("high").alias("c_high"), F.col("rest").alias("c_rest"), F.col("before").alias("c_before"))
    coarse = materialize(coarse, "mix-coarse")
    second = sized.groupBy("source", "high", "low").agg(F.sum("size").alias("size"))
    second = second.join(coarse, second["source"].eqNullSafe(coarse["c_source"]) & (F.col("high") == F.col("c_high"))).filter(F.col("size") > 0)
    fine = crossing(second, "low", F.col("c_rest") - F.col("c_before"))
    left = F.col("c_rest") - F.col("c_before") - F.col("before")
    cut = fine.select("c_source", (F.col("c_high") * CELLS + F.col("low") + F.when(left * 2 > F.col("size"), 1).otherwise(0)).alias("cut"))
    # rest is below the source's size, so only a rest of 0 over a source without words has no crossing.
    plan = materialize(
        wanted.join(cut, wanted["source"].eqNullSafe(cut["c_source"]), "left").select(
            F.col("source").alias("p_source"), "source_size", "target", "whole", F.when(F.col("rest") > 0, F.coalesce("cut", F.lit(0))).otherwise(0).alias("cut")
        ),
        "mix-plan",
    )
    repeats = F.col("whole") + F.when((F.col("cell") < F.col("cut")) & (F.col("whole") < max_epochs), 1).otherwise(0)
    if keep_rows:
        rows = docs.select(whole_row(docs).alias("row"), cells.alias("cell"), named(source_col).alias("source"))
        taken = rows.join(plan, rows["source"].eqNullSafe(plan["p_source"])).select("row", repeats.alias("times")).filter("times > 0")
        return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
    return sized.join(plan, sized["source"].eqNullSafe(plan["p_source"])).select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: weights 1, 2, 3 in turn, at most three epochs; see :func:`sample_mix`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return sample_mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


#: The same mix: the water level as the first of the clamping orders that fits, the cut from one running sum of cells.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '42', doc_id, coalesce(text, ''))), 1, 6))::BIGINT AS cell FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source),
weighed AS (SELECT source, s, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w, 3.0::DOUBLE * s AS cap FROM src),
levels AS (
  SELECT *, cap / w AS r,
         ((SELECT sum(s) FROM src)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM weighed),
lev AS (SELECT arg_min(lam, r) AS lam FROM levels WHERE lam <= r),
targets AS (SELECT source, s, least(cap, w * coalesce((SELECT lam FROM lev), 0)) AS target FROM weighed),
wanted AS (SELECT *, least(CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END, 3)::BIGINT AS whole FROM targets),
rests AS (SELECT *, CASE WHEN whole >= 3 THEN 0 ELSE greatest(0, target - whole * s) END AS rest FROM wanted),
cells AS (SELECT source, cell, sum(size)::BIGINT AS size FROM sized GROUP BY 1, 2),
run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY cell) AS upto FROM cells),
cuts AS (
  SELECT run.source, cell + CASE WHEN (rest - (upto - size)) * 2 > size THEN 1 ELSE 0 END AS cut
  FROM run JOIN rests ON run.source IS NOT DISTINCT FROM rests.source WHERE rest > 0 AND upto - size <= rest AND rest < upto)
SELECT doc_id, size, s AS source_size, target,
       (size * (whole + CASE WHEN whole < 3 AND rest > 0 AND cell < coalesce(cut, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rests ON sized.source IS NOT DISTINCT FROM rests.source LEFT JOIN cuts ON sized.source IS NOT DISTINCT FROM cuts.source
"""
