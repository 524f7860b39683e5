"""Global and keyed order over range partitions against plain Python, and that plans bind costly expressions once."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from callscope.operators import requests
from callscope.operators.ordered import Running, numbered, range_placed, run_on
from callscope.plans import registry


@pytest.mark.parametrize("parts", [3, 64])
def test_places_of_a_wide_table(spark, parts):
    """Every place once, though the sizes' plan reads fewer columns than the rows' and partitions may be coalesced."""
    n = 20_000
    wide = spark.range(n).select(
        F.concat(F.lit("f"), F.col("id") % 97).alias("file"), (F.col("id") % 13).alias("line"), F.lit(1).alias("col"), F.col("id").alias("seq"), F.repeat(F.sha1(F.col("id").cast("string")), 20).alias("pad")
    )
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = [requests.with_place(d, requests.call_order()).select("place", "seq").collect() for d in (wide, wide.repartition(7))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r.place for r in got[0]) == list(range(1, n + 1)) and sorted(got[0]) == sorted(got[1])


def test_numbers_of_repeated_rows(spark):
    rows = spark.createDataFrame([(None,), (1,), (1,), (1,), (0,)], "k int").repartition(3)
    assert sorted((r.place, r.k) for r in numbered(range_placed(rows, [F.col("k")], "t")).collect()) == [(1, None), (2, 0), (3, 1), (4, 1), (5, 1)]
    assert numbered(range_placed(rows.filter("k > 9"), [F.col("k")], "t")).count() == 0


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_running_values_cross_partitions(spark, hot):
    """A key of any share of the rows, null keys, nulls among the values."""
    rng = random.Random(7)
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < hot else rng.choice("abcdefgh"), i, rng.choice([None, 1, 5, 9])) for i in range(900)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        placed = range_placed(spark.createDataFrame(rows, "k string, at long, v long").repartition(6), [F.col("k"), F.col("at")], "t")
        got = run_on(placed, 1, {"n": Running(F.lit(1)), "total": Running(F.col("v")), "mix": Running(F.xxhash64("at"), "xor"), "latest": Running(F.col("v"), "last")}, last="is_last").withColumn("h", F.xxhash64("at")).collect()
        assert placed.select("_part").distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    state, lasts = {}, {k: at for k, at, _ in rows}
    for r in sorted(got, key=lambda r: r.at):
        n, total, mix, latest = state.get(r.k, (0, None, 0, None))
        n, mix = n + 1, mix ^ r.h
        if r.v is not None:
            total, latest = (total or 0) + r.v, r.v
        state[r.k] = n, total, mix, latest
        assert (r.n, r.total, r.mix, r.latest, r.is_last) == (n, total, mix, latest, lasts[r.k] == r.at)
    assert len(got) == len(rows)


@pytest.mark.parametrize("name", ["slice_url_services", "agg01_stats", "agg13_run_totals", "out05_table_lines", "join03_longest_suffix"])
def test_url_shapes_are_bound_once(spark, name):
    """A filter or a join above a URL's shape repeats none of its expressions: each generator holds a pattern once."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    branches = plan.count("Relation [page_id")
    found = len(re.findall(r"regexp_(?:extract|replace)\(", plan))
    assert found <= 12 * branches + 6  # twelve in a shape, a few in the join of its hosts
