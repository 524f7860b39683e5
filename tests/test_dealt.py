"""Steps whose tasks hold a share of the input that does not grow with it."""

from __future__ import annotations

import random

import pytest

from callscope.operators import components, joins, requests, trees


@pytest.fixture
def dealt_tasks(spark):
    """Tasks of the last stage of a plan, of 24 shuffle partitions that adaptive execution would merge into one."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    yield lambda df: df.rdd.getNumPartitions()
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hosts_are_ranked_in_all_partitions(spark, dealt_tasks):
    calls = spark.createDataFrame([(i, 1, f"h{i % 3}") for i in range(50)] + [(1, 2, "h9")], "raw_id long, ord int, host string")
    out = requests.candidates(calls)
    assert dealt_tasks(out) == 24
    assert {(r.host, r.candidate) for r in out.filter("raw_id = 1").collect()} == {("h1", True), ("h9", True)} and out.count() == 51


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scopes_are_asked_in_all_partitions(spark, dealt_tasks):
    calls = spark.createDataFrame([(1, "m", 1, 1, 1), (2, "m", 2, 1, 1), (3, "n", 3, 3, 3)], "call int, name string, file int, folder int, repo int")
    facts = spark.createDataFrame([("m", "A", 1, 1, 1), ("m", "B", 9, 1, 1)], "name string, value string, file int, folder int, repo int")
    out = trees.by_nearest_scope(calls, facts)
    assert "REPARTITION_BY_NUM" in plan(out)
    assert {tuple(r) for r in out.collect()} == {(1, "file", "A"), (2, "folder", None), (3, None, None)}


def test_wrappers_are_settled_before_calls_meet_them(spark, dealt_tasks):
    rows = [("f", 0, "g", None), ("f", 1, "h", None), ("g", 0, "h", None), ("g", 1, "f", None), ("h", 0, None, "GET /a"), ("h", 1, "g", None), ("h", 2, "i", None), ("h", 3, "j", None), ("i", 0, "f", "GET /b"), ("j", 0, None, "GET /late")]
    inner = spark.createDataFrame(rows, "fn string, ord int, target string, request string")
    out = joins.expand_wrappers(spark.createDataFrame([(1, "f"), (2, "g"), (2, "h"), (3, "i"), (4, "x")], "call long, fn string"), inner)
    # Calls stand in one join, however many hops there are; what they reach is aggregated in all partitions.
    assert plan(out).count("HashAggregate") == 2 and "REPARTITION_BY_NUM" in plan(out) and plan(out).count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in plan(out)
    assert {tuple(r) for r in out.collect()} == {(1, "GET /a", 2), (1, "GET /b", 3), (2, "GET /a", 1), (2, "GET /b", 2), (3, "GET /b", 1), (3, "GET /a", 3)}


def _groups(edges: list[tuple]) -> dict:
    """The least file of each one's group, link by link."""
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    return {x: find(x) for x in root}


def test_files_that_only_import_take_no_part_in_rounds(spark, monkeypatch):
    seen, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda pairs, **how: seen.append(pairs.count()) or star(pairs, **how))
    edges = [(f"o{i:03}", f"c{i % 5}") for i in range(300)] + [("c0", "c1"), ("c1", "c2"), ("c3", "c4"), ("o001", "c0"), ("o999", "o998"), ("z", "z"), ("c0", "c0")]
    got = [(r.file, r.group) for r in joins.file_groups(spark.createDataFrame(edges, "src string, dst string")).collect()]
    assert len(got) == len(dict(got)) and dict(got) == _groups(edges)
    assert max(seen) <= 12


def test_groups_of_any_graph(spark):
    rng = random.Random(7)
    edges = [(base + rng.randrange(n), base + rng.randrange(n)) for base, n, m in ((0, 60, 40), (100, 40, 60), (200, 30, 15), (300, 9, 1)) for _ in range(m)]
    edges += [(500 - i, 501 + i) for i in range(20)] + [(501 + i, 499 - i) for i in range(20)] + [(700, 600 + i) for i in range(30)]
    got = [(r.file, r.group) for r in joins.file_groups(spark.createDataFrame(edges, "src long, dst long")).collect()]
    assert len(got) == len(dict(got)) and dict(got) == _groups(edges)
