"""Agreement, inheritance, assembly, branches and builders against brute force on small random inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from callscope.operators import builders, flows, joins, linking, ranges


@pytest.mark.parametrize("seed", [1, 2])
def test_agreed_values_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(flows, "COMPACT", 3)
    rng = random.Random(seed)
    edges = [(i + 1, i) for i in range(14)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(5, 5), (None, 3), (3, None)]
    given = [(0, "a"), (20, "a"), (21, "b"), (21, None), (30, "c"), (30, "c"), (33, None)]
    got = {r.slot: (r.value, r.conflict) for r in flows.agreed_values(spark.createDataFrame(given, "slot long, value string"), spark.createDataFrame(edges, "slot long, source long")).collect()}
    held = {s: {v} for s, v in given if v and s != 21} | {21: {"b"}}
    for _ in range(60):
        for slot, source in edges:
            if slot is not None and source is not None and source in held:
                held[slot] = held.get(slot, set()) | held[source]
    assert got == {s: (next(iter(v)) if len(v) == 1 else None, len(v) > 1) for s, v in held.items()}


def test_no_edges_and_no_values(spark):
    none = spark.createDataFrame([], "slot long, source long")
    given = spark.createDataFrame([(1, "a")], "slot long, value string")
    assert [tuple(r) for r in flows.agreed_values(given, none).collect()] == [(1, "a", False)]
    assert flows.agreed_values(given.limit(0), spark.createDataFrame([(1, 2)], "slot long, source long")).count() == 0


def test_inherited_steps_of_long_chains_and_circles(spark):
    """A chain of 1,000 copies, a circle, a parent that is no client, and clients that share one."""
    parent = {i: i - 1 if i else None for i in range(1000)} | {2000: 2002, 2001: 2000, 2002: 2001, 2003: 2001, 3000: 9999, 3001: 3000} | {4000 + i: 10 for i in range(20)}
    rng = random.Random(3)
    steps = [(c, rng.choice("xyz"), f"v{c}", rng.random() < 0.7) for c in parent if rng.random() < 0.2 or c > 1999] + [(7777, "x", "lost", False), (10, "x", "v", True), (10, "x", "u", False)]
    got = {(r.client, r.name): (r.value, r.optional, r.distance) for r in flows.inherited_steps(spark.createDataFrame(list(parent.items()), "client long, parent long"), spark.createDataFrame(steps, "client long, name string, value string, optional boolean")).collect()}
    own: dict = {}
    for c, name, v, o in steps:
        was = own.get((c, name), (v, True))
        own[c, name] = min(v, was[0]), o and was[1]
    want: dict = {}
    for c in parent:
        at, d, seen = c, 0, set()
        while at in parent and at not in seen:
            seen.add(at)
            for name in "xyz":
                if (at, name) in own:
                    v, o = own[at, name]
                    was = want.get((c, name))
                    want[c, name] = (v, o, d) if was is None else (was[0], was[1] and o, was[2])
            at, d = parent[at], d + 1
    assert got == want


def test_rounds_broadcast_nothing(spark, monkeypatch):
    """Small as they are, the tables of a round merge: what grows with clients and files does not pass through the driver."""
    plans = []
    monkeypatch.setattr(flows.Scratch, "__call__", lambda self, df, label, f=flows.Scratch.__call__: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or f(self, df, label))
    clients = spark.createDataFrame([(i, i - 1 if i else None) for i in range(9)], "client long, parent long")
    flows.inherited_steps(clients, clients.selectExpr("client", "'n' name", "'v' value", "true optional")).count()
    row = lambda path, kind, name, method, url: (path, kind, 1, name, method, url, "", "")
    rows = [row("f0.ts", "export", "N", "text", "https://a.io")] + [row(f"f{i}.ts", "export", "N", "again", f"{{import:./f{i - 1}#N}}") for i in range(1, 9)] + [row("c.ts", "call", "fetch", "GET", "{import:./f8#N}")]
    ddl = "path string, kind string, line int, name string, method string, url string, headers string, body_keys string"
    assert [r.url for r in linking.link(spark.createDataFrame(rows, ddl), {}).collect()] == ["https://a.io"]
    assert {"client-steps", "passed-on", "linked"} <= {label for label, _ in plans}
    assert not [label for label, plan in plans if "Broadcast" in plan]


def test_assembly_keeps_first_use(spark):
    uses = [("r", 1, "a"), ("r", 2, "b"), ("a", 1, "c"), ("a", 2, "d"), ("b", 1, "d"), ("d", 5, "e"), ("c", 1, "a"), ("e", 1, "r"), ("q", 9, "b"), ("q", 3, "e"), ("x", 1, "x"), ("y", 1, None)]
    uses += [(f"n{i}", 1, f"n{i + 1}") for i in range(40)] + [("a", 9, "c")]
    roots = spark.createDataFrame([("r",), ("q",), ("x",), ("y",), ("n0",), ("alone",), ("r",), (None,)], "root string")
    order = flows.assembly_order(roots, spark.createDataFrame(uses, "doc string, ord long, used string"))
    found: dict = {}
    for r in sorted(order.collect(), key=lambda r: (r.root, r.place)):
        found.setdefault(r.root, []).append(r.doc)

    def walk(doc, seen):
        seen.append(doc)
        for _, used in sorted((o, u) for d, o, u in uses if d == doc and u is not None):
            if used not in seen:
                walk(used, seen)
        return seen

    assert found == {root: walk(root, []) for root in ("r", "q", "x", "y", "n0", "alone")}
    texts = spark.createDataFrame([(d, f"<{d}>") for d in "rabcde"], "doc string, text string")
    pieces = {(r.root, r.piece): r.text for r in flows.assembled_texts(order, texts, 2).collect()}
    assert pieces["r", 0] == "<r>\n<a>" and pieces["r", 1] == "<c>\n<d>" and pieces["r", 2] == "<e>\n<b>"


def test_assembly_follows_single_uses_in_few_rounds(spark, monkeypatch):
    """A chain of 40 documents behind a fork takes a round for eight of them, with its circle and an earlier way found later."""
    uses = [("r", 1, "n0"), ("r", 2, "n9"), ("n40", 3, "r")] + [(f"n{i}", 1, f"n{i + 1}") for i in range(40)]
    made = []
    monkeypatch.setattr(flows.Scratch, "__call__", lambda self, df, label, f=flows.Scratch.__call__: made.append(label) or f(self, df, label))
    order = flows.assembly_order(spark.createDataFrame([("r",), ("n40",)], "root string"), spark.createDataFrame(uses, "doc string, ord long, used string"))
    found = {(r.root, r.doc): (r.place, r.path) for r in order.collect()}
    assert found == {("r", "r"): (0, []), **{("r", f"n{i}"): (i + 1, [1] * (i + 1)) for i in range(41)}, ("n40", "n40"): (0, []), ("n40", "r"): (1, [3]), **{("n40", f"n{i}"): (i + 2, [3] + [1] * (i + 1)) for i in range(40)}}
    assert made.count("known") <= 10


@pytest.mark.parametrize("seed", [1, 2])
def test_assembly_moves_a_slice_of_the_roots_at_once(spark, seed, monkeypatch):
    """What lies between stops is put in at the end, in slices of a few rows, so no round writes all that is known; circles of single uses, equal hashes apart, have a stop."""
    rng = random.Random(seed)
    uses = [(i, rng.randrange(5), rng.randrange(150)) for i in range(30) for _ in range(3)] + [(i, i % 3 - 1, i + 1 if i % 50 != 49 else i - rng.choice([4, 9, 17, 40])) for i in range(50, 200)]
    uses = [(d, rng.randrange(-(1 << 40), 1 << 40) if d < 30 else o, u) for d, o, u in uses]
    roots = [0, 1, 2, 3, 50, 77, 199, 999]
    written: list = []

    def call(self, df, label, *by, f=flows.Scratch.__call__):
        out = f(self, df, label, *by)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(flows.Scratch, "__call__", call)
    monkeypatch.setattr(flows, "SLICE", 100)
    order = flows.assembly_order(spark.createDataFrame([(r,) for r in roots], "root long"), spark.createDataFrame(uses, "doc long, ord long, used long"))
    assert "Exchange hashpartitioning" not in order._jdf.queryExecution().toString() and order.columns == ["root", "doc", "path", "place"]
    found: dict = {}
    for r in sorted(order.collect(), key=lambda r: (r.root, r.place)):
        found.setdefault(r.root, []).append((r.place, r.doc, tuple(r.path)))

    def walk(doc, path, seen):
        seen[doc] = path
        for o, u in sorted({(min(x for d, x, v in uses if (d, v) == (doc, u)), u) for d, x, u in uses if d == doc and u != doc}):
            if u not in seen:
                walk(u, (*path, o), seen)
        return seen

    want = {root: [(i, d, p) for i, (d, p) in enumerate(walk(root, (), {}).items())] for root in roots}
    assert found == want
    whole = sum(map(len, want.values()))
    assert len([1 for label, _ in written if label == "assembled"]) > 3 and max(n for label, n in written if label == "known") < whole / 2


def brute_innermost(points, blocks):
    out = {}
    for fn, point, at in points:
        held = [(s, -e, r) for f, r, s, e in blocks if f == fn and s <= at <= e]
        out[fn, point] = (max(held)[2] if held else None, len(held))
    return out


def test_ranges_hold_points_without_comparing_all(spark):
    rng = random.Random(6)
    blocks = [(i % 3, i, s, s + rng.choice([0, 1, 7, 300, 5000])) for i, s in enumerate(rng.randrange(9000) for _ in range(120))] + [(0, 500, 0, (1 << 39)), (0, 501, 9, 3), (1, 502, -4, 10)]
    points = [(i % 4, i, rng.randrange(10_000)) for i in range(400)] + [(0, 900, 0), (0, 901, 1 << 39), (0, 902, (1 << 39) + 1), (1, 903, -2)]
    p, b = spark.createDataFrame(points, "fn long, point long, at long"), spark.createDataFrame(blocks, "fn long, range long, start long, end long")
    found = ranges.innermost(p, b, ["fn"])
    want = brute_innermost(points, [x for x in blocks if x[2] >= 0 and x[2] <= x[3]])
    assert {(r.fn, r.point): (r.range, r.depth) for r in found.collect()} == want
    plan = ranges.stabbed(p, b, ["fn"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "CrossJoin" not in plan
    assert ranges.innermost(p, b.limit(0), ["fn"]).filter("depth = 0 and range is null").count() == len(points)


def test_points_meet_short_ranges_in_one_bin(spark):
    """Ranges of all lengths up to 64 are one class: a point is asked once for all, and the matches stay where they met."""
    points = spark.range(2000).selectExpr("id % 5 fn", "id point", "id % 400 at")
    spans = spark.range(640).selectExpr("id % 5 fn", "id range", "id % 400 start", "id % 400 + id % 64 end")
    found = ranges.innermost(points, spans, ["fn"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("Join") == 1
    want = brute_innermost([tuple(r) for r in points.collect()], [tuple(r) for r in spans.collect()])
    assert {(r.fn, r.point): (r.range, r.depth) for r in found.collect()} == want


def test_edits_meet_shut_branches_once(spark):
    edits = spark.createDataFrame([(1, 5, 5), (1, 20, 20), (1, 300, 300), (2, 7, 7)], "fn long, edit long, at long")
    branches = spark.createDataFrame([(1, 1, 0, 9, 4, 2), (1, 2, 15, 400, None, None), (1, 3, 18, 22, None, None), (2, 4, 0, 9, None, None)], "fn long, branch long, start long, end long, group_id long, group_size long")
    found = ranges.reach_of(edits, branches, spark.createDataFrame([(1, 350), (2, 8)], "fn long, use_at long"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    assert {(r.edit, r.reach, r.branch) for r in found.collect()} == {(5, "group", 1), (20, "maybe", None), (300, "always", None), (7, "always", None)}


def test_blocks_cover_a_range_once(spark):
    spans = [(0, 0), (0, 15), (3, 3), (3, 12), (5, 1000), (1, (1 << 39) - 2)]
    for r in spark.createDataFrame(spans, "s long, e long").withColumn("b", ranges.blocks(F.col("s"), F.col("e"))).collect():
        held = sorted((b.block << b.level, (b.block + 1 << b.level) - 1) for b in r.b)
        assert held[0][0] == r.s and held[-1][1] == r.e and all(x[1] + 1 == y[0] for x, y in zip(held, held[1:], strict=False)) and len(held) <= 80


def brute_entries(edits, branches, use_at):
    """The edits of one dict folded one by one."""
    inside = lambda b, at: b[1] <= at <= b[2]
    entries: dict = {}
    cover: dict = {}
    for at, op, key, value in sorted(edits):
        shut = [b for b in branches if inside(b, at) and not inside(b, use_at)]
        reach = "always" if not shut else "group" if len(shut) == 1 and shut[0][3] is not None else "maybe"
        if op == "remove":
            cover.pop(key, None)
            if key in entries:
                if reach == "always":
                    del entries[key]
                else:
                    entries[key][0] = True
            continue
        if reach == "group":
            cover.setdefault(key, {}).setdefault((shut[0][3], shut[0][4]), set()).add(shut[0][0])
        if key not in entries:
            entries[key] = [reach != "always", [value]]
        elif op == "set":
            entries[key] = [False, [value]] if reach == "always" else [entries[key][0], [*entries[key][1], value]]
    for key, groups in cover.items():
        if key in entries and any(len(seen) == size for (_, size), seen in groups.items()):
            entries[key][0] = False
    return {k: (o, len(v), v[0], v[-1]) for k, (o, v) in entries.items()}


def test_edits_equal_a_fold(spark):
    rng = random.Random(11)
    edits, branches, uses, want = [], [], [], {}
    for fn in range(60):
        own = [(at, rng.choice(["set", "set", "default", "remove"]), rng.choice("ab"), f"{at}") for at in rng.sample(range(100), rng.randrange(1, 14))]
        blocks = []
        for g in range(rng.randrange(4)):
            s, n = rng.randrange(80), rng.choice([1, 2, 3])
            for k in range(n):
                blocks.append((g * 10 + k, s + k * 9, s + k * 9 + 8, g if rng.random() < 0.8 or k else None, n))
        use = rng.randrange(60, 130)
        own = [e for e in own if e[0] < use]
        edits += [(fn, at, at, op, key, v) for at, op, key, v in own]
        branches += [(fn, *b) for b in blocks]
        uses.append((fn, use))
        want |= {(fn, k): v for k, v in brute_entries(own, blocks, use).items()}
    reached = ranges.reach_of(
        spark.createDataFrame(edits, "fn long, edit long, at long, op string, key string, value string"),
        spark.createDataFrame(branches, "fn long, branch long, start long, end long, group_id long, group_size long"),
        spark.createDataFrame(uses, "fn long, use_at long"),
    )
    assert {(r.fn, r.key): (r.optional, r.n_values, r.first_value, r.last_value) for r in ranges.edited_entries(reached, ["fn"]).collect()} == want


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_maps_read_equal_a_fold(spark, hot):
    rng = random.Random(8)
    steps = [(0 if rng.random() < hot else rng.randrange(5), at, rng.choice(["set"] * 6 + ["delete", "delete", "clear", "unknown"]), rng.choice(["a", "b", "c", None]), rng.choice([None, "1", "2"])) for at in range(500)]
    reads = [(i, rng.randrange(6), rng.randrange(520), rng.choice(["a", "b", "c", "d"])) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r.read: (r.state, r.value) for r in builders.read_maps(spark.createDataFrame(steps, "builder long, at long, op string, key string, value string"), spark.createDataFrame(reads, "read long, builder long, at long, key string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

    def state(builder, at):
        held, rest = {}, "absent"
        for b, p, op, key, value in steps:
            if b != builder or p >= at:
                continue
            if op == "unknown" or op in ("set", "delete") and key is None:
                held, rest = {}, "unknown"
            elif op == "clear":
                held, rest = {}, "absent"
            else:
                held[key] = ("set", value) if op == "set" else ("absent", None)
        return held, rest

    want = {}
    for read, builder, at, key in reads:
        held, rest = state(builder, at)
        want[read] = held.get(key, (rest, None))
    assert got == want
    final = {(r.builder, r.key): (r.value, r.complete) for r in builders.final_entries(spark.createDataFrame(steps, "builder long, at long, op string, key string, value string")).collect()}
    ends = {b: state(b, 1000) for b in range(5)}
    assert final == {(b, k): (v, rest != "unknown") for b, (held, rest) in ends.items() for k, (s, v) in held.items() if s == "set"}


def test_as_of_with_one_hot_name(spark):
    """One name with all rows: no window is larger than a range partition, and the result is that of a scan."""
    rng = random.Random(12)
    uses = [(i, "n", rng.randrange(400)) for i in range(300)] + [(900, "other", 5), (901, None, 5)]
    assigns = [("n", at, at * 10) for at in rng.sample(range(50, 380), 40)] + [(None, 9, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = joins.as_of(spark.createDataFrame(uses, "use_id long, name string, at long"), spark.createDataFrame(assigns, "name string, at long, value long"), ["name"])
        rows = {r.use_id: (r.value, r.assigned_at) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for use, name, at in uses:
        own = sorted((a, v) for n, a, v in assigns if n == name)
        before = [x for x in own if x[0] < at]
        a, v = before[-1] if before else own[0] if own else (None, None)
        assert rows[use] == (v, a)
