"""Element trees, declared types and scopes against brute force, and XML against a parser."""

from __future__ import annotations

import json
import random
from xml.etree import ElementTree

from pyspark.sql import functions as F

from callscope.operators import trees


def random_xml(rng: random.Random, depth: int = 0) -> str:
    name = rng.choice(["a", "b", "Item", "ns:x", "x.y-z"])
    attributes = "".join(f' k{i}="{rng.choice(["1", ">", "it's", "/"])}"' for i in range(rng.randrange(3)))
    if depth > 5 or rng.random() < 0.25:
        return f"<{name}{attributes}/>" if rng.random() < 0.5 else f"<{name}{attributes}>t</{name}>"
    inner = "".join(rng.choice(["", "text", "<!-- <a> -->", "<![CDATA[</b>]]>"]) + random_xml(rng, depth + 1) for _ in range(rng.randrange(4)))
    return f"<{name}{attributes}>{inner}</{name}>"


def test_element_trees_equal_a_parser(spark):
    rng = random.Random(1)
    texts = [random_xml(rng) for _ in range(80)] + ["<e>" * 300 + "</e>" * 300]
    docs = spark.createDataFrame([(i, f'<?xml version="1.0"?>\n{t}') for i, t in enumerate(texts)], "id long, body string")
    found: dict = {}
    for r in sorted(trees.elements(docs, "id", "body", fold=False).collect(), key=lambda r: (r.id, r.node)):
        assert r.matched
        found.setdefault(r.id, []).append((r.node, r.name, r.depth, r.parent))
    for i, text in enumerate(texts):
        root = ElementTree.fromstring(text.replace("ns:x", "ns_x"))
        want: list = []

        def walk(e, depth, parent, want=want):
            want.append((e.tag.replace("ns_x", "ns:x"), depth, parent))
            at = len(want) - 1
            for child in e:
                walk(child, depth + 1, at)

        walk(root, 1, None)
        place = {node: n for n, (node, *_) in enumerate(found[i])}
        assert [(name, depth, place.get(parent)) for _, name, depth, parent in found[i]] == want


def test_unlike_and_broken_markup(spark):
    texts = [None, "", "no tags", "<a><b></a></b>", "<ul><li>x<li>y</ul>", '<p title="a>b">x<br>y</p><script>if (a<b) "</p>"</script>', "<A></a>", "</a><a>", '<x y="' + "z" * 200_000 + '"/>', "<" * 1000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, html string")
    rows: dict = {}
    for r in sorted(trees.elements(docs, "id", "html").collect(), key=lambda r: (r.id, r.node)):
        rows.setdefault(r.id, []).append((r.name, r.depth, r.parent, r.matched))
    assert set(rows) == {3, 4, 5, 6, 7, 8}
    assert not any(m for *_, m in rows[3]) and not any(m for *_, m in rows[7])
    assert rows[4] == [("ul", 1, None, True), ("li", 2, 0, True), ("li", 2, 0, True)]
    assert rows[5] == [("p", 1, None, True), ("br", 2, 0, True), ("script", 1, None, True)]
    assert rows[6] == [("a", 1, None, True)] and rows[8] == [("x", 1, None, True)]


def test_types_expand_as_a_walk(spark):
    rng = random.Random(2)
    fields = [(f"t{i}", f"f{j}", "object" if (ref := rng.choice([None, None, *range(14)])) is not None else "string", f"t{ref}" if ref is not None else None) for i in range(12) for j in range(rng.randrange(1, 4))]
    for depth in (1, 4, 6):
        got = {(r.type, r.path): (r.kind, r.level) for r in trees.expand_types(spark.createDataFrame(fields, "type string, field string, kind string, ref string"), depth).collect()}
        want: dict = {}

        def walk(root, type_, path, way, want=want, depth=depth):
            for t, field, kind, ref in fields:
                if t == type_:
                    level, at = len(way), ".".join([*path, field])
                    circle, deep = ref in way, ref is not None and level >= depth
                    want[root, at] = ("circle" if circle else "deep" if deep else kind, level)
                    if ref and not circle and not deep:
                        walk(root, ref, [*path, field], [*way, ref])

        for root in {f[0] for f in fields}:
            walk(root, root, [], [root])
        assert got == want


def test_scopes_from_near_to_far(spark):
    rng = random.Random(3)
    facts = [(rng.choice("xyz"), rng.choice(["1", "1", "2", None]), f"f{rng.randrange(6)}", f"d{rng.randrange(3)}", "r") for _ in range(14)]
    calls = [(i, rng.choice("xyzw"), f"f{rng.randrange(8)}", f"d{rng.randrange(4)}", "r" if i % 3 else "q") for i in range(60)]
    ddl = "file string, folder string, repo string"
    got = {r.call: (r.scope, r.value) for r in trees.by_nearest_scope(spark.createDataFrame(calls, f"call int, name string, {ddl}"), spark.createDataFrame(facts, f"name string, value string, {ddl}")).collect()}
    for call, name, *where in calls:
        want = (None, None)
        for n, scope in enumerate(trees.SCOPES):
            said = {v for x, v, *at in facts if x == name and v is not None and (scope == "all" or at[n] == where[n])}
            if said:
                want = (scope, next(iter(said)) if len(said) == 1 else None)
                break
        assert got[call] == want


def test_abi_methods_of_odd_files(spark):
    bodies = [json.dumps([{"type": "function", "name": "a", "stateMutability": "view"}, {"type": "function", "name": "b"}, {"type": "event", "name": "c"}, {"type": "function"}]), "{", "null", None, '{"type": "function", "name": "x"}', "[1, 2]"]
    got = trees.abi_methods(spark.createDataFrame(list(enumerate(bodies)), "path int, body string")).filter(F.col("path") == 0).collect()
    assert sorted((r.method, r.reads) for r in got) == [("a", True), ("b", False)]


def test_shapes_are_written_once(spark, monkeypatch):
    """What a round adds is written once, whatever the number of rounds."""
    from callscope.operators import tables

    sizes = []

    def counted(df, path, write=tables._write):
        out = write(df, path)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(tables, "_write", counted)
    fields = [(f"t{i}", "x", "object", f"t{i + 1}") for i in range(9)] + [("t9", "y", "string", None)]
    found = trees.expand_types(spark.createDataFrame(fields, "type string, field string, kind string, ref string"))
    assert {r.kind for r in found.filter("type = 't0' and level = 6").collect()} == {"deep"}
    assert len(sizes) > 2 and sum(sizes) == found.count()
