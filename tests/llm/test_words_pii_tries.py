"""Divergence audit, personal data and the conversation trie against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from callscope.llm import divergence, pii, tries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def speech(rng: random.Random, n: int) -> str:
    words = ["the", "Der", "été", "river", "STONE", "x", "über", "mañana", "東京", "n0te", "a-b", "İo"]
    return " ".join(rng.choice(words) + rng.choice(["", ",", "z", "\x00", "9"]) for _ in range(n))


def word_rows() -> list[tuple]:
    rng = random.Random(5)
    rows = [(i, speech(rng, rng.randrange(0, 40)), rng.choice(["en", "de", None]), f"s{i % 5}", i) for i in range(120)]
    rows += [(200, None, "en", "s1", 0), (201, "", None, None, 0), (202, "rare words only", "xx", "alone", 0), (203, "", "xx", "other", 0), (204, None, "xx", None, 0)]
    return [*rows, rows[3], rows[3], (None, speech(rng, 4000), "en", "s2", 0), (205, "wort", "solo", "s", 0)]


WORD_DDL = "doc_id long, text string, lang string, source string, value long"


def brute_audit(rows: list[tuple], least: int, top: int) -> set[tuple]:
    groups, frequency = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang or "", source or ""].update(found)
        frequency[lang or ""].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in frequency[lang].items() if n >= least)
        own = {s: c for (of, s), c in groups.items() if of == lang}

        def rate(c: Counter, kept=kept) -> dict:
            total = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        rates, q = {s: rate(c) for s, c in own.items()}, rate(sum(own.values(), Counter()))
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s, p in rates.items():
            pairs = [(-sum(apart(p[t], r[t]) for t in kept), o.encode(), o) for o, r in rates.items() if o != s]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))}
            best = sorted((-apart(p[t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[t] > q[t])
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(best[:top])}
    return out


@pytest.mark.parametrize("least", [1, 3, 10, 200])
def test_audit_equals_brute_force(spark, least):
    rows = word_rows()
    got = divergence.audit(spark.createDataFrame(rows, WORD_DDL).repartition(5), least, 4, salts=3).collect()
    assert {tuple(r) for r in got} == brute_audit(rows, least, 4) and len(got) == len(brute_audit(rows, least, 4))


def test_audit_with_a_full_sketch(spark, monkeypatch):
    """Where every counter is full nothing is ruled out, and the result is the same; tasks that hand on their counts often add up to the same as well."""
    monkeypatch.setattr(divergence, "WIDTH", 16)
    monkeypatch.setattr(divergence, "PIECE", 8)
    monkeypatch.setattr(divergence, "HELD", 7)
    rows = word_rows()
    assert {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, WORD_DDL), 10, 4).collect()} == brute_audit(rows, 10, 4)


def test_sketch_rules_out_and_never_says_too_little(spark):
    rows = [(i, " ".join(["common"] + [f"q{chr(97 + i % 26)}{chr(97 + j)}x" for j in range(20)]), "en", "s", 0) for i in range(130)]
    texts = divergence._texts(spark.createDataFrame(rows, WORD_DDL).repartition(3), "text", "lang", "source")
    with divergence.Scratch(spark) as hold:
        bits = divergence.sketch(texts, 6, hold)
        full = lambda t: all(row[c[0] >> 3] >> (7 - (c[0] & 7)) & 1 for row, c in zip(bits, divergence._cells([t], b"en"), strict=True))
        assert full(b"common") and not any(full(f"q{chr(97 + i)}{chr(97 + j)}x".encode()) for i in range(26) for j in range(20))  # each in five documents
        assert {r.term for r in divergence.term_counts(texts, 6, hold).collect()} == {"common"}


def test_audit_edge_cases(spark):
    empty = spark.createDataFrame([], WORD_DDL)
    assert divergence.audit(empty).count() == 0
    odd = spark.createDataFrame(word_rows(), WORD_DDL).withColumnsRenamed({"text": "a.b", "lang": "item", "source": "rank"})
    assert divergence.audit(odd, 3, 4, text_col="a.b", lang_col="item", source_col="rank").count() == len(brute_audit(word_rows(), 3, 4))
    with pytest.raises(ValueError, match="255"):
        divergence.audit(odd, 300, text_col="a.b", lang_col="item", source_col="rank")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The contract's patterns as they stand."""
    plain = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    ]

    def passes(kind: int, value: str) -> bool:
        digits = [int(d) for d in re.sub("[^0-9]", "", value)]
        if kind == 1:
            return all(int(x) <= 255 for x in value.split("."))
        if kind == 2:
            return 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0
        return kind == 0 or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in enumerate(plain) for m in re.finditer(p, text, re.ASCII) if passes(k, m[0])]


ODD = [
    "a@b.co_x@d.ef a@b@c.de .@x.yz a@b.co.@x.yz -a@-b.-c+d@e.f.g. no@dot @x.y é@x.yz aé@b.cd",
    "1.2.3.4.5.6.7.8 256.1.1.1.9.9 0001.002.255.0 1.2.3 9.9.9.9999 1..2.3.4.5 300.1.2.3.4",
    "4111111111111111 4111-1111 1111-1111 4111 1111 1111 1111 4111  1111 1111 1111 41111111111111111111 5 4111111111111111-5 0000000000000000000",
    "+1 (415) 555-2671 ++49-30 1234567 ) +1234567 +12345678901234567 +1  ....  +7+8 12345678 +1 22 33 44 5.",
    "x" * 3000 + " " + "1." * 2000 + " " + "+1" + "(" * 500 + "9" * 7 + " 1 " * 100,
    "日本 +81 3-1234-5678 語 𝔘@x.com é4111111111111111é 10.0.0.1🙂10.0.0.2",
    "",
    "@",
]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(9)
    texts = ODD + ["".join(rng.choice("a.@-+ 01289()_é\n4") for _ in range(rng.randrange(60))) for _ in range(1500)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.base] for r in pii.find_personal(d, ["doc_id"]).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}


def brute_terms(texts: list[str | None], generalise: float, remove: float, around: int) -> list[list[tuple[int, int, int]]]:
    term, n = regex.compile(r"[\p{L}\p{M}\p{N}]+"), len(texts)
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    frequency = Counter(w for t in texts for w in {w for w in term.findall(t.translate(LOWER)) if len(w) >= 3})
    entities, pairs, seen = Counter(), Counter(), defaultdict(set)
    own = []
    for t, spans in zip(texts, base, strict=True):
        met = set()
        for kind, a, b in spans:
            c = (kind, t[a:b].translate(LOWER) if kind < 2 else re.sub("[^0-9]", "", t[a:b]))
            matched = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if kind == 0 else [(x, y) for k, x, y in spans if k == kind]
            left = t[max([y for _, y in matched if y <= a], default=0) : a][-around:]
            right = t[b : min([x for x, _ in matched if x >= b], default=len(t))][:around]
            left = regex.sub(r"^[\p{L}\p{M}\p{N}]+", "", left) if len(left) >= around else left
            right = regex.sub(r"[\p{L}\p{M}\p{N}]+$", "", right) if len(right) >= around else right
            met |= {(c, w) for w in term.findall((left + "\n" + right).translate(LOWER)) if len(w) >= 3} | {(c, None)}
        own.append(met)
        for c, w in met:
            if w is None:
                entities[c] += 1
            else:
                pairs[c, w] += 1
                seen[c, w].add(t)
    out = []
    for t, spans, met in zip(texts, base, own, strict=True):
        level = Counter()
        for c, w in met:
            if w and len(seen[c, w]) >= 2 and entities[c] < n:
                ratio = math.log2(pairs[c, w] * n / (entities[c] * frequency[w])) / math.log2(n / entities[c])
                if ratio >= generalise:
                    level[w] = max(level[w], 2 if ratio >= remove else 1)
        found = [(m.start(), m.end(), level[m[0]]) for m in term.finditer(t.translate(LOWER)) if m[0] in level]
        out.append([f for f in found if not any(a < f[1] and f[0] < b for _, a, b in spans)])
    return out


def private_texts() -> list[str | None]:
    rng = random.Random(2)
    common = ["the", "letter", "was", "sent", "again", "from", "house", "Street", "about", "more"]
    fill = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [fill(rng.randrange(5, 60)) for _ in range(150)]
    for i in range(3):  # a name stands by its address in unlike texts
        texts.append(f"{fill(9)} Zoraida Quillfeather writes as zq@mail.org {fill(9)} quillfeather {fill(40)}")
    texts += [f"{fill(4)} Häberle 7719 +49 30 1234567 {fill(30)}" for _ in range(2)] + [f"{fill(5)} häberle {fill(5)}"]
    once = f"{fill(4)} Onlyhere 10.1.2.3 {fill(4)}"
    return [*texts, once, once, None, "", fill(3)]  # copies alone prove nothing


def test_disclosing_terms_equal_brute_force(spark):
    texts = private_texts()
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string").repartition(4)
    found = {r.doc_id: r for r in pii.find_personal(d, ["doc_id", "base"]).collect()}
    want = brute_terms(texts, 0.85, 0.95, pii.AROUND)
    assert [[(s["start"], s["end"], s["level"]) for s in found[i].terms] for i in range(len(texts))] == want
    flagged = {texts[i][a:b].lower() for i, spans in enumerate(want) for a, b, _ in spans}
    assert {"zoraida", "quillfeather", "häberle"} <= flagged and "onlyhere" not in flagged and "the" not in flagged


def test_sanitised_texts(spark):
    texts = private_texts()
    rows = [(i, t, "kept", 1) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, base string, terms int")
    got = pii.sanitise(d)
    assert got.columns == d.columns
    out = {r.doc_id: r.text for r in got.collect()}
    want = brute_terms(texts, 0.85, 0.95, pii.AROUND)
    for i, t in enumerate(texts):
        if t is None:
            assert out[i] is None
            continue
        marks = [(a, b, "<" + pii.KINDS[k].upper() + ">") for k, a, b in base_spans(t)]
        marks += [(a, b, "" if n == 2 else "<number>" if t[a:b].isdigit() else "<word>") for a, b, n in want[i]]
        for a, b, mark in sorted(marks, reverse=True):
            t = t[:a] + mark + t[b:]
        assert out[i] == t
    assert not any("quillfeather" in (t or "").lower() or "@" in (t or "") for t in out.values())


def test_overlapping_kinds_are_one_mark(spark):
    d = spark.createDataFrame([("call +4111 1111 1111 1111 now",)], "text string")
    assert pii.sanitise(d).first().text.count("<") == 1


def test_pii_edge_cases(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal(d, ["doc_id"]).count() == 0 and pii.sanitise(d).count() == 0
    long = "word " * 60_000 + "a@b.co " + "9" * 50_000 + " x@" + "y." * 20_000 + "zz"
    d = spark.createDataFrame([(1, long), (None, "a@b.co"), (None, "a@b.co")], "doc_id long, text string")
    got = pii.find_personal(d, ["doc_id"]).collect()
    assert sorted(len(r.base) for r in got) == [1, 1, 2]
    plan = pii.find_personal(d, ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def conversations() -> list[tuple]:
    rng = random.Random(4)
    rows = []
    for c in range(60):
        n = rng.choice([0, 1, 2, 5, 9, 14])
        rows += [(c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ok", "é", None, ""]), "x") for t in range(n)]
    for c in range(60, 90):  # one beginning, and copies
        rows += [(c, t, "user", f"turn {t if c % 7 else -t}", "x") for t in range(10)]
    rows += [(-7, 0, "user", "hi", "x"), (-10, 0, "user", "hi", "x"), (-10, 1, "user", "hi", "x"), (None, 0, "user", "lost", "x"), rows[5], rows[5]]
    rows += [(1000, t, "user", f"long {t % 3}", "x") for t in range(700)] + [(1004, 3, "user", "y" * 50_000, "x")]
    return rows


CONV_DDL = "conv_id long, turn long, role string, text string, depth string"


def brute_trie(rows: list[tuple]) -> set[tuple]:
    own = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):  # deepest first
        own_ = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = own_ + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(rebuilt[c]) == len(p))))
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()
    }


@pytest.mark.parametrize("parts", [1, 7])
def test_trie_equals_brute_force(spark, parts):
    rows = conversations()
    got = tries.conversation_trie(spark.createDataFrame(rows, CONV_DDL).repartition(parts)).collect()
    want = brute_trie(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_trie_edge_cases(spark):
    assert tries.conversation_trie(spark.createDataFrame([], CONV_DDL)).count() == 0
    only = spark.createDataFrame([(7, 0, "user", "gone", "x")], CONV_DDL)  # its first turns are those of 5, which is absent
    got = tries.conversation_trie(only).collect()
    assert {tuple(r) for r in got} == brute_trie([(7, 0, "user", "gone", "x")]) and got[0].n_leaves == 1 and got[0].parent_conv_id is None
    named = spark.createDataFrame(conversations(), CONV_DDL).withColumnsRenamed({"conv_id": "depth ", "turn": "k1", "role": "i", "text": "p.1"})
    found = tries.conversation_trie(named, id_col="depth ", turn_col="k1", role_col="i", text_col="p.1")
    assert found.count() == len(brute_trie(conversations()))


def test_end_hashes_of_a_large_group(spark):
    """The ids of one node are packed by ranges, and the packs hash like the whole list."""
    ends = spark.range(20_000).select(F.lit(3).cast("long").alias("depth"), F.lit(1).cast("long").alias("k1"), (F.col("id") % 2).alias("k2"), (F.col("id") * 7 - 900).alias("conv_id"))
    got = {r.k2: r.ends_sha256 for r in tries._end_hashes(ends.repartition(9)).collect()}
    want = {k: hashlib.sha256(",".join(str(i * 7 - 900) for i in range(k, 20_000, 2)).encode()).hexdigest() for k in (0, 1)}
    assert got == want
