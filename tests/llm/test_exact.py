"""The corpus operators against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from callscope.llm import decontaminate, lm, mixing, quality, repeats, secrets, shards, simhash, syncmers, urls
from callscope.llm.common import Scratch, materialize

WORDS = ["the", "of", "red", "Blue", "stone", "river", "lamp", "cloud", "paper", "iron", "voice", "night"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    """doc_id, text, source, shard (a clashing name): near and exact copies, shared passages, nulls, empties, a repeated row."""
    rng = random.Random(seed)
    base, passage = prose(rng, 120), prose(rng, 70)
    rows = [(i, prose(rng, rng.randrange(5, 150)), f"s{i % 4}", 7) for i in range(24)]
    for i in range(24, 36):
        words = base.split()
        words[rng.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words), "s0", 7))
    rows += [(i, prose(rng, 20) + " " + passage + " " + prose(rng, 9), None, 7) for i in range(36, 40)]
    rows += [(40, base, "s1", 7), (41, base, "s2", 7), (42, "", "s1", 7), (43, None, "s1", 7), (44, "é" * 300, "s2", 7), (45, "word", "s3", 7), (46, "a" * 450, "s3", 7), (47, " \t\n", "s3", 7)]
    rows += [(None, prose(rng, 30), "s1", 7), rows[3], (48, prose(rng, 6000), "s2", 7)]
    return rows


DDL = "doc_id long, text string, source string, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DDL).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def test_urls(spark):
    pages = [(1, "https://A.Example.org/es/x?q#f", "n"), (2, "http://example.org/en/13", "n"), (3, "http://example.org/en/2", "n"), (4, None, "n"), (5, "no scheme", "n"), (6, "http://x.com#/de/", "n"), (7, "http://x.com/de/", "n"), (8, "ftp://com/fr/", "n"), (9, "http://xorg/", "n"), (10, "http://org", "n"), (10, "http://org", "n"), (11, "http://a.b.c.d.e.org/?/", "n"), (12, "http://org:80/", "n")]
    df = spark.createDataFrame(pages, "page_id long, url string, rule string")
    rules = urls.RULES

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, urls.rule_table(spark, rules)).collect()]
    assert sorted(got, key=repr) == sorted(((i, *brute(u)) for i, u, _ in pages), key=repr)
    assert urls.judge_urls(df.limit(0), urls.rule_table(spark, rules)).count() == 0
    odd = df.withColumnsRenamed({"page_id": "best", "url": "a.b"}).withColumns({"HOST": F.lit(1), "short": F.lit(2), "_0": F.lit(3), "r_host": F.lit(4)})
    again = urls.judge_urls(odd, urls.rule_table(spark, rules), url_col="a.b")
    assert again.columns == ["best", "a.b", "short", "_0", "r_host", "host", "path", "rule", "verdict"] and sorted(((r.best, r.host, r.path, r.rule, r.verdict) for r in again.collect()), key=repr) == sorted(got, key=repr)
    long = spark.createDataFrame([(1, "http://a.org/" + "x" * 200_000), (2, "http://" + "a." * 50_000 + "com/de/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge_urls(long, urls.rule_table(spark, rules)).collect()} == {1: "allow", 2: "block"}
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urls.judge_urls(df, none).collect()} == {"allow"}


def test_quality_learns_grades(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(600):
        kind = i % 3
        text = prose(rng, rng.randrange(20, 200))
        if kind == 0:
            text += " scum " + prose(rng, 20)
        if kind == 1:
            text = " | ".join(text.split())
        rows.append((i, text, "s", 1))
        marks.append((i, int(kind != 1), int(kind == 0)))
    d = spark.createDataFrame(rows, DDL)
    labels = spark.createDataFrame([*marks[:400], (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(d, labels)
    out = {r.doc_id: r for r in quality.score_quality(d, model, ["doc_id", "shard"]).collect()}
    good = [out[i].p_ge2 >= 0.5 for i in range(400, 600) if i % 3 == 2]
    bad = [out[i].p_ge2 >= 0.5 for i in range(400, 600) if i % 3 != 2]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.05
    assert all(0 <= r.p_ge2 <= r.p_ge1 <= 1 and abs(r.expected_grade - r.p_ge1 - r.p_ge2) < 1e-9 for r in out.values())
    assert list(model.thresholds) == sorted(model.thresholds)
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.p_ge2 >= 0.5}


def test_quality_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, labels).count() == docs.count()  # nothing is known against them
    assert quality.keep_good(empty, labels).count() == 0
    assert quality.features(None) == quality.features("")


def brute_simhash(text, width=4):
    words = (text or "").encode().lower().split()
    line = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in line]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_links_exactly(docs, empty):
    got = simhash.near_duplicates(docs, ["doc_id", "text"]).collect()
    prints = [brute_simhash(r.text) for r in got]
    assert [r.f[0] & (1 << 64) - 1 for r in got] == prints
    root = list(range(len(got)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(got)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(got):
        groups[find(i)].append(r.doc_id)
    for i, r in enumerate(got):
        ids = [x for x in groups[find(i)] if x is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert simhash.near_duplicates(empty, ["doc_id"]).count() == 0


def test_covering_masks_miss_no_pair():
    rng = random.Random(5)
    for bits, radius in ((64, 4), (48, 4), (30, 2)):
        masks = simhash.covering_masks(bits, radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            flips = sum(1 << b for b in rng.sample(range(bits), radius))
            assert any(flips & m == 0 for m in masks)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", 12)
    rng = random.Random(9)
    base, prints = rng.getrandbits(62), set()
    for _ in range(150):
        prints.add(simhash._signed(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8)))))
    prints = sorted(prints)
    df = materialize(spark.createDataFrame([(x, [x]) for x in prints], "id long, f array<long>"), "test")
    with Scratch(spark) as keep:
        roots = {r.node: r.root for r in simhash.link_within(df, 64, 4, keep).collect()}
    expected = {x: x for x in prints}
    for _ in prints:
        moved = False
        for i, a in enumerate(prints):
            for b in prints[:i]:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4 and expected[a] != expected[b]:
                    expected[a] = expected[b] = min(expected[a], expected[b])
                    moved = True
        if not moved:
            break
    assert {x: roots.get(x, x) for x in prints} == expected


def test_near_copies_leave_one(spark, docs):
    kept = simhash.drop_near_duplicates(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns
    texts = Counter(r.text for r in rows)
    assert max(texts.values()) == 1
    ids = {r.doc_id for r in rows}
    assert len(ids & (set(range(24, 36)) | {40, 41})) <= 4  # one word edited in 120: similarity 0.85 to 0.92 of each other
    assert set(range(24)) <= ids and sum(r.doc_id == 3 for r in rows) == 1


def test_unlike_texts_of_one_id_stay(spark):
    rng = random.Random(13)
    texts = [prose(rng, 40) for _ in range(8)]
    rows = [(None, t, "s", 1) for t in texts[:4]] + [(7, t, "s", 1) for t in texts[4:7]] + [(8, texts[7], "s", 1), (None, texts[7], "s", 1), (None, texts[0], "s", 1), (7, texts[4], "s", 1)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, DDL)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:7]] + [(8, texts[7])])


def test_similar_texts_meet_and_are_counted(spark):
    """Isolated pairs of similarity 0.80 to 0.82 lose one of the two, pairs of 0.70 to 0.79 none."""
    rng = random.Random(12)
    rows, near, far = [], [], []
    for i in range(120):
        words = [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(404)]
        # A word changed at a distance from the others changes five of the 400 shingles.
        changed = 8 if i < 60 else 10 + i % 4
        other = list(words)
        for k in range(changed):
            other[10 + 20 * k] = f"new{rng.randrange(10**6)}"
        a, b = (set(simhash.shingle_hashes(" ".join(w), 5).tolist()) for w in (words, other))
        (near if len(a & b) / len(a | b) >= 0.8 else far).append(2 * i + 1)
        rows += [(2 * i, " ".join(words), "s", 1), (2 * i + 1, " ".join(other), "s", 1)]
    assert len(near) == len(far) == 60
    ids = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, DDL)).collect()}
    assert sum(i in ids for i in near) <= 1 and all(i in ids for i in far) and all(2 * i in ids for i in range(120))


def test_near_fingerprints_meet_under_covering_masks(spark):
    """Similar texts whose SimHash fingerprints differ in four bits or fewer are found by their covering masks alone."""
    rng = random.Random(29)
    rows, near = [], []
    for i in range(40):
        words = [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(300)]
        other = [*words[:-1], f"new{i}"]
        a, b = (np.unique(simhash.shingle_hashes(" ".join(w), 5)) for w in (words, other))
        if (simhash._majority(a) ^ simhash._majority(b)).bit_count() <= 4:
            near.append(2 * i + 1)
            assert set(simhash.simhash_keys(a)) & set(simhash.simhash_keys(b))
        rows += [(2 * i, " ".join(words), "s", 1), (2 * i + 1, " ".join(other), "s", 1)]
    sets = {r.doc_id: set(r.bands) for r in simhash.shingle_sets(spark.createDataFrame(rows, DDL), ["doc_id"], "text").collect()}
    keys = {i: set(simhash.simhash_keys(np.unique(simhash.shingle_hashes(t, 5)))) for i, t, *_ in rows}
    assert len(near) >= 30 and all(keys[i] <= sets[i] for i in sets) and all(sets[i] & sets[i - 1] & keys[i] for i in near)


def test_cells_rule_out_no_similar_pair(spark):
    """The bound from touched cells holds for every pair whose sets are similar enough, and rules out most others."""
    rng = random.Random(23)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    sets = []
    for _ in range(60):
        other = list(words)
        for k in rng.sample(range(150), rng.randrange(0, 12)):
            other[k] = f"n{rng.randrange(10**6)}"
        sets.append(np.unique(simhash.shingle_hashes(" ".join(other[: rng.randrange(100, 151)]), 5)))
    rows = [(i, len(x), simhash.touched(x)) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "id int, n long, bits array<long>")
    a, b = (df.select(*[F.col(c).alias(f"{c}{i}") for c in df.columns]) for i in "ab")
    kept = {(r.ida, r.idb) for r in a.join(b, (F.col("ida") < F.col("idb")) & simhash._may_fit("bitsa", "bitsb", "na", "nb")).collect()}
    near = {(i, j) for j in range(60) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert near and near <= kept and len(kept) < len(near) + 0.2 * (1770 - len(near))


def test_lm_scores(spark, docs, empty):
    rows = [r for r in docs.collect()]
    got = lm.score_documents(docs).collect()
    assert len(got) == len(rows)
    train = Counter()
    for r in rows:
        if zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 10:
            train.update(lm.tokens(r.text))
    n, v = sum(train.values()), len(train)
    by = defaultdict(list)
    for g in got:
        by[g.doc_id].append(g)
    for r in rows:
        words, g = lm.tokens(r.text), by[r.doc_id][0]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(words), sum(train[w] > 0 for w in words), n)
        assert g.base_score == pytest.approx(base, rel=1e-9) and g.score < 0 and math.isfinite(g.score)
    assert lm.score_documents(empty).count() == 0
    alone = lm.score_documents(spark.createDataFrame([(None, "a b", "s", 1)], DDL)).first()  # held out, nothing to learn from
    assert alone.held_out and alone.train_tokens == 0 and alone.n_known == 0 and math.isfinite(alone.score)


def lm_model(texts, coded=40):
    words = [lm.tokens(x) for x in texts]
    counts = Counter(w for t in words for w in t)
    top = counts.most_common(coded)
    book = lm.Codebook([w for w, _ in top], [c for _, c in top], sum(counts.values()) - sum(c for _, c in top))
    state = lm.Mixer()
    for t in words:
        line = lm.Line.of([t], book)
        state.learn(lm.Contexts(line, book).bits(0, len(t)), len(t))
    return book, state


def brute_word(book, state, text, at):
    """log10 of the probability of word ``at`` of ``text``, decision by decision, without arrays over tokens."""
    line = lm.Line.of([text], book)
    known, word = lm.Contexts(line, book), text[at]
    bits = known.bits(at, at + 1)
    leaf = book.index.get(word, book.escape)
    symbols = [(book.words, int(book.symbol[leaf]))] + ([(book.bytes, b) for b in word + b" "] if leaf == book.escape else [])
    assert bits.bit.tolist() == [int(c.bits[c.starts[x] + d]) for c, x in symbols for d in range(c.sizes[x])]
    total = float(book.words.rest[book.symbol[leaf]])
    for i in range(len(bits.bit)):
        logits, seen = [float(bits.plain[i])], []
        for k in range(lm.TABLES):
            at = i - (len(bits.bit) - len(bits.slots[k]))  # the last table knows spelled bytes only
            n, ones = (int(x) for x in state.counts[k, bits.slots[k][at]]) if at >= 0 else (0, 0)
            logits.append(math.log((ones + 0.3) / (n - ones + 0.3)))
            seen.append(n)
        gate = int(bits.kind[i]) * 12 + sum(seen[1] > x for x in (0, 2, 20)) * 3 + sum(seen[2] > x for x in (0, 3))
        mixed = max(-16, min(16, sum(float(w) * x for w, x in zip(state.weights[:, gate], logits, strict=True))))
        p = 1 / (1 + math.exp(-mixed))
        cell = gate * 33 + int(max(-8, min(8, mixed)) * 2 + 16.5)
        known_p = (float(state.cells[1, cell]) + 4 * p) / (float(state.cells[0, cell]) + 4)
        p = max(1e-6, min(1 - 1e-6, (p + known_p) / 2))
        total += math.log10(p if bits.bit[i] else 1 - p)
    return total


def test_lm_scores_are_the_decisions_of_the_code():
    rng = random.Random(3)
    texts = [prose(rng, 80) for _ in range(40)]
    book, state = lm_model(texts)
    text = lm.tokens(texts[3] + " Newword and é " + texts[4])
    line = lm.Line.of([lm.tokens("x y z"), text], book)  # another text before it does not matter
    known, n = lm.Contexts(line, book), len(text)
    got = state.scores(known.bits(4, 4 + n), n) + book.words.rest[book.symbol[line.leaf[4:]]]
    assert got == pytest.approx([brute_word(book, state, text, i) for i in range(n)], abs=1e-4)
    # The words before a word matter: the same words in another order have other chances.
    shuffled = text[:-1]
    rng.shuffle(shuffled)
    again = lm.Line.of([[*shuffled, b""]], book)
    assert sum(state.scores(lm.Contexts(again, book).bits(0, n), n)) != pytest.approx(sum(state.scores(known.bits(4, 4 + n), n)), rel=1e-3)


def test_lm_decisions_are_probabilities():
    """All coded words and the escape in one place: their probabilities sum to 1."""
    rng = random.Random(3)
    book, state = lm_model([prose(rng, 80) for _ in range(40)])
    before = lm.tokens(prose(rng, 6))[:-1]
    total = 0.0
    for word in book.index:
        total += 10 ** brute_word(book, state, [*before, word], len(before))
    line = lm.Line.of([[*before, b"zzz"]], book)
    bits = lm.Contexts(line, book).bits(len(before), len(before) + 1)
    own = bits.kind < lm.DEEP
    escape = lm.Bits(bits.token[own], bits.bit[own], [x[: own.sum()] if k < 2 else x[:0] for k, x in enumerate(bits.slots)], bits.plain[own], bits.kind[own])
    total += 10 ** (state.scores(escape, 1)[0] + book.words.rest[book.symbol[book.escape]])
    assert total == pytest.approx(1, abs=1e-3)


def test_lm_tells_repeated_documents_apart(spark):
    rng = random.Random(21)
    rows = [(i, prose(rng, 150), "s", 1) for i in range(120)]
    twice = [i for i in range(120) if zlib.crc32(str(i).encode()) % 10 and zlib.crc32(str(i + 1000).encode()) % 10][:8]
    rows += [(i + 1000, rows[i][1], "s", 1) for i in twice]
    got = {r.doc_id: r.bits_per_byte for r in lm.score_documents(spark.createDataFrame(rows, DDL)).collect()}
    doubled = {*twice, *(i + 1000 for i in twice)}
    assert max(got[i] for i in doubled) < min(v for i, v in got.items() if i not in doubled) / 2


def test_lm_states_add_up(spark):
    """Texts in several partitions are counted as in one, and packing loses nothing."""
    texts = [(prose(random.Random(i), 60),) for i in range(20)]
    book, _ = lm_model([t for t, in texts])
    passes = [lm.learn_and_score(spark.createDataFrame([(i, t) for i, (t,) in enumerate(texts)], "doc_id int, text string").repartition(k).withColumn("part", F.spark_partition_id().cast("long")), book, np.zeros(41)).cache() for k in (1, 5)]
    one, many = (lm.merged(p.filter("block is not null").select("block", "data", "row")) for p in passes)
    assert all(p.filter("block is null").count() == len(texts) for p in passes)
    assert (one.counts == many.counts).all() and one.behind.sum() == many.behind.sum() and one.cells[0].sum() == many.cells[0].sum()
    assert np.abs(one.weights - many.weights).max() < 0.5


def test_lm_beats_base_on_held_out(spark):
    """Words that follow each other by rules: held-out documents that have no copy score above the base, nine in ten at least."""
    rng = random.Random(5)
    follow = {w: rng.sample(WORDS, 3) for w in WORDS}
    rows = []
    for i in range(400):
        words = [rng.choice(WORDS)]
        while len(words) < 150:
            words.append(rng.choice(follow[words[-1]]))
        rows.append((i, " ".join(words), "s", 1))
    got = [r for r in lm.score_documents(spark.createDataFrame(rows, DDL)).collect() if r.held_out]
    assert np.mean([r.score > r.base_score for r in got]) >= 0.9 and sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)


def test_lm_scores_do_not_hang_on_the_layout(spark, docs, monkeypatch):
    """Other partitions, batches and shuffles give the same scores, over several parts as well."""
    monkeypatch.setattr(lm, "PART_TOKENS", 2_000)
    monkeypatch.setattr(lm, "FIRST_TOKENS", 900)
    score = lambda d: sorted((r.doc_id is None, r.doc_id, r.n_tokens, round(r.score, 6)) for r in lm.score_documents(d).collect())
    one = score(docs.coalesce(1))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        other = score(docs.repartition(6))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    assert [x[1:] for x in one] == [x[1:] for x in other]


def test_mixing(spark, docs, empty):
    got = mixing.sample_mix(docs).collect()
    assert len(got) == docs.count()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(re.findall(mixing.WORD, r.text or ""))
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, free, target = float(sum(sizes.values())), set(sizes), {}
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: weights[s] * level for s in free}
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.repeats <= 3
        taken[r.source] += r.size * r.repeats
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= largest for s in sizes)
    key = lambda r: (r.doc_id or -1, r.source or "", r.size, r.repeats)
    assert sorted(map(key, got)) == sorted(map(key, mixing.sample_mix(docs.repartition(7)).collect()))
    kept = mixing.sample_mix(docs, keep_rows=True)
    assert kept.columns == docs.columns and kept.count() == sum(r.repeats for r in got)
    assert mixing.sample_mix(empty).count() == 0 and mixing.sample_mix(empty, keep_rows=True).count() == 0
    assert "Python" not in mixing.sample_mix(docs)._jdf.queryExecution().toString()


def brute_likeness(a, b):
    """The longest common subsequence of numbered anchors, by its table, over all anchors of both."""
    lines = []
    for text in (a, b):
        seen, line = Counter(), []
        for h in syncmers.closed_syncmers(text.encode())[1].tolist():
            line.append((h, seen[h]))
            seen[h] += 1
        lines.append(line)
    one, two = lines
    if not one and not two:
        return 1.0
    row = [0] * (len(two) + 1)
    for x in one:
        new = [0]
        for j, y in enumerate(two):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1] / (len(one) + len(two) - row[-1])


def test_syncmers(docs, empty):
    rng = random.Random(2)
    a, b = prose(rng, 400).encode(), prose(rng, 400).encode()
    shared = prose(rng, 60).encode()
    for left, right in ((a, b), (b, a)):
        one, two = {h for h in syncmers.closed_syncmers(left + shared)[1]}, {h for h in syncmers.closed_syncmers(shared + right)[1]}
        inner = {h for h in syncmers.closed_syncmers(shared)[1]}
        assert inner and inner <= one and inner <= two  # free of context
    data = a[:300]
    h = syncmers._mix(np.array([int.from_bytes(data[i : i + 8], "little") for i in range(len(data) - 7)], np.uint64))
    brute = [i for i in range(len(data) - 23) if h[i : i + 17].min() in (h[i], h[i + 16])]
    assert syncmers.closed_syncmers(data)[0].tolist() == brute
    got = syncmers.fingerprint_neighbours(docs).collect()
    rows = sorted(docs.collect(), key=lambda r: (-(r.doc_id if r.doc_id is not None else -(1 << 63)), r.text or ""))
    texts = [r.text or "" for r in rows]
    digests = Counter(hashlib.sha256(syncmers.edited(t, n).encode()).hexdigest() for t, n in zip(texts, texts[1:] + texts[:1], strict=True))
    assert Counter(r.edited_sha256 for r in got) == digests
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({(r.n_chars, r.fingerprint) for r in got}) == len(set(texts))
    following = dict(zip(texts, texts[1:] + texts[:1], strict=True))
    for r in got:
        data = next(t for t in texts if len(t) == r.n_chars and syncmers._text(syncmers.sketch(t.encode())) == r.fingerprint)
        if texts.count(data) == 1:
            assert r.near_next == pytest.approx(brute_likeness(data, following[data])) and r.near_edited == pytest.approx(brute_likeness(data, syncmers.edited(data, following[data])))
    assert syncmers.fingerprint_neighbours(empty).count() == 0
    one = syncmers.fingerprint_neighbours(docs.filter("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_long_texts_match_by_position():
    """An edit in the middle of a long text shows, a shared passage shows, and so does order."""
    rng = random.Random(5)
    text, other, passage = (prose(rng, n).encode() for n in (12000, 12000, 40))
    middle = len(text) // 2
    changed = text[:middle] + prose(rng, 12).encode()[:80] + text[middle + 80 :]
    one, two = syncmers.sketch(text), syncmers.sketch(changed)
    assert syncmers._text(one) != syncmers._text(two) and 0.99 < syncmers.likeness(one, two) < 1
    apart = syncmers.likeness(one, syncmers.sketch(other))
    shared = syncmers.likeness(syncmers.sketch(text[:middle] + passage + text[middle:]), syncmers.sketch(other[:99] + passage + other[99:]))
    assert shared > apart
    swapped = syncmers.likeness(one, syncmers.sketch(text[middle:] + text[:middle]))
    assert 0.3 < swapped < 0.4
    at, hashes = syncmers.closed_syncmers(text)
    assert len(syncmers._text(one)) == 24 * len(at) and syncmers._text(one)[-24:] == f"{hashes[-1]:016x}{at[-1]:08x}"


def test_every_text_has_an_anchor():
    rng = random.Random(4)
    texts = [prose(rng, 12).encode()[:size] for size in range(1, 45) for _ in range(20)] + [b"Antion onertion inhash thon of."]
    assert sum(not len(syncmers.closed_syncmers(t)[1]) for t in texts) == 0
    assert syncmers.likeness(syncmers.sketch(texts[-1]), syncmers.sketch(b"other words, of equal length...")) < 1


def brute_repeats(texts, window):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[p : p + window] for d in data for p in range(len(d) - window + 1))
    return [repeats.merged([(p, p + window) for p in range(len(d) - window + 1) if counts[d[p : p + window]] > 1]) for d in data]


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(docs, empty, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(repeats, "HOT", 1)
    rows = docs.collect()
    got = repeats.remove_repeats(docs, ["doc_id", "text"]).collect()
    expected = Counter((r.doc_id, tuple(s), len((r.text or "").encode())) for r, s in zip(rows, brute_repeats([r.text for r in rows], 200), strict=True))
    assert Counter((r.doc_id, tuple((s.start, s.end) for s in r.spans), r.n_bytes) for r in got) == expected
    for r in got:
        data = (r.text or "").encode()
        gone = {p for s in r.spans for p in range(s.start, s.end)}
        assert bytes(r.kept) == bytes(c for p, c in enumerate(data) if p not in gone)
    assert repeats.remove_repeats(empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_repeat_groups_hold_all_occurrences(docs, empty, hot, monkeypatch):
    """Each group's bytes stand exactly where it says, copies included, and together the groups cover what is removed."""
    if hot:
        monkeypatch.setattr(repeats, "HOT", 1)
    rows = [r for r in docs.collect() if r.doc_id is not None]
    data = [(r.doc_id, (r.text or "").encode()) for r in rows]
    groups = defaultdict(list)
    for r in repeats.repeat_groups(docs.filter("doc_id is not null")).collect():
        groups[r.group, r.length].append((r.doc, r.start))
    first = dict(data)
    covered = defaultdict(set)
    for (_, length), places in groups.items():
        doc, start = places[0]
        string = first[doc][start : start + length]
        assert length >= 200 and len(string) == length
        assert Counter(places) == Counter((d, m) for d, t in data for m in range(len(t) - length + 1) if t.startswith(string, m))
        for d, p in places:
            covered[d].update(range(p, p + length))
    expected = {d: {p for a, b in spans for p in range(a, b)} for (d, _), spans in zip(data, brute_repeats([t for _, t in [(r.doc_id, r.text) for r in rows]], 200), strict=True)}
    assert {d: covered[d] for d in expected} == expected
    assert repeats.repeat_groups(empty).count() == 0


def test_maximal_repeats_are_left_diverse():
    shared = prose(random.Random(4), 60).encode()[:250]
    found = list(repeats.maximal_repeats([b"x" + shared + b"1", b"y" + shared + b"2", b"z" + shared + b"3"], 200))
    assert [(n, sorted(p.tolist())) for n, p in found if n == 250] == [(250, [1, 254, 507])]
    assert all(n >= 200 for n, _ in found)


def test_shards(spark, docs, empty):
    got = shards.shard_by_bytes(docs, 8).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    largest, total = max(r.size for r in got), sum(sizes.values())
    assert total == sum(len((r.text or "").encode()) + 1 for r in docs.collect())
    assert all(abs(sizes[s] - total / 8) <= largest for s in range(8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {(r.doc_id, r.text_crc32) for r in got} == {(r.doc_id, None if r.text is None else zlib.crc32(r.text.encode())) for r in docs.collect()}
    rows = shards.shard_rows(docs, 8)
    assert rows.columns == ["doc_id", "text", "source", "shard", "slot"]
    assert Counter((r.shard, r.slot) for r in rows.collect()) == Counter((r.shard, r.slot) for r in got)
    assert shards.shard_by_bytes(empty, 8).count() == 0 and shards.shard_rows(empty, 8).count() == 0


def brute_edit(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(40):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 70)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 90)))
        assert decontaminate.edit_distance_within(p, t)[0] == brute_edit(p, t)


def test_leaks_are_found(spark, empty):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(12, 60))) for i in range(60)] + [(60, None), (61, ""), (62, "short"), (63, "sixteen bytes or so here")]
    rows = [(i, prose(rng, 150), "s", 1) for i in range(40)] + [(1000, None, "s", 1), (1001, "", "s", 1), (1002, "SIXTEEN  bytes\nor so HERE", "s", 1)]
    for i, text in items[:60]:
        words = text.split()
        exact = prose(rng, 30) + "\n" + text.upper() + " " + prose(rng, 30)
        for k in rng.sample(range(len(words)), max(1, len(words) // 25)):
            words[k] = words[k][:-1]
        rows += [(2000 + i, exact, "s", 1), (3000 + i, prose(rng, 30) + " " + " ".join(words) + " " + prose(rng, 30), "s", 1)]
    d = spark.createDataFrame(rows, DDL)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(d, bench, ["doc_id"]).collect()}
    for i in range(60):
        assert got[2000 + i, i] == 0
    assert np.mean([(3000 + i, i) in got for i in range(60)]) >= 0.9
    assert (1002, 63) in got and not any(doc < 1000 for doc, _ in got)
    text_of, item_of = {r[0]: r[1] for r in rows}, dict(items)
    for (doc, item), distance in got.items():
        assert distance <= 0.1 * len(decontaminate.normalise(item_of[item]))
        assert decontaminate.edit_distance_within(decontaminate.normalise(item_of[item]), decontaminate.normalise(text_of[doc]))[0] <= distance
    kept = decontaminate.drop_leaks(d, bench)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {doc for doc, _ in got}
    assert decontaminate.find_leaks(empty, bench, ["doc_id"]).count() == 0 and decontaminate.find_leaks(d, bench.limit(0), ["doc_id"]).count() == 0


def edited_bytes(rng, text, edits, kinds):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.choice(kinds)
        out[at : at + (kind != "insert")] = [] if kind == "delete" else [rng.choice("abcdefghij")]
    return "".join(out)


@pytest.mark.parametrize("size", [10, 13, 16, 24, 39, 40, 90, 240, 390])
def test_leaks_against_brute_force(size):
    """Items with 5 to 10% of their bytes edited, some behind punctuation: found as brute force over all items finds them."""
    rng = random.Random(size)
    items = [(i, prose(rng, 80)[:size].strip().ljust(size, "x")) for i in range(24)]
    texts = []
    for i, item in items:
        k = max(1, int(size * (0.05, 0.08, 0.1)[i % 3]))
        texts.append(prose(rng, 12) + (" ", " (", "-")[i % 3 - 1] + edited_bytes(rng, item, k, ["change"] if i % 2 else ["change", "insert", "delete"]) + ", " + prose(rng, 12))
    index = decontaminate.WalkIndex(items, 3, 0.1, 7)
    got = {(row, item): d for row, item, d, _ in index.matches(texts)}
    brute = {}
    for row, text in enumerate(texts):
        for n, (_, item) in enumerate(items):
            d = decontaminate.edit_distance_within(decontaminate.normalise(item), decontaminate.normalise(text))[0]
            if d <= int(len(decontaminate.normalise(item)) * 0.1):
                brute[row, n] = d
    assert len(brute) >= 20 and got == brute


@pytest.mark.parametrize("rate", [0.0, 0.04, 0.08, 0.1])
def test_walks_alone_and_grams_alone(rate):
    """Without the grams the walks still find nine in ten of what brute force finds, up to the accepted distance; without the walks nothing is missed either."""
    rng = random.Random(17)
    items = [(i, prose(rng, 80)[: rng.choice([40, 90, 240, 390])].strip()) for i in range(80)]
    texts = []
    for _, item in items:
        texts.append(prose(rng, 15) + " " + edited_bytes(rng, item, int(len(item) * rate), ["change", "insert", "delete"]) + " " + prose(rng, 15))
    index = decontaminate.WalkIndex(items, 2, 0.1, 7)
    whole = set(index.matches(texts))
    assert {(i, i) for i in range(80)} <= {(row, item) for row, item, _, _ in whole}
    walks = index.candidates
    index.candidates = lambda line, starts: set()
    assert set(index.matches(texts)) == whole
    index.candidates, index.grams.candidates = walks, lambda line: iter(())
    alone = set(index.matches(texts))
    assert {(row, item) for row, item, _, _ in alone} <= {(row, item) for row, item, _, _ in whole} and len(alone) >= 0.9 * len(whole)


def test_short_leaks(spark):
    d = spark.createDataFrame([(1, "It is (Red  Stone), so", "s", 1), (2, "scarred stones", "s", 1), (3, "red stone", "s", 1), (4, None, "s", 1), (5, "a scarred stone, a red stone", "s", 1), (6, "éred stone", "s", 1)], DDL)
    bench = spark.createDataFrame([(1, "red stone"), (2, "RED stone "), (3, ""), (4, None), (5, "it")], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.distance, r.end_byte) for r in decontaminate.find_leaks(d, bench, ["doc_id"]).collect()]
    assert sorted(got) == [(1, 1, 0, 16), (1, 2, 0, 16), (1, 5, 0, 2), (3, 1, 0, 9), (3, 2, 0, 9), (5, 1, 0, 28), (5, 2, 0, 28)]
    assert {r.doc_id for r in decontaminate.drop_leaks(d, bench).collect()} == {2, 4, 6}


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "item_blocks", lambda items, i, t, block_bytes=10: iter([[(r[0], r[1])] for r in items.select(i, t).collect()]))
    text = prose(random.Random(1), 40)
    d = spark.createDataFrame([(1, "x " + text, "s", 1), (2, "clean", "s", 1)], DDL)
    bench = spark.createDataFrame([(1, text), (2, text)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, bench, ["doc_id"]).collect()) == [(1, 1), (1, 2)]


def brute_base(text):
    """The base kinds, character by character."""
    value_chars = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if "".join(c.lower() if c.isascii() else c for c in text[i : i + len(word)]) != word:
                continue
            j = i + len(word)
            for quote in (1, 0):  # each quote is taken if it can be
                k = j + (quote and text[j : j + 1] in ("'", '"') and text[j : j + 1] != "")
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] not in (":", "=") or not text[k : k + 1]:
                    continue
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                for start in (k + 1, k) if text[k : k + 1] in ("'", '"') and text[k : k + 1] else (k,):
                    end = start
                    while end < len(text) and text[end] in value_chars:
                        end += 1
                    if end > start:
                        return end, end - start
        return None

    def run(i, prefix, chars):
        end = i + len(prefix)
        if not text.startswith(prefix, i):
            return None
        while end < len(text) and text[end] in chars:
            end += 1
        return (end, end - i) if end > i + len(prefix) else None

    upper, low_hex = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), set("0123456789abcdef")
    found = []
    for kind, match, least in (("assign", assign, 12), ("access", lambda i: run(i, "AKIA", upper), 18), ("hex", lambda i: run(i, "", low_hex), 16)):
        i = 0
        while i < len(text):
            m = match(i)
            if m and m[1] >= least:
                found.append((kind, i, m[0]))
            i = m[0] if m else i + 1
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_against_brute_force():
    rng = random.Random(31)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "ſecret", "'", '"', " ", ":", "=", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef", "Ab1+/_.=-xyz", "é", "\n", "tokentoken", "x" * 12]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert [(k, a, b) for k, a, b, _ in secrets.base_spans(text)] == brute_base(text), text


def test_ownership_decides(spark):
    """Values of one owner in few repositories look live; those of two owners, or all over one owner's repositories, are copied."""
    live, shared, spread = ("Zq8kP2mVx7Lr4TnB9wYc3D" + c for c in "abc")
    rows = [(i, f"{spread} here", "s1", 1) for i in range(11)] + [(20 + i, f"{live} here", "s2", 1) for i in range(10)] + [(40, shared, "s1", 1), (41, shared, "s2", 1)]
    got = secrets.scan_secrets(spark.createDataFrame(rows, DDL), ["doc_id"], "doc_id", "source").collect()
    assert all((r.n_live, r.n_copied, len(r.owned)) == ((1, 0, 1) if 20 <= r.doc_id < 40 else (0, 1, 0)) for r in got)


def test_secrets(spark, empty):
    key, copied = "ghp_" + "aB3" * 12, "Zq8kP2mVx7Lr4TnB9wYc3D"
    rows = [
        (1, f'Password = "{"p" * 12}" token: short AKIA{"A1" * 8} deadbeefdeadbeef', "s1", 1),
        (2, f"{key} and {copied}", "s1", 1),
        (3, copied, "s2", 1),
        (4, None, "s2", 1),
        (5, "", None, 1),
        (6, "paſſword=abcdefghijklmnop toKen=token=abcdefghijkl é api-key:x", None, 1),
        (6, "x" * 50000 + " 0123456789abcdef0", "s1", 1),
    ]
    got = {(r.doc_id, len(r.base)): r for r in secrets.scan_secrets(spark.createDataFrame(rows, DDL), ["doc_id"], "doc_id", "source").collect()}
    spans = lambda r: [(s.kind, s.start, s.end) for s in r.base]
    text = rows[0][1]
    assert spans(got[1, 3]) == [("assign", 0, 24), ("access", text.index("AKIA"), text.index("AKIA") + 20), ("hex", len(text) - 16, len(text))]
    assert [(s.kind, s.start, s.end) for s in got[2, 0].owned] == [("owned", 0, 40)]  # the other value has two owners
    assert got[2, 0].n_copied == 1 and got[3, 0].n_copied == 1 and not got[3, 0].owned
    long_ = secrets.scan_secrets(spark.createDataFrame(rows[-2:], DDL), ["doc_id"], "doc_id", "source").collect()
    assert sorted(spans(r) for r in long_) == sorted(brute_base(x[1]) for x in rows[-2:])
    for _, text, _, _ in rows:
        assert [(k, a, b) for k, a, b, _ in secrets.base_spans(text or "")] == brute_base(text or "")
    assert secrets.scan_secrets(empty, ["doc_id"], "doc_id", "source").count() == 0
    listed = spark.createDataFrame([(1,)], "i int").select(secrets.listed(F.expr("array(struct('hex' kind, 5L start, 9L end), struct('assign' kind, 5L start, 20L end), struct('access' kind, 1L start, 3L end))")).alias("l")).first().l
    assert listed == "access:1:3,assign:5:20,hex:5:9"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    item = prose(rng, 40)
    rows, marks = [], []
    for i in range(240):
        text = prose(rng, rng.randrange(30, 120)) + (" scum" if i % 4 == 0 else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        marks.append((i, 1, int(i % 4 == 0)))
    rows += [(300, rows[1][1], "en", "s0", 1), (301, rows[2][1] + " more", "en", "s0", 1), (302, prose(rng, 20) + " " + item + " " + prose(rng, 20), "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert not any(i % 4 == 0 for i in ids if i < 240) and not ids & {300, 301, 302}
    assert len(ids) > 60 and max(Counter(r.doc_id for r in got).values()) <= 3
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]


def test_pipeline_edge_cases(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, odd names, an empty table, no labels and no benchmark, through all stages."""
    import corpus_pipeline

    rng = random.Random(17)
    odd = "`cut` int, `row` string, `a.b` int, `shard` int"
    rows = [(i, prose(rng, 40), "en", f"s{i % 3}", 10, i, "r", 1, 9) for i in range(30)]
    rows += [(None, None, None, None, None, None, None, None, None), (None, "", None, "s1", 0, 1, "x", 2, 9), (31, " \n", "en", None, 3, 1, "x", 2, 9), rows[4], rows[4], (32, prose(rng, 30000), "de", "s0", 1, 1, "x", 2, 9), (5, "another text of the same id", "en", "s1", 1, 1, "x", 2, 9)]
    ddl = f"doc_id long, text string, lang string, source string, n_chars long, {odd}"
    for name, data in (("full", rows), ("empty", [])):
        root = tmp_path / name
        spark.createDataFrame(data, ddl).write.parquet(str(root / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
        docs = spark.read.parquet(str(root / "documents.parquet"))
        for stage, function in corpus_pipeline.STAGES[:-1]:
            assert function(spark, docs, str(root)).columns == docs.columns, stage
        got = corpus_pipeline.run(spark, str(root))
        assert got.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
        out = got.collect()
        if not data:
            assert out == []
            continue
        kept = {r.text for r in out}
        sized = {r[1] for r in rows if r[1] and r[1].split()}
        # The first row of equal or wordless texts stays; texts without words have no size, so a mix of one epoch or more takes them as often as their source.
        assert kept - {None, "", " \n"} <= sized and len(sized - kept) <= len(sized) / 2
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


CLASHES = ["cut", "whole", "cell", "copies", "f", "score", "hash", "row", "id", "tie", "part", "_id", "_tie", "_text", "k", "times", "spans", "item_id", "base", "word", "a.b"]


def test_clashing_names_and_string_ids(spark, docs):
    """Tables whose columns are named like working columns or results, and whose ids are strings or null."""
    rows = [(None if r.doc_id is None else f"n{r.doc_id:03}", r.text, r.source, *[i + j for j in range(len(CLASHES))]) for i, r in enumerate(docs.limit(30).collect())]
    rows += [(None, "Some words that no other text has.", None, *[0] * len(CLASHES))]
    d = spark.createDataFrame(rows, "doc_id string, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASHES))
    named = {(r[0], r[1]): r for r in d.collect()}

    def same(rows, columns):
        assert all(tuple(r[c] for c in columns) == tuple(named[r["doc_id"], r["text"]][c] for c in columns) for r in rows)

    whole = mixing.sample_mix(d, keep_rows=True)
    assert whole.columns == d.columns
    same(whole.collect(), d.columns)
    sharded = shards.shard_rows(d, 3)
    assert sharded.columns == [*d.columns, "shard", "slot"] and sharded.count() == d.count()
    same(sharded.collect(), d.columns)
    left = simhash.drop_near_duplicates(d)
    assert left.columns == d.columns
    same(left.collect(), d.columns)
    found = simhash.near_duplicates(d, d.columns).collect()
    assert len(found) == len(rows)
    same(found, [c for c in d.columns if c != "f"])
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0]], "doc_id string, quality int, toxic int")
    model = quality.train(d, labels)
    same(quality.score_quality(d, model, d.columns).collect(), [c for c in d.columns if c != "score"])
    assert quality.keep_good(d, labels).columns == d.columns
    found = secrets.scan_secrets(d, d.columns, "hash", "f").collect()
    same(found, [c for c in d.columns if c != "base"])
    found = repeats.remove_repeats(d, d.columns).collect()
    same(found, [c for c in d.columns if c != "spans"])
    assert repeats.repeat_groups(d).columns == ["group", "length", "doc", "start"]
    bench = spark.createDataFrame([("x", rows[0][1])], "item_id string, text string")
    leaks = decontaminate.find_leaks(d, bench, d.columns).collect()
    assert {r.item_id for r in leaks} == {"x"}
    same(leaks, [c for c in d.columns if c != "item_id"])
    assert decontaminate.drop_leaks(d, bench).columns == d.columns
    assert {r.doc_id for r in syncmers.fingerprint_neighbours(d).collect()} == {r[0] for r in rows}
    assert {r.doc_id for r in shards.shard_by_bytes(d, 3).collect()} == {r[0] for r in rows}
    assert {r.doc_id for r in lm.score_documents(d).collect()} == {r[0] for r in rows}


def test_ordinal_slopes_and_fit():
    """The slopes are those of the likelihood, by differences; the fit is a minimum of it along them."""
    rng = np.random.default_rng(5)
    y, score, theta = rng.integers(0, 3, 50), rng.normal(size=50), np.array([-0.5, 0.8])
    at = lambda s, t: quality.loss(quality.OrdinalModel({}, tuple(t)), s, y)
    by_row, by_threshold = quality._slopes(score, theta, y)
    for i in range(50):
        step = np.eye(50)[i] * 1e-5
        assert by_row[i] / 50 == pytest.approx((at(score + step, theta) - at(score - step, theta)) / 2e-5, abs=1e-6)
    for k in range(2):
        step = np.eye(2)[k] * 1e-5
        assert by_threshold[k] == pytest.approx((at(score, theta + step) - at(score, theta - step)) / 2e-5, abs=1e-6)
    lengths = rng.integers(1, 6, 400)
    flat = rng.integers(0, 12, lengths.sum())
    grades = np.clip((np.add.reduceat(flat < 4, np.cumsum(lengths) - lengths) + rng.integers(0, 2, 400)) // 2, 0, 2)
    model = quality.fit(flat, lengths, grades, 3, l1=0, l2=0)
    scores = np.add.reduceat(np.array([model.weights.get(int(f), 0.0) for f in flat]), np.cumsum(lengths) - lengths)
    best = quality.loss(model, scores, grades)
    assert list(model.thresholds) == sorted(model.thresholds) and best < 0.8 * quality.loss(quality.OrdinalModel({}, model.thresholds), scores * 0, grades)
    for k in range(2):
        for step in (-0.1, 0.1):
            moved = list(model.thresholds)
            moved[k] += step
            assert quality.loss(quality.OrdinalModel({}, tuple(moved)), scores, grades) > best - 0.01  # few, dense features are learned slowly


def test_shards_of_many_repeated_rows(spark):
    """A row that stands thousands of times is cut across shards, with gapless slots."""
    d = spark.createDataFrame([(1, "same text", "s", 1)] * 3000 + [(i, "other", "s", 1) for i in range(2, 40)], DDL).repartition(6)
    got = shards.shard_rows(d, 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 3038 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) < 60


def test_quality_fit_widens_a_chunk_at_a_time(monkeypatch):
    """What the driver holds for the fit grows by some twenty bytes an occurrence, not by copies of eight."""
    monkeypatch.setattr(quality, "CHUNK", 1 << 14, raising=False)
    rng, rows, each = np.random.default_rng(5), 2000, 200
    flat = np.sort(rng.zipf(1.2, (rows, each)) % 50_000, axis=1).astype(np.int32).ravel()
    grades = rng.integers(0, 3, rows)
    tracemalloc.start()
    try:
        model = quality.fit(flat, np.full(rows, each), grades, 3, steps=50)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.weights and peak < 28 * len(flat), peak / len(flat)


def test_lm_code_tables_are_small_and_words_are_found_by_column():
    """A decision takes a few bytes of the broadcast code, and a word that is longer, shorter or not there at all has its place or the escape."""
    words = [b"w%d" % i for i in range(5000)] + [b"", "é".encode()]
    book = lm.Codebook.of_parts(lm.Codebook(words, list(range(6000, 6000 - len(words), -1)), 10).parts())
    code = book.words
    assert code.nodes.nbytes + code.bits.nbytes <= 3 * len(code.bits) and len(code.plain) == len(code.depth) == code.nodes.max() + 1
    asked = [b"w7", b"", b"w", b"w77777", "é".encode(), b"w4999"]
    assert book.leaves(asked, np.array([len(w) for w in asked])).tolist() == [7, 5000, book.escape, book.escape, 5001, 4999]
    assert book.leaves([], np.zeros(0, np.int64)).tolist() == []
