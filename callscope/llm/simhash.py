"""Near-duplicates by SimHash and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.common import Scratch, materialize, named, others, shuffle_partitions, small_batches, whole_row
from callscope.operators.components import components

#: Buckets of up to this many fingerprints of one block are compared pair by pair inside a join, which costs
#: less than 500 rows of midpoints for each member.
SMALL_BUCKET = 2000

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_GOLDEN = 0x9E3779B97F4A7C15


def _majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; 0 if there are none."""
    parts = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(parts[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _spread(hashes: np.ndarray, block: int) -> np.ndarray:
    """Another 64 bits of each hash; block 0 is the hash itself."""
    if not block:
        return hashes
    z = hashes + np.uint64((_GOLDEN * block) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, repeats included; of all words if they are fewer; none of none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - width].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def simhash(docs: DataFrame, keep: list[str], width: int = 4, blocks: int = 1, bits: int = 64, text_col: str = "text") -> DataFrame:
    """``keep`` and ``f``, an array of ``blocks`` fingerprints of ``bits`` bits each (as signed longs)."""
    small_batches(docs.sparkSession)
    source = docs.select(*keep, F.col(text_col).alias("_text"))
    mask = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(len(keep)):
                h = shingle_hashes(text.as_py(), width)
                row = [_majority(_spread(h, b)) & mask for b in range(blocks)]
                out.append([x - (1 << 64) if x >> 63 else x for x in row])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.list_(pa.int64()))], names=[*keep, "f"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return source.mapInArrow(run, f"{fields}f array<bigint>")


def covering_masks(bits: int, radius: int) -> list[int]:
    """2^(radius+1) - 1 masks over ``bits`` bits.

    Bit i belongs to vector p(i) = i mod (2^(radius+1) - 1) + 1 over GF(2); mask v keeps the bits with
    an odd inner product p(i).v. The vectors of ``radius`` differing bits never span the whole space,
    so some v is orthogonal to all of them: its mask keeps none of these bits, and the two
    fingerprints agree on the rest. Every pair within the radius so meets in some table.
    """
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets(prints: DataFrame, blocks: range, bits: int, radius: int, *more: str) -> DataFrame:
    """(bucket, id, t, more): each fingerprint under its kept bits, once for each block and mask; t numbers these."""
    masks = covering_masks(bits, radius)
    tables = F.array(*[F.struct(F.lit(b * len(masks) + t).alias("t"), F.lit(b + 1).alias("b"), F.lit(_signed(m)).alias("m")) for b in blocks for t, m in enumerate(masks)])
    # Few rows become many: more tasks than the small input would have by itself.
    spread = prints.repartition(shuffle_partitions(prints.sparkSession))
    each = spread.select("id", "f", *more, F.explode(tables).alias("k"))
    return each.select(F.xxhash64(F.col("k.t"), F.expr("element_at(f, k.b) & k.m")).alias("bucket"), "id", F.col("k.t").alias("t"), *more)


def _pairs(found: DataFrame) -> DataFrame:
    return found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_within(prints: DataFrame, bits: int, radius: int, keep: Scratch) -> DataFrame:
    """(node, root): components of fingerprints of one block that differ in at most ``radius`` bits. No link is lost.

    ``prints``: (id, f), one row for each distinct fingerprint, ``id`` the fingerprint itself,
    already written. Buckets of two give their pair at once, those of up to 2000 all their links. In
    larger ones every member meets the least member, and what that leaves in several components is
    settled by midpoints: two fingerprints within 4 share a midpoint within 2 of both, so members
    are grouped under all their midpoints in the masked-out bits, about 500 rows for each member
    whatever the bucket's size.
    """
    each = buckets(prints, range(1), bits, radius)
    sizes = keep(each.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("t").alias("t")).filter("n > 1"), "sim-sizes")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    counts = sizes.agg(F.count(F.when(F.col("n") > 2, 1)), F.count(F.when(F.col("n") > SMALL_BUCKET, 1))).first()
    found = sizes.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    members = None
    if counts[0]:
        members = keep(each.drop("t").join(sizes.filter("n > 2"), "bucket").select("bucket", "id", "t", "n", "lo"), "sim-members")
        small = members.filter(F.col("n") <= SMALL_BUCKET)
        a, b = small.select("bucket", F.col("id").alias("a")), small.select("bucket", F.col("id").alias("b"))
        found = found.union(a.join(b, (a["bucket"] == b["bucket"]) & (F.col("a") < F.col("b")) & near("a", "b")).select("a", "b"))
        found = found.union(members.select(F.col("lo").alias("a"), F.col("id").alias("b")))
    edges = keep(_pairs(found).filter(near("a", "b")), "sim-edges")
    if not counts[1]:
        return components(edges)
    labels = components(edges)
    open_ = _open(members.filter(F.col("n") > SMALL_BUCKET).drop("n"), labels, keep)
    more = _midpoint_pairs(open_, covering_masks(bits, radius), bits, radius, keep)
    return components(edges.union(_pairs(more).filter(near("a", "b"))))


def _open(members: DataFrame, labels: DataFrame, keep: Scratch) -> DataFrame:
    """Members of the buckets that still hold several components, with their roots."""
    kept = [c for c in ("bucket", "id", "t", "n", "bits") if c in members.columns]
    rooted = members.drop("root").join(labels, F.col("id") == F.col("node"), "left").select(*kept, F.coalesce("root", "id").alias("root"))
    rooted = keep(rooted, "sim-rooted")
    split = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("bucket")
    out = keep(rooted.join(split, "bucket"), "sim-open")
    keep.drop(rooted)
    return out


def _midpoint_pairs(open_: DataFrame, masks: list[int], bits: int, radius: int, keep: Scratch) -> DataFrame:
    """Pairs (a, b) of members of a large bucket that share a midpoint; ids are the fingerprints.

    The flips are those of up to half the radius in the bits that the bucket's mask leaves out: a
    table whose size is fixed by bits and radius.
    """
    flips = []
    for t, mask in enumerate(masks):
        free = [1 << i for i in range(bits) if not mask >> i & 1]
        for k in range(radius // 2 + 1):
            flips += [(t, _signed(sum(c))) for c in combinations(free, k)]
    flipped = open_.sparkSession.createDataFrame(flips, "t int, flip long")
    under = open_.join(F.broadcast(flipped), "t").select("bucket", "id", F.col("id").bitwiseXOR(F.col("flip")).alias("z"))
    # Under a midpoint all are within the radius of the least one; a minimum needs no group in one task.
    least = keep(under.groupBy("bucket", "z").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1"), "sim-middle")
    return under.join(least.select("bucket", "z", "a"), ["bucket", "z"]).select("a", F.col("id").alias("b"))


def near_duplicates(docs: DataFrame, keep: list[str], width: int = 4, bits: int = 64, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``keep``, ``f`` (its fingerprint, an array of one) and ``component_id``.

    ``component_id`` is the smallest id of all documents reachable over links, itself included.
    Texts without words, null ones too, have fingerprint 0 and are linked like any others; very long
    texts give all their shingles. Rows with a null id take part and do not lend their id; a component
    of null ids only has a null ``component_id``. Repeated rows each get their row, ids may repeat and
    be of any ordered type, and an empty table gives no rows. Equal fingerprints are one node, so
    copies never become pairs. Kept columns named ``f`` or ``component_id`` are replaced.
    """
    keep = others(keep, ("f", "component_id"))
    spare = [f"_k{i}" for i in range(len(keep))]
    own = docs.select(*[named(c).alias(s) for c, s in zip(keep, spare, strict=True)], named(id_col).alias("_id"), named(text_col).alias("_text"))
    with Scratch(docs.sparkSession) as hold:
        printed = materialize(simhash(own, [*spare, "_id"], width, 1, bits, "_text"), "sim-docs")
        nodes = hold(printed.groupBy("f").agg(F.min("_id").alias("least")).withColumn("id", F.col("f")[0]), "sim-nodes")
        roots = link_within(nodes.select("id", "f"), bits, radius, hold)
        merged = nodes.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
        merged = hold(merged.select("f", "root", "least"), "sim-named")
        firsts = hold(merged.groupBy("root").agg(F.min("least").alias("component_id")), "sim-firsts")
        of = materialize(merged.join(firsts, "root").select(F.col("f").alias("_f"), "component_id"), "sim-of")
    return printed.join(of, F.col("f") == F.col("_f"), "left").select(*[F.col(s).alias(c) for c, s in zip(keep, spare, strict=True)], "f", "component_id")


#: Similar texts have this Jaccard similarity of their sets of five-word shingles, or more.
SIMILARITY, WIDTH = 0.8, 5
#: They are found under ``BANDS`` keys of ``ROWS`` least hashes each. Two texts of similarity j share some key with
#: probability 1 - (1 - j^7)^32: 0.999 at 0.8, 0.22 at 0.5, 0.007 at 0.3.
BANDS, ROWS = 32, 7

_DRAWN = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS, ROWS, 1), dtype=np.uint64)
_FACTORS, _SHIFTS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key for each band from its least hashes; no keys of no shingles."""
    if not len(shingles):
        return []
    least = [((shingles ^ _SHIFTS[b]) * _FACTORS[b]).min(axis=1) for b in range(BANDS)]
    return [_signed(xxhash.xxh64_intdigest(x.tobytes(), b)) for b, x in enumerate(least)]


_MASKS = np.array(covering_masks(64, 4), np.uint64)


def simhash_keys(shingles: np.ndarray) -> list[int]:
    """A key for each covering mask from the set's SimHash fingerprint: two sets whose fingerprints differ in four bits or fewer share one for certain; no keys of no shingles."""
    if not len(shingles):
        return []
    kept = np.uint64(_majority(shingles)) & _MASKS
    return [_signed(xxhash.xxh64_intdigest(x.tobytes(), BANDS + t)) for t, x in enumerate(kept)]


def touched(shingles: np.ndarray) -> list[int]:
    """A bit for each of ``CELLS`` cells of the hash that some shingle lies in."""
    cells = np.zeros(CELLS, np.uint8)
    cells[(shingles >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(cells).view(np.int64).tolist()


def shingle_sets(docs: DataFrame, keep: list[str], text_col: str, whole: bool = False) -> DataFrame:
    """``keep``, ``id`` (a digest of the set of shingles), and ``n`` (its size) and ``bands``; if ``whole``, ``shingles`` (the sorted set) and ``bits`` (see :func:`touched`) instead."""
    small_batches(docs.sparkSession)
    source = docs.select(*keep, F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text.as_py(), WIDTH)) for text in batch.column(len(keep))]
            ids = pa.array([_signed(xxhash.xxh64_intdigest(x.tobytes())) for x in sets], pa.int64())
            if whole:
                more = {"shingles": pa.array([x.tobytes() for x in sets], pa.binary()), "bits": pa.array(map(touched, sets), pa.list_(pa.int64()))}
            else:
                more = {"n": pa.array(map(len, sets), pa.int64()), "bands": pa.array([simhash_keys(x) + band_keys(x) for x in sets], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), ids, *more.values()], names=[*keep, "id", *more])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return source.mapInArrow(run, f"{fields}id long, {'shingles binary, bits array<bigint>' if whole else 'n long, bands array<bigint>'}")


def _may_fit(a: str, b: str, na: str, nb: str) -> Column:
    """Whether two sets can have the similarity asked for: a cell that one touches and the other does not holds a shingle that is not common.

    An upper bound of what they share, so no pair is lost; it rules out most pairs of short texts
    before their sets meet, and fewer of long ones, which touch nearly all cells.
    """
    only = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(CELLS // 64)), F.lit(0))
    common = F.least(F.col(na) - only(a, b), F.col(nb) - only(b, a))
    return common * (1 + SIMILARITY) >= SIMILARITY * (F.col(na) + F.col(nb)) - 1e-6


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have the similarity asked for, counted exactly. ``sets``: (id, shingles)."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(common >= SIMILARITY * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("fa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("fb"))
    return pairs.join(right, "b").join(left, "a").filter(alike("fa", "fb")).select("a", "b")


#: Cells of the shingles' hashes that rule pairs out.
CELLS = 1024
#: Once the pairs left are at most this many times the rows that they come from, all are compared.
FEW = 8
#: Members of a bucket that all others meet in a turn.
PIVOTS = 4


def _relabel(labels: DataFrame, links: DataFrame, keep: Scratch) -> DataFrame:
    """``labels`` after more links. Only roots are linked anew, so a round costs what it finds."""
    links = links.join(labels.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").select(F.coalesce("ra", "a").alias("a"), "b")
    links = links.join(labels.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left").select("a", F.coalesce("rb", "b").alias("b"))
    moved = components(links).withColumnsRenamed({"node": "n2", "root": "r2"})
    now = labels.join(moved, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root"))
    fresh = moved.join(labels, F.col("n2") == F.col("node"), "left_anti").select(F.col("n2").alias("node"), F.col("r2").alias("root"))
    return keep(now.union(fresh), "near-labels")


def link_similar(nodes: DataFrame, keyed: DataFrame, keep: Scratch) -> DataFrame:
    """(node, root): components of sets of shingles with a similarity of ``SIMILARITY`` or more.

    ``nodes``: (id, n, bands, least), one row for each distinct set, already written; ``keyed``: (_id,
    _tie, _text), which holds the text of each under ``least``. Sets meet under equal keys, those of
    SimHash fingerprints within four bits for certain (covering masks, as in :func:`link_within`) and
    those that differ in more under keys of least hashes, and are
    linked only if their exact similarity is high enough. First each one meets one of its least
    partners. Then, in turns, the members of buckets that still hold several components meet four
    members of their bucket, the same for all; a large group of near copies so falls together in a few
    turns, at four rows for each member. Last, in the buckets left, all members of different components
    meet: no pair that shares a key stays undecided. Before their sets are compared, a bound from the
    cells that they touch rules out pairs that cannot be similar enough.
    """
    each = nodes.select("id", "n", F.explode("bands").alias("bucket"))
    ends = each.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("bucket", "lo")
    members = keep(each.join(ends.hint("merge"), "bucket"), "near-members")
    met = members.select("id").distinct()
    texts = keyed.join(nodes.join(met, "id", "left_semi").select("least.*"), ["_id", "_tie"])
    sets = keep(shingle_sets(texts, [], "_text", whole=True).dropDuplicates(["id"]), "near-sets")
    stars = members.filter("lo <> id").groupBy("id").agg(F.min("lo").alias("lo")).select(F.col("lo").alias("a"), F.col("id").alias("b"))
    labels = components(_similar(stars, sets))
    members = _open(members.select("bucket", "id", "n").join(sets.select("id", "bits"), "id"), labels, keep)
    before, turn = None, 0
    while True:
        parts = members.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        rows, pairs = parts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0.0))).first()
        if not rows:
            return labels
        # A turn that leaves nearly all pairs: these texts are not similar, and only comparing them all can tell.
        if pairs <= FEW * rows or before is not None and pairs > 0.9 * before:
            break
        drawn = [F.min_by(F.struct("id", "root", "n", "bits"), F.xxhash64("id", F.lit(turn * PIVOTS + k))).alias(f"p{k}") for k in range(PIVOTS)]
        chosen = members.groupBy("bucket").agg(*drawn).select("bucket", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("p"))
        chosen = chosen.select("bucket", *[F.col(f"p.{c}").alias(f"{c}a") for c in ("id", "root", "n", "bits")])
        met = members.join(chosen, "bucket").filter((F.col("root") != F.col("roota")) & _may_fit("bitsa", "bits", "na", "n"))
        links = keep(_similar(_pairs(met.select(F.col("ida").alias("a"), F.col("id").alias("b"))), sets), "near-links")
        before, turn = pairs, turn + 1
        if not links.isEmpty():
            labels = _relabel(labels, links, keep)
            members = _open(members.select("bucket", "id", "n", "bits"), labels, keep)
    # Within a bucket's largest component no one has to meet; the others meet it and each other.
    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max_by("root", F.struct("c", "root")).alias("most"))
    x, y = (members.select("bucket", *[F.col(c).alias(f"{c}{i}") for c in ("id", "root", "n", "bits")]) for i in "ab")
    x, y = x.join(sizes, "bucket").filter("roota <> most"), y.join(sizes.withColumnRenamed("most", "mostb"), "bucket")
    other = (F.col("rootb") == F.col("mostb")) | (F.col("roota") < F.col("rootb"))
    across = x.join(y, (x["bucket"] == y["bucket"]) & other & (F.col("roota") != F.col("rootb")) & _may_fit("bitsa", "bitsb", "na", "nb"))
    links = keep(_similar(_pairs(across.select(F.col("ida").alias("a"), F.col("idb").alias("b"))), sets), "near-links")
    return labels if links.isEmpty() else _relabel(labels, links, keep)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with its columns as they are: the one of the smallest id (nulls last).

    Copies and repeated rows are in one group, and so are texts without words; null texts are empty,
    very long ones are compared whole. Of several rows with the same id and text one stays; rows of
    one id, or of none, with unlike texts are different documents. Ids are of any ordered type. An
    empty table stays empty; columns may have any names.
    """
    rows = docs.select(
        whole_row(docs).alias("row"), F.struct(named(id_col).isNull().alias("none"), named(id_col).alias("id")).alias("_id"), F.xxhash64(named(text_col)).alias("_tie"), named(text_col).alias("_text")
    )
    keyed = rows.select("_id", "_tie", "_text")
    with Scratch(docs.sparkSession) as keep:
        printed = keep(shingle_sets(keyed, ["_id", "_tie"], "_text"), "near-docs")
        nodes = keep(printed.groupBy("id").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(F.struct("_id", "_tie")).alias("least")), "near-nodes")
        roots = link_similar(nodes, keyed, keep)
        grouped = nodes.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))
        of = keep(grouped, "near-of")
        rooted = printed.select("id", "_id", "_tie").join(of, "id")
        first = rooted.groupBy("root", "_id", "_tie").agg(F.count("*").alias("n")).groupBy("root").agg(F.min(F.struct("_id", "_tie", "n")).alias("first"))
        first = materialize(first.select("first.*"), "near-first")
    kept = rows.drop("_text").join(first.select("_id", "_tie"), ["_id", "_tie"], "left_semi")
    if (first.agg(F.max("n")).first()[0] or 1) > 1:
        kept = kept.groupBy("_id", "_tie").agg(F.first("row").alias("row"))
    return kept.select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by :func:`near_duplicates`; a null text counts as one without words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("f")[0]), 16, "0")).alias("fingerprint"), "component_id")
