"""Document fingerprints from closed syncmers."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from callscope.llm.common import named, shuffle_partitions, small_batches

#: Bytes of a k-mer, and of the inner substring whose minimum must lie at an edge.
K, S = 24, 8
#: Characters of fingerprints in one batch of results.
BATCH_BYTES = 16 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _whole(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(1, np.int64), np.frombuffer(hashlib.blake2b(data, digest_size=8).digest(), "<u8")


def closed_syncmers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the closed syncmers of ``data``.

    A k-mer is one if the smallest hash among its s-mers is that of its first or last s-mer. Whether
    it is depends on its own bytes alone, so equal stretches of two texts have equal anchors wherever
    they stand. Data shorter than a k-mer, or without a closed syncmer (up to 38 bytes can be), is
    one anchor at 0; empty data has none.
    """
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(data) < K:
        return _whole(data)
    bytes_ = np.frombuffer(data, np.uint8)
    n = len(bytes_) - S + 1
    inner = np.zeros(n, np.uint64)
    for i in range(S):
        inner |= bytes_[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    h = _mix(inner)
    span = K - S + 1
    least, width = h, 1
    while width * 2 <= span:  # minimum of 1, 2, 4, ... neighbours
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n - span + 1], least[span - width : span - width + n - span + 1])
    at = np.nonzero((h[: n - span + 1] == least) | (h[span - 1 :] == least))[0]
    if not len(at):
        return _whole(data)
    return at, _mix(h[at] + np.uint64(3) * h[at + S] + np.uint64(7) * h[at + 2 * S])


@dataclass
class Sketch:
    """All anchors of a text in its order, and the order of their keys: equal hashes are numbered from the front."""

    at: np.ndarray
    hashes: np.ndarray
    keys: np.ndarray  # sorted
    order: np.ndarray  # the anchor of each key


def sketch(data: bytes) -> Sketch:
    at, hashes = closed_syncmers(data)
    order = np.argsort(hashes, kind="stable")
    keys = hashes[order]
    repeats = np.arange(len(keys)) - np.searchsorted(keys, keys)
    if repeats.any():
        keys = np.where(repeats > 0, _mix(keys + repeats.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), keys)
        again = np.argsort(keys, kind="stable")
        keys, order = keys[again], order[again]
    return Sketch(at, hashes, keys, order)


def _rising(x: np.ndarray) -> int:
    """Length of the longest rising subsequence."""
    if (x[1:] > x[:-1]).all():
        return len(x)
    tails: list[int] = []
    for v in x.tolist():
        if not tails or v > tails[-1]:
            tails.append(v)
        else:
            tails[bisect_left(tails, v)] = v
    return len(tails)


def likeness(a: Sketch, b: Sketch) -> float:
    """Share of anchors that match by position, among all of both (Jaccard), 0 to 1; two empty texts are alike.

    The first anchor of a hash in one text meets the first in the other, the second the second, and
    so on; of these meetings the most that stand in the same order in both texts count.
    """
    if not len(a.keys) and not len(b.keys):
        return 1.0
    if not len(a.keys) or not len(b.keys):
        return 0.0
    place = np.minimum(np.searchsorted(b.keys, a.keys), len(b.keys) - 1)
    met = b.keys[place] == a.keys
    partner = np.full(len(a.keys), -1)
    partner[a.order[met]] = b.order[place[met]]
    common = _rising(partner[partner >= 0])
    return common / (len(a.keys) + len(b.keys) - common)


def _text(s: Sketch) -> str:
    """Each anchor's hash and position, 16 and 8 hexadecimal digits, in the order of the text."""
    out = np.empty(len(s.at), [("hash", ">u8"), ("at", ">u4")])
    out["hash"], out["at"] = s.hashes, s.at
    return out.tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as many first characters of ``following``, or all of them."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _key(some: bool, id_: object, tie: int) -> tuple:
    """Sorts like the documents, backwards: null ids come first."""
    return (some, id_, tie) if some else (some, tie)


def _firsts(keys: DataFrame, parts: int) -> list[tuple]:
    """The greatest key of each of at most ``parts`` ranges of ``keys`` (id, tie), ascending. Moves keys only; one row of each range comes to the driver."""
    ranged = keys.repartitionByRange(parts, F.col("id").desc_nulls_last(), F.desc("tie"))
    greatest = F.max(F.struct(F.col("id").isNotNull().alias("some"), "id", "tie")).alias("k")
    return sorted(_key(*r["k"]) for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(greatest).select("k").collect())


def _placed(docs: DataFrame, firsts: list[tuple]) -> DataFrame:
    """``part``: 0 for the range of the greatest keys; ``first``: whether the row opens its range."""

    @F.arrow_udf("int")
    def place(ids: pa.Array, ties: pa.Array) -> pa.Array:
        keys = [_key(i is not None, i, t) for i, t in zip(ids.to_pylist(), ties.to_pylist(), strict=True)]
        at = [bisect_left(firsts, k) for k in keys]
        return pa.array([2 * (len(firsts) - 1 - i) + (firsts[i] == k) for i, k in zip(at, keys, strict=True)], pa.int32())

    return docs.withColumn("_at", place("id", "tie")).select("id", "tie", "text", F.expr("_at div 2").cast("int").alias("part"), (F.col("_at") % 2 == 1).alias("first"))


def _salts(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` tasks a number that Spark's hash sends there, so that each range has a task of its own."""
    found: dict[int, int] = {}
    size = 16 * parts
    while len(found) < parts:
        at = spark.range(size).select(F.col("id").cast("int").alias("i")).select("i", F.pmod(F.hash("i"), F.lit(parts)).alias("task"))
        found = {r["task"]: r["i"] for r in at.groupBy("task").agg(F.min("i").alias("i")).collect()}
        size *= 2
    return [found[i] for i in range(parts)]


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likenesses.

    Documents are ordered by descending id (null ids last, ties by the text's hash); after the last
    comes the first. Ids are cut into ranges; a text moves once, to its range, and the first text of
    each range goes to the range before as well, so each range is read as one sorted stream that
    holds two documents at a time. Null texts are empty, very long ones keep all their anchors; a
    single document follows itself; an empty table gives no rows. Repeated rows each get a row and
    follow each other in one range. Ids are of any ordered type; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(named(text_col), F.lit(""))
    source = docs.select(named(id_col).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    firsts = _firsts(source.select("id", "tie"), shuffle_partitions(spark))
    parts = max(1, len(firsts))
    placed = _placed(source, firsts)
    # Each row where it belongs, and each range's first one once more, behind the range before; the first range's is behind the last.
    before = F.when(F.col("part") == 0, parts - 1).otherwise(F.col("part") - 1)
    opening = placed.filter("first").groupBy("part").agg(F.first(F.struct("id", "tie", "text")).alias("d")).select(before.cast("int").alias("part"), "d.*", F.lit(1).alias("tail"))
    moved = placed.select("part", "id", "tie", "text", F.lit(0).alias("tail")).union(opening.select("part", "id", "tie", "text", "tail"))
    salt = F.element_at(F.array(*[F.lit(x) for x in _salts(spark, parts)]), F.col("part") + 1)
    sorted_ = moved.withColumn("salt", salt).repartition(parts, "salt").sortWithinPartitions("part", "tail", F.col("id").desc_nulls_last(), F.desc("tie"), "text").select("part", "id", "text", "tail")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, str, int]]:
        for batch in batches:
            parts, ids, texts, tails = batch.columns
            for i in range(batch.num_rows):
                yield parts[i].as_py(), ids[i].as_py(), texts[i].as_py(), tails[i].as_py()

    kind = docs.schema[id_col].dataType
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        written = 0
        held = None  # (part, id, text, sketch) of the document that waits for the next one
        for part, id_, text, tail in rows(batches):
            own = sketch(text.encode()) if not tail or held and held[0] == part else None
            if held and held[0] == part:
                _, held_id, held_text, held_sketch = held
                changed = edited(held_text, text).encode()
                other = sketch(changed)
                out.append((held_id, len(held_text), hashlib.sha256(changed).hexdigest(), _text(held_sketch), _text(other), likeness(held_sketch, other), likeness(held_sketch, own)))
                written += len(out[-1][3]) + len(out[-1][4])
            held = None if tail else (part, id_, text, own)
            if len(out) >= 500 or written > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out, written = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return sorted_.mapInArrow(run, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by :func:`fingerprint_neighbours`."""
    return fingerprint_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
