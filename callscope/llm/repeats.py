"""Repeated passages by a common-prefix interval tree over an enhanced suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.common import Scratch, materialize, named, others, small_batches

#: Bytes of the substring that anchors a window.
ANCHOR = 64
#: Texts are anchored in pieces of this many bytes; positions in a piece fit 24 bits.
PIECE = 1 << 20
#: Bytes that one suffix array takes at a time, copies twice (more if one anchor's stretches are longer).
CHUNK = 1 << 19
#: An anchor with more distinct stretches than this is settled window by window instead.
HOT = 2000

_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFF)


def powers(n: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for at least a piece."""
    n = max(n, PIECE + 4096)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def stretches(data: bytes, window: int, factors: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut all windows of ``window`` bytes into runs that share their anchor: (key, digest, start, bytes).

    A window's anchor is its leftmost ``ANCHOR`` bytes of least hash, so equal windows have the same
    anchor at the same place in them. Consecutive windows with the anchor at one position make a
    stretch; ``key`` is the anchor's hash, ``digest`` the XXH3 of the stretch, a hash unlike that of anchors.
    """
    keys, digests, starts, sizes = [], [], [], []
    up, down = factors
    digest = xxhash.xxh3_64_intdigest
    for base in range(0, max(1, len(data)), PIECE):
        piece = data[base : base + PIECE + window - 1]
        if len(piece) < window:
            break
        codes = np.frombuffer(piece, np.uint8).astype(np.uint64) + np.uint64(1)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)])])
        h = _scramble((upto[ANCHOR:] - upto[:-ANCHOR]) * down[: len(upto) - ANCHOR])
        least = _sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), window - ANCHOR + 1)
        at = np.nonzero(np.concatenate([[True], least[1:] != least[:-1]]))[0]
        size = np.diff(np.append(at, len(least))) + window - 1
        keys.append(h[(least[at] & _LOW).astype(np.int64)])
        digests.append(np.fromiter((digest(piece[a : a + n]) for a, n in zip(at.tolist(), size.tolist(), strict=True)), np.uint64, len(at)))
        starts.append(at + base)
        sizes.append(size)
    if not keys:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(map(np.concatenate, (keys, digests, starts, sizes)))


def suffix_array(codes: np.ndarray, at: np.ndarray, classes: np.ndarray, least: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``at`` by class and then by the codes behind their first ``least``, and common prefixes of neighbours.

    Suffixes of one class agree in their first ``least`` codes, so those that share a longer prefix lie
    together. Prefixes are compared code by code, up to ``longest``; neighbours of unlike classes get 0.
    """
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([codes, np.zeros(longest, np.uint8)]), longest)
    keys = np.empty((len(at), 4 + longest - least), np.uint8)
    keys[:, :4] = classes.astype(">u4").view(np.uint8).reshape(-1, 4)
    keys[:, 4:] = rows[at, least:]
    order = np.argsort(keys.view(f"S{keys.shape[1]}").ravel(), kind="stable")
    prefix = np.zeros(max(0, len(at) - 1), np.int64)
    for i in range(0, len(prefix), 1 << 14):
        pair = slice(i, i + (1 << 14))
        one, two = order[:-1][pair], order[1:][pair]
        same = (classes[one] == classes[two]).nonzero()[0]
        equal = rows[at[one[same]]] == rows[at[two[same]]]
        prefix[i + same] = np.where(equal.all(axis=1), longest, equal.argmin(axis=1))
    return order, prefix


def maximal_repeats(strings: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, positions of all occurrences) of the repeats of at least ``least`` bytes within ``strings``, joined by one separator each.

    An interval of the suffix array whose suffixes share a prefix of ``least`` bytes or more is a
    right-maximal repeat. It is put out if its occurrences differ in the byte to their left, or one
    begins a string: otherwise the repeat that starts one byte earlier has the same occurrences and
    covers it. Suffixes whose first ``least`` bytes have a hash of their own are in no such interval
    and are not sorted.
    """
    codes = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8) + np.uint8(1)  # UTF-8 has no byte above 0xF7
    sizes = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(sizes)
    codes[ends - 1] = 0
    up, down = powers(len(codes))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * up[: len(codes)])])
    at = np.arange(max(0, len(codes) - least))
    at = at[np.repeat(ends, sizes)[: len(at)] - 1 - at >= least]
    _, classes, counts = np.unique(_scramble((upto[at + least] - upto[at]) * down[at]), return_inverse=True, return_counts=True)
    several = counts[classes] > 1
    at, classes = at[several], classes[several]
    if not len(at):
        return
    room = ends[np.searchsorted(ends, at, "right")] - 1 - at
    order, prefix = suffix_array(codes, at, classes, least, int(room.max()))
    prefix = np.minimum(prefix, np.minimum(room[order[:-1]], room[order[1:]]))
    first = np.isin(at, ends - sizes)
    left = np.where(first, -1, codes[np.maximum(at - 1, 0)].astype(np.int64))[order]
    order = at[order]
    shared = np.concatenate([[False], prefix >= least, [False]])
    opens = np.nonzero(~shared[:-1] & shared[1:])[0]
    closes = np.nonzero(shared[:-1] & ~shared[1:])[0]
    if not len(opens):
        return
    # Where all suffixes have the same byte to their left, nothing within is diverse either.
    edges = np.stack([opens, closes + 1], axis=1).ravel()
    padded = np.append(left, 0)
    diverse = np.minimum.reduceat(padded, edges)[::2] != np.maximum.reduceat(padded, edges)[::2]
    diverse |= left[opens] < 0
    for lo, hi in zip(opens[diverse].tolist(), closes[diverse].tolist(), strict=True):
        # Stack scan. A node: depth, first suffix, the one byte to the left of all its suffixes or None.
        chars = [c if c >= 0 else None for c in left[lo : hi + 1].tolist()]
        depths = [*prefix[lo:hi].tolist(), 0]
        stack: list[list] = []
        for k, depth in enumerate(depths):
            first_, seen = k, chars[k]
            while stack and stack[-1][0] > depth:
                node = stack.pop()
                if node[2] != seen:
                    node[2] = None
                if node[2] is None:
                    yield node[0], order[lo + node[1] : lo + k + 1]
                first_, seen = node[1], node[2]
            if depth and stack and stack[-1][0] == depth:
                if stack[-1][2] != seen:
                    stack[-1][2] = None
            elif depth:
                stack.append([depth, first_, seen])


def covered(strings: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """For each string the maximal spans covered by substrings of ``window`` bytes that start twice or more among the strings."""
    found: list[list[tuple[int, int]]] = [[] for _ in strings]
    firsts = np.cumsum([0, *(len(s) + 1 for s in strings)])
    edges = np.zeros(firsts[-1] + 1, np.int64)
    for length, places in maximal_repeats(strings, window):
        edges[places] += 1  # a repeat's places are distinct
        edges[places + length] -= 1
    on = np.concatenate([[False], np.cumsum(edges) > 0, [False]])
    opens, closes = np.nonzero(~on[:-1] & on[1:])[0], np.nonzero(on[:-1] & ~on[1:])[0]
    owner = np.searchsorted(firsts, opens, "right") - 1
    for a, b, o in zip(opens.tolist(), closes.tolist(), owner.tolist(), strict=True):
        found[o].append((a - int(firsts[o]), b - int(firsts[o])))
    return found


def doubled(strings: list[bytes], copied: list[bool]) -> list[bytes]:
    """``strings``, and behind them those again that stand in the corpus more than once, so that the tree sees the copies."""
    return strings + [s for s, c in zip(strings, copied, strict=True) if c]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def cut_stretches(docs: DataFrame, window: int) -> DataFrame:
    """(doc, tie, key, digest, start, size): the stretches of all texts. ``docs``: (doc, tie, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = powers()
        for batch in batches:
            parts, rows = [], []
            for i, text in enumerate(batch.column(2)):
                data = (text.as_py() or "").encode()
                if len(data) >= window:
                    parts.append(stretches(data, window, factors))
                    rows.append(np.full(len(parts[-1][0]), i))
            if parts:
                key, digest, start, size = (np.concatenate([p[k] for p in parts]) for k in range(4))
                own = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), _signed(key), _signed(digest), pa.array(start), pa.array(size.astype(np.int32))], names=["doc", "tie", "key", "digest", "start", "size"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, tie long, key long, digest long, start long, size int")


def repeated_places(docs: DataFrame, window: int, keep: Scratch) -> DataFrame:
    """The stretches whose anchor stands at two places or more; no others can hold a repeated window.

    Anchors are counted first, by partial sums of single longs, so most stretches are gone before
    anything else is moved.
    """
    runs = keep(cut_stretches(docs, window), "repeats-runs")
    anchors = keep(runs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeats-anchors")
    places = keep(runs.join(anchors, "key").select("doc", "tie", "key", "digest", "start", "size"), "repeats-places")
    keep.drop(runs, anchors)
    return places


def distinct_pieces(docs: DataFrame, places: DataFrame, keep: Scratch) -> DataFrame:
    """(key, digest, copied, hot, bytes): each distinct stretch once, with its bytes.

    ``copied``: it stands at several places. ``hot``: its anchor has over ``HOT`` distinct stretches.
    The least place of a stretch lends its bytes.
    """
    each = keep(places.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("doc", "tie", "start", "size")).alias("at")), "repeats-each")
    many = each.groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") > HOT).select("key", F.lit(True).alias("many"))
    wanted = each.join(many, "key", "left").select("at.*", "key", "digest", (F.col("n") > 1).alias("copied"), F.coalesce("many", F.lit(False)).alias("hot"))
    wanted = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "size", "key", "digest", "copied", "hot")).alias("parts"))
    sent = docs.join(wanted, docs["doc"].eqNullSafe(wanted["doc"]) & (docs["tie"] == wanted["tie"])).select("text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "digest", "copied", "hot"]
        for batch in batches:
            for text, parts in zip(batch.column(0), batch.column(1), strict=True):
                data, fields = text.as_py().encode(), parts.values
                strings = [data[a : a + n] for a, n in zip(fields.field("start").to_pylist(), fields.field("size").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(fields.field(k) for k in names), pa.array(strings, pa.binary())], names=[*names, "bytes"])

    # A repeated row sends its stretches again; the group that they go to tells them apart by digest.
    out = keep(sent.mapInArrow(run, "key long, digest long, copied boolean, hot boolean, bytes binary"), "repeats-pieces")
    keep.drop(each)
    return out


def anchor_groups(pieces: DataFrame, settle, schema: str) -> DataFrame:
    """``settle(keys, digests, copied, bytes)``, which yields batches, for whole anchors, at least ``CHUNK`` bytes of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[:2] == rows[-1][:2]:
                    continue
                if held >= CHUNK and row[0] != rows[-1][0]:
                    yield from settle(*map(list, zip(*rows, strict=True)))
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3]) * (1 + row[2])
        if rows:
            yield from settle(*map(list, zip(*rows, strict=True)))

    cold = pieces.filter(~F.col("hot")).select("key", "digest", "copied", "bytes")
    return cold.repartition("key").sortWithinPartitions("key", "digest").mapInArrow(run, schema)


def covered_pieces(pieces: DataFrame, window: int, keep: Scratch) -> DataFrame:
    """(key, digest, from, to): the spans of each distinct stretch that repeated windows cover."""

    def settle(keys: list[int], digests: list[int], copied: list[bool], strings: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = covered(doubled(strings, copied), window)[: len(strings)]
        out = [(k, d, a, b) for k, d, spans in zip(keys, digests, found, strict=True) for a, b in spans]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "digest", "from", "to"])

    near = anchor_groups(pieces, settle, "key long, digest long, from long, to long")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, names = [], [], []
            for i, data in enumerate(batch.column(3).to_pylist()):
                for o in range(len(data) - window + 1):
                    rows.append(i)
                    at.append(o)
                    names.append(hashlib.blake2b(data[o : o + window], digest_size=16).digest())
            own = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in range(3)), pa.array(at, pa.int64()), pa.array(names, pa.binary())], names=["key", "digest", "copied", "from", "name"])

    hot = pieces.filter("hot").select("key", "digest", "copied", "bytes").dropDuplicates(["key", "digest"])
    single = keep(hot.mapInArrow(windows, "key long, digest long, copied boolean, from long, name binary"), "repeats-windows")
    twice = single.groupBy("name").agg(F.count("*").alias("n"), F.max("copied").alias("c")).filter("n > 1 or c").select("name")
    far = single.join(twice, "name").select("key", "digest", "from", (F.col("from") + window).alias("to"))
    return keep(near.union(far), "repeats-covered")


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """(doc, tie, spans): the spans of each document's bytes covered by repeated windows; documents without any are left out.

    ``docs``: (doc, tie, text); rows equal in doc and tie are repeated rows.

    1. Every text is cut into stretches; those whose anchor stands at one place only go.
    2. One text of each distinct stretch goes to its anchor's group, where a suffix array over the
       group finds the repeats; copies, counted before anything is moved, go in twice. An anchor
       with over ``HOT`` distinct stretches sends its windows' digests to be counted instead, so
       that no task gathers it.
    3. What is covered of a stretch is covered wherever the stretch stands.
    """
    with Scratch(docs.sparkSession) as keep:
        places = repeated_places(docs, window, keep)
        pieces = distinct_pieces(docs, places, keep)
        found = covered_pieces(pieces, window, keep)
        keep.drop(pieces)
        spans = places.join(found, ["key", "digest"]).select("doc", "tie", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end"))
        return materialize(spans.distinct().groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "repeats-spans")


def repeat_groups(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(group, length, doc, start): the maximal repeats of ``window`` bytes or more, with all their occurrences, a row each.

    The left-diverse intervals of each anchor's suffix array, that is, repeats as far as the windows of
    one anchor reach; longer ones go on in the groups of the next anchors. Offsets are bytes, ``group``
    a digest of the repeated bytes. Anchors with over ``HOT`` distinct stretches give each repeated
    window as a group. Null texts are empty; repeated rows are occurrences each; an empty table gives
    no rows. An occurrence in many copies is that many rows and never one array.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), text).alias("tie"), text.alias("text"))

    def settle(keys: list[int], digests: list[int], copied: list[bool], strings: list[bytes]) -> Iterator[pa.RecordBatch]:
        every = doubled(strings, copied)
        firsts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in every])])
        out = []
        for length, at in maximal_repeats(every, window):
            owner = np.searchsorted(firsts, at, "right") - 1
            for o, p in zip(owner.tolist(), (at - firsts[owner]).tolist(), strict=True):
                if o < len(strings):  # the second copy has the same places
                    out.append((hashlib.blake2b(strings[o][p : p + length], digest_size=16).hexdigest(), length, keys[o], digests[o], p))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.string(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["group", "length", "key", "digest", "from"])

    with Scratch(docs.sparkSession) as keep:
        places = repeated_places(keyed, window, keep)
        pieces = distinct_pieces(keyed, places, keep)
        near = anchor_groups(pieces, settle, "group string, length long, key long, digest long, from long")

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [
                    (hashlib.blake2b(data[o : o + window], digest_size=16).hexdigest(), c, k, d, o)
                    for k, d, c, data in zip(*(x.to_pylist() for x in batch.columns), strict=True)
                    for o in range(len(data) - window + 1)
                ]
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.string(), pa.bool_(), *[pa.int64()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["group", "copied", "key", "digest", "from"])

        hot = pieces.filter("hot").select("key", "digest", "copied", "bytes").dropDuplicates(["key", "digest"])
        single = keep(hot.mapInArrow(windows, "group string, copied boolean, key long, digest long, from long"), "repeats-windows")
        twice = single.groupBy("group").agg(F.count("*").alias("n"), F.max("copied").alias("c")).filter("n > 1 or c").select("group")
        far = single.join(twice, "group").select("group", F.lit(window).cast("long").alias("length"), "key", "digest", "from")
        # A repeat's first window lies in one stretch only, so no place comes twice.
        return materialize(places.join(near.union(far), ["key", "digest"]).select("group", "length", "doc", (F.col("start") + F.col("from")).alias("start")), "repeats-groups")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, keep: list[str], window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``keep``, ``n_bytes``, ``spans`` (removed: start, end in bytes) and ``kept`` (the bytes left, in order).

    A byte is removed if a ``window``-byte string that covers it starts anywhere else too, in the
    same document or another; all strings are judged on the input. Null texts are empty and give
    empty rows, texts below the window are kept whole, very long ones are cut in pieces of 1 MB that
    overlap by a window. Repeated rows are copies of each other and each get their row. Rows are told
    apart by id (of any type, null too) and the text's 64-bit hash, so ids may repeat. An empty table
    gives no rows. Kept columns named like a result's are replaced by it.
    """
    small_batches(docs.sparkSession)
    keep = others(keep, ("n_bytes", "spans", "kept"))
    text = F.coalesce(named(text_col), F.lit(""))
    keyed = docs.select(*[named(c).alias(f"_k{i}") for i, c in enumerate(keep)], named(id_col).alias("doc"), F.xxhash64(named(id_col), text).alias("tie"), text.alias("text"))
    found = repeated_spans(keyed.select("doc", "tie", "text"), window)
    joined = keyed.join(found, keyed["doc"].eqNullSafe(found["doc"]) & (keyed["tie"] == found["tie"]), "left").select(*[f"_k{i}" for i in range(len(keep))], "text", "spans")
    n = len(keep)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for text, spans in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                data = text.encode()
                cut = merged([(s["start"], s["end"]) for s in spans or ()])
                edges = [0, *(x for s in cut for x in s), len(data)]
                sizes.append(len(data))
                gone.append([{"start": a, "end": b} for a, b in cut])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sizes, pa.int64()), pa.array(gone, pa.list_(span)), pa.array(kept, pa.binary())], names=[*keep, "n_bytes", "spans", "kept"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return joined.mapInArrow(apply, f"{fields}n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with what :func:`remove_repeats` takes off them at 200 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs, ["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
