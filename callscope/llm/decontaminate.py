"""Benchmark decontamination by the CGK random-walk embedding."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.common import numbered, others, small_batches

#: Bytes of item text that one pass over the documents holds; larger benchmarks take several passes.
BLOCK_BYTES = 4 << 20
#: Below this a tenth of an item's normalised bytes is no edit: such items are found as they are, between word bounds.
LEAST_BYTES = 10
#: Window lengths; an item is searched by windows of the longest of which two fit, from each of its words.
WINDOWS = (32, 16)
SAMPLES, EARLY = 14, 6
#: Bits of an early key that a table of those of the items is read by.
EARLY_BITS = 20
_CHUNK = 1 << 15
#: Bytes of a line read at once for its grams, and counts held before they are summed up.
_LINE, _HELD = 1 << 17, 1 << 21
#: Bytes of a gram of long items; short ones have shorter grams.
GRAM = 8


def normalise(text: str | None) -> bytes:
    """Lower case, single spaces, UTF-8."""
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def word_starts(data: np.ndarray) -> np.ndarray:
    """Positions at the start or behind a space."""
    if not len(data):
        return np.empty(0, np.int64)
    return np.concatenate([[0], np.nonzero(data[:-1] == 32)[0] + 1])


def edit_distance_within(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text``, and where that substring ends (bit-parallel columns)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """Each run of ``length`` (up to 8) bytes as a number."""
    n = max(0, len(data) - length + 1)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out |= data[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    return out


class GramIndex:
    """The items' grams, so that no stretch within the accepted distance is missed.

    An edit breaks at most as many grams as one is long. An item of m bytes within k edits of a
    stretch so keeps m + 1 - q(k + 1) of its grams of q bytes there, at positions that shift by at
    most k against each other. q is chosen for each item so that at least one is kept. Half of those
    that must be kept could be lost as well without losing the item, so an item goes without as many of
    the grams that most items have, and texts meet fewer of them.
    """

    def __init__(self, items: list[tuple[object, bytes]], edits: float):
        by_length: dict[int, list[int]] = defaultdict(list)
        self.needed, self.width = np.zeros(len(items), np.int64), np.ones(len(items), np.int64)
        for n, (_, d) in enumerate(items):
            k = int(len(d) * edits)
            q = max(1, min(GRAM, len(d) // (k + 1)))
            by_length[q].append(n)
            self.needed[n], self.width[n] = max(1, len(d) + 1 - q * (k + 1)), k + 1
        self.tables, self.of_item = [], {}
        for q, numbers in by_length.items():
            parts = [_grams(np.frombuffer(items[n][1], np.uint8), q) for n in numbers]
            for n, part in zip(numbers, parts, strict=True):
                self.of_item[n] = q, part, int(self.needed[n])
            values, which, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            common = np.split(counts[which], np.cumsum([len(x) for x in parts])[:-1])
            kept = []
            for n, part, many in zip(numbers, parts, common, strict=True):
                spare = min(int(self.needed[n]) // 2, int((many > 1).sum()))
                kept.append(np.sort(np.argsort(many, kind="stable")[: len(part) - spare]))
                self.needed[n] -= spare
            keys = np.concatenate([x[i] for x, i in zip(parts, kept, strict=True)])
            order = np.argsort(keys, kind="stable")
            owner = np.repeat(np.array(numbers, np.int64), [len(i) for i in kept])
            offset = np.concatenate(kept)
            seen = np.zeros(1 << 20, bool)
            seen[self._slot(keys)] = True
            self.tables.append((q, seen, keys[order], owner[order], offset[order]))

    def keeps(self, item: int, region: bytes) -> bool:
        """Does the stretch have as many of the item's grams as one within the distance has?"""
        q, own, needed = self.of_item[item]
        return int(np.isin(own, _grams(np.frombuffer(region, np.uint8), q)).sum()) >= needed

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def candidates(self, line: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, last): an item that keeps enough grams in ``line`` if it starts there between first and last.

        ``line`` holds the texts of a batch one behind the other, so that a short text costs no calls
        of its own; what counts together over an end is ruled out where it is verified.
        """
        for q, seen, keys, owner, offset in self.tables:
            held, size = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
            for a in range(0, max(0, len(line) - q + 1), _LINE):
                grams = _grams(line[a : a + _LINE + q - 1], q)
                at = seen.take(self._slot(grams)).nonzero()[0]
                lo, hi = np.searchsorted(keys, grams[at], "left"), np.searchsorted(keys, grams[at], "right")
                sizes = hi - lo
                which = np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                item = owner[which]
                # Starts in bands of twice the width, each overlapping the next by half: what shifts by less than the width lies in one.
                band = (np.repeat(at + a, sizes) - offset[which] + len(keys)) // self.width[item] + 1
                held.append(np.unique(np.concatenate([item << 40 | band, item << 40 | band - 1]), return_counts=True))
                size += len(held[-1][0])
                if size > _HELD:
                    held, size = [self._merged(held)], 0
            found, counts = self._merged(held)
            item = found >> 40
            for i in (counts >= self.needed[item]).nonzero()[0]:
                n, width = int(item[i]), int(self.width[item[i]])
                first = ((int(found[i]) & ((1 << 40) - 1)) - 1) * width - len(keys)
                yield n, first, first + 2 * width - 1

    @staticmethod
    def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        found, where = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return found, np.bincount(where, np.concatenate([n for _, n in held]), len(found)).astype(np.int64)


def bounded_end(pattern: bytes, text: bytes) -> int:
    """Where the first ``pattern`` in ``text`` ends that no letter or digit goes on with at either side; -1 if there is none."""
    at = text.find(pattern)
    while at >= 0:
        end = at + len(pattern)
        before, behind = text[max(0, at - 4) : at].decode("utf-8", "replace")[-1:], text[end : end + 4].decode("utf-8", "replace")[:1]
        if not before.isalnum() and not behind.isalnum():
            return end
        at = text.find(pattern, at + 1)
    return -1


class WalkIndex:
    """Sampled bits of the items' windows, by window length and repetition.

    The walk reads a window from its start: at step t it writes the byte under its pointer and moves
    on by a random bit that depends on t and the byte. Two windows a few edits apart soon walk in
    step again, so few of their written bytes differ. A repetition draws new bits and ``SAMPLES``
    steps; windows that agree at all of them are candidates.
    """

    def __init__(self, items: list[tuple[object, str | None]], repetitions: int, edits: float, seed: int):
        self.edits = edits
        every = [(i, d) for i, t in items if (d := normalise(t))]
        self.items = [x for x in every if len(x[1]) >= LEAST_BYTES]
        self.short: dict[bytes, list[int]] = defaultdict(list)
        for n, (_, d) in enumerate(x for x in every if len(x[1]) < LEAST_BYTES):
            self.short[d].append(len(self.items) + n)
        self.grams = GramIndex(self.items, edits)
        self.classes: list[tuple[int, list[tuple]]] = []
        for length in WINDOWS:
            windows = [w for n, (_, d) in enumerate(self.items) if self._length(d) == length for w in self._windows(n, d, length)]
            if windows:
                self.classes.append((length, [self._table(windows, length, np.random.default_rng([seed, length, r])) for r in range(repetitions)]))
        self.items += [x for x in every if len(x[1]) < LEAST_BYTES]

    @staticmethod
    def _length(data: bytes) -> int:
        """The longest windows of which two fit, else the shortest."""
        return next((x for x in WINDOWS if 2 * x <= len(data)), WINDOWS[-1])

    @staticmethod
    def _windows(n: int, data: bytes, length: int) -> list[tuple[int, int]]:
        """(item, offset) at each word start that a whole window follows, or at the item's start."""
        starts = word_starts(np.frombuffer(data, np.uint8))
        return [(n, int(o)) for o in starts[starts <= len(data) - length]]

    def _table(self, windows: list[tuple[int, int]], length: int, rng: np.random.Generator) -> tuple:
        steps = length + length // 2
        moves = rng.integers(0, 2, (steps, 256)).astype(np.int32)
        sampled = np.zeros(steps, bool)
        sampled[rng.choice(steps, SAMPLES, replace=False)] = True
        # A window of exactly its length: past it the walk reads zeros, as it rarely does.
        line = np.frombuffer(b"".join(self.items[n][1][o : o + 2 * length].ljust(2 * length, b"\0") for n, o in windows) + b"\0" * (2 * length), np.uint8)
        starts = np.arange(len(windows), dtype=np.int32) * (2 * length)
        early, keys = self._walk(line, starts, moves, sampled, None)[1:]
        seen = np.zeros(1 << EARLY_BITS, bool)
        seen[(early >> np.uint64(64 - EARLY_BITS)).astype(np.int64)] = True
        order = np.argsort(keys, kind="stable")
        return moves, sampled, seen, keys[order], [windows[i] for i in order]

    @staticmethod
    def _walk(line: np.ndarray, starts: np.ndarray, moves: np.ndarray, sampled: np.ndarray, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All walks in step: the starts still there, their keys after ``EARLY`` samples and at the end. ``seen``: early keys to go on with."""
        at = starts.copy()
        key = np.zeros(len(starts), np.uint64)
        early, drawn = key, 0
        for t in range(len(moves)):
            c = line.take(at)
            if sampled[t]:
                key = (key ^ c) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
                drawn += 1
                if drawn == EARLY:
                    early = key
                    if seen is not None:
                        on = seen.take((key >> np.uint64(64 - EARLY_BITS)).astype(np.int64)).nonzero()[0]
                        starts, at, key, c = starts[on], at[on], key[on], c[on]
                        if not len(on):
                            break
                elif drawn == SAMPLES:
                    break
            at += moves[t].take(c)
        return starts, early, key

    def candidates(self, line: np.ndarray, starts: np.ndarray) -> set[tuple[int, int, int]]:
        """(window start in ``line``, item, offset in the item) whose sampled bytes agree in some repetition."""
        found = set()
        for _, tables in self.classes:
            for moves, sampled, seen, keys, windows in tables:
                for i in range(0, len(starts), _CHUNK):
                    left, _, got = self._walk(line, starts[i : i + _CHUNK], moves, sampled, seen)
                    lo, hi = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
                    for j in (hi > lo).nonzero()[0]:
                        found.update((int(left[j]), *windows[k]) for k in range(lo[j], hi[j]))
        return found

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, edit distance, end in the normalised text) of verified items, the nearest place of each."""
        data = [normalise(t) for t in texts]
        bounds = np.cumsum([0, *(len(d) + 1 for d in data)])
        line = np.frombuffer(b" ".join(data) + b"\0" * (2 * WINDOWS[0]), np.uint8)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried = set()

        def verify(row: int, item: int, from_: int, to: int) -> None:
            pattern, allowed = self.items[item][1], int(len(self.items[item][1]) * self.edits)
            if best.get((row, item), (1, 0))[0] == 0:
                return
            region = data[row][from_:to]
            exact = region.find(pattern)
            if exact < 0 and not self.grams.keeps(item, region):
                return
            distance, end = (0, exact + len(pattern)) if exact >= 0 else edit_distance_within(pattern, region)
            if distance <= allowed and distance < best.get((row, item), (allowed + 1, 0))[0]:
                best[row, item] = (distance, from_ + end)

        for start, item, offset in sorted(self.candidates(line, word_starts(line[: bounds[-1] - 1]).astype(np.int32) if len(texts) else np.empty(0, np.int32))):
            row = int(np.searchsorted(bounds, start, "right")) - 1
            size, allowed = len(self.items[item][1]), int(len(self.items[item][1]) * self.edits)
            from_ = max(0, start - int(bounds[row]) - offset - allowed)
            if (row, item, from_ // 16) not in tried:
                tried.add((row, item, from_ // 16))
                verify(row, item, from_, from_ + size + 2 * allowed + 32)
        # What the walks missed.
        for item, first, last in self.grams.candidates(line[: bounds[-1]]):
            size, allowed = len(self.items[item][1]), int(len(self.items[item][1]) * self.edits)
            from_, to = max(0, first - allowed), max(0, last + size + 2 * allowed + 1)
            for row in range(max(0, int(np.searchsorted(bounds, from_, "right")) - 1), min(len(data), int(np.searchsorted(bounds, to, "left")))):
                begin = int(bounds[row])
                verify(row, item, max(0, from_ - begin), max(0, to - begin))
        for row, d in enumerate(data):
            for pattern, numbers in self.short.items():
                end = bounded_end(pattern, d)
                if end >= 0:
                    best.update({(row, n): (0, end) for n in numbers})
        for (row, item), (distance, end) in sorted(best.items()):
            yield row, item, distance, end


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size; the driver holds one at a time."""
    block, held = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1] or "")
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], item_col: str = "item_id", item_text: str = "text", text_col: str = "text", repetitions: int = 2, edits: float = 0.1, seed: int = 7) -> DataFrame:
    """One row for each document and item it holds: ``keep``, ``item_id``, ``distance``, ``end_byte``.

    Texts and items are lower-cased and their white space is made single spaces. From every word
    start the whole text is walked in windows of 32 bytes (16 where an item has under 64); windows that
    agree with one that begins at a word of an item, in the sampled steps of some repetition, are
    verified: the document holds the item if some stretch is within ``edits`` times the item's bytes
    of it. The walks alone find 98 of 100 items with a tenth of their bytes edited, and nearly all
    with fewer edits; counts of common grams lead to the rest, and to items under 16 bytes, so that no
    stretch within the distance is missed (``edits`` below 0.5).

    Items under 10 bytes, of which a tenth is no edit, are found as they are, between word bounds. Null and empty texts and
    items have no matches, very long texts are searched whole; repeated items and rows each get
    their rows; of stretches equally near the first counts; benchmarks of over 4 MB are searched in
    several passes. Empty tables give no rows. Kept columns named like a result's are replaced by it.
    """
    small_batches(docs.sparkSession, 256)
    keep = others(keep, ("item_id", "distance", "end_byte"))
    source = numbered(docs, [*keep, text_col])
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"{fields}item_id {kind}, distance int, end_byte int"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, item_col, item_text):
        index = WalkIndex(block, repetitions, edits, seed)

        def run(batches: Iterator[pa.RecordBatch], index: WalkIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(index.matches(batch.column(len(keep)).to_pylist()))
                taken = batch.select(list(range(len(keep)))).take(pa.array([f[0] for f in found], pa.int64()))
                ids = pa.array([index.items[f[1]][0] for f in found])
                more = [ids, pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32())]
                if found:
                    yield pa.RecordBatch.from_arrays([*taken.columns, *more], names=[*keep, "item_id", "distance", "end_byte"])

        out = out.union(source.mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", text_col: str = "text", repetitions: int = 2, edits: float = 0.1, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that hold no item (see :func:`find_leaks`), with their columns as they are, whatever their names.

    Null and empty texts stay, repeated rows go or stay together, an empty benchmark leaves all.
    """
    small_batches(docs.sparkSession, 256)
    at, names = docs.columns.index(text_col), docs.columns
    for block in item_blocks(benchmark, item_col, item_text):
        index = WalkIndex(block, repetitions, edits, seed)

        def run(batches: Iterator[pa.RecordBatch], index: WalkIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in index.matches(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(clean)).rename_columns(names)

        docs = numbered(docs, names).mapInArrow(run, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
