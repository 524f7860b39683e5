"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A word is coded by binary decisions: its path in a code of the training words or, if it is too rare
for one, an escape and the paths of its bytes. Each decision is predicted by its plain counts and by
tables of hashed contexts (the last common word and the word before; inside spelled words one to
three bytes before, across the word's start), mixed by gated weights that are learned online over
the running training texts, and refined by what came true of like predictions. Passages that the
corpus holds elsewhere are predicted as wholes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from callscope.llm.common import Scratch, dropped_shuffles, materialize, small_batches

#: Words that have a code of their own, the most frequent of training; all others are spelled.
CODED = 1 << 17
#: Decisions of a code that are mixed; what lies deeper goes by its share of the counts.
DEEP = 7
#: Tables of the hashed contexts, and the slots of each.
TABLES, TABLE_BITS = 3, 19
#: Words among the most frequent whose latest one is a context.
COMMON = 128
#: Tokens that are predicted in one step, before the tables, weights and cells move on.
STEP = 4_000
#: Distinct words that a counting task holds.
HELD = 600_000
#: A text's own words so far get this share of the next word's probability, times i / (i + OWN_HALF) behind i words.
OWN_SHARE, OWN_HALF = 0.2, 20
#: About one token in this many ends a passage.
PASSAGE = 32
#: Training tokens that the first state learns, and those that each of the others learns from there on, about.
FIRST_TOKENS, PART_TOKENS = 1_000_000, 8_000_000
#: Texts that are read at once.
GROUP = 500

_INPUTS, _KINDS, _CELLS = TABLES + 1, 2 * DEEP, 33
_GATES = _KINDS * 12
_EDGE, _RANGE = np.float32(16), np.float32(8)
_U = np.uint64
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; the end of the text, a token too, is the empty word."""
    return [*(text or "").encode().lower().split(), b""]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Code:
    """A binary code over symbols with counts, in a given order: every decision halves the counts of what is left, as near as it can.

    ``nodes``, ``bits``: the decisions of each symbol, up to ``deep`` of them, from ``starts``,
    ``sizes`` of them; ``plain``, ``depth``: what the counts say at each node, as a logit, and how deep
    it lies; ``rest``: log10 of the symbol's share of the counts below them.
    """

    def __init__(self, counts: np.ndarray, deep: int):
        upto = np.concatenate([[0.0], np.cumsum(np.asarray(counts, float))])
        n = len(upto) - 1
        bits, nodes, plain, depths = np.zeros((n, deep), np.uint8), np.zeros((n, deep), np.uint32), [], []
        self.sizes, lowest = np.zeros(n, np.int64), np.zeros(n)
        ranges, number = [(0, n)], 0
        for depth in range(deep + 1):
            below = []
            for lo, hi in ranges:
                if hi - lo == 1 or depth == deep:
                    self.sizes[lo:hi], lowest[lo:hi] = depth, upto[hi] - upto[lo]
                    continue
                cut = int(np.searchsorted(upto, (upto[lo] + upto[hi]) / 2))
                cut -= cut > lo + 1 and upto[cut] + upto[cut - 1] > upto[lo] + upto[hi]
                cut = min(max(cut, lo + 1), hi - 1)
                ones, all_ = upto[hi] - upto[cut], upto[hi] - upto[lo]
                bits[cut:hi, depth] = 1
                nodes[lo:hi, depth] = number
                plain.append(np.log((ones + 0.3) / (all_ - ones + 0.3)))
                depths.append(depth)
                number += 1
                below += [(lo, cut), (cut, hi)]
            ranges = below
        inside = np.arange(deep) < self.sizes[:, None]
        self.bits, self.nodes = bits[inside], nodes[inside].astype(np.min_scalar_type(number))
        self.plain, self.depth = np.array(plain, np.float32), np.array(depths, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.rest = np.log10(np.diff(upto) / lowest)

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whose, node, bit) of all decisions of the symbols."""
        sizes = self.sizes.take(symbols)
        whose = np.repeat(np.arange(len(symbols)), sizes)
        place = np.arange(len(whose)) + np.repeat(self.starts.take(symbols) - np.cumsum(sizes) + sizes, sizes)
        return whose, self.nodes.take(place).astype(np.int64), self.bits.take(place)


class Codebook:
    """The most frequent words of training, most frequent first, with their code; an escape to spelling for all others; a code of bytes for that.

    The words' code is in the order of their spelling from behind, so that its first decisions are
    those between endings, which other words foretell. The escape weighs as much as the training
    tokens that need it.
    """

    def __init__(self, words: list[bytes], counts: list[int], rest: int):
        self.index = {w: i for i, w in enumerate(words)}
        self.column = pa.array(words, pa.large_binary())
        self.escape = len(words)
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w, 1) for w in words] + [0], np.uint64)
        order = [*sorted(range(len(words)), key=lambda i: words[i][::-1]), len(words)]
        self.words = Code(np.array([*counts, max(1, rest)])[order], DEEP)
        self.symbol = np.empty(len(order), np.int64)  # of each word and the escape, in the code
        self.symbol[order] = np.arange(len(order))
        letters = np.bincount(np.frombuffer(b" ".join(words[len(words) // 2 :]) + b" ", np.uint8), minlength=256)  # rarer words spell like rare ones
        self.bytes = Code(letters + 1, 64)

    def leaves(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """The place of each word, the escape for all others. ``sizes``: the words' bytes."""
        ends = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]))
        asked = pa.Array.from_buffers(pa.large_binary(), len(words), [None, ends, pa.py_buffer(b"".join(words))])
        return pc.index_in(asked, self.column).fill_null(self.escape).to_numpy().astype(np.int64)

    def parts(self) -> dict:
        """What :meth:`of_parts` needs, as plain values, so that workers need not import this module to read a broadcast; ``index`` stays here."""
        return {k: v for k, v in vars(self).items() if k != "index"} | {"words": vars(self.words), "bytes": vars(self.bytes)}

    @classmethod
    def of_parts(cls, parts: dict) -> Codebook:
        out = cls.__new__(cls)
        vars(out).update(parts)
        for name in ("words", "bytes"):
            code = Code.__new__(Code)
            vars(code).update(parts[name])
            setattr(out, name, code)
        return out


@dataclass
class Line:
    """The tokens of some texts, end to end."""

    words: list[bytes]
    text: np.ndarray  # whose token it is
    size: np.ndarray  # bytes of the word
    start: np.ndarray  # of the word in ``data``
    leaf: np.ndarray  # its place in the code; the escape for spelled words
    hashed: np.ndarray
    data: np.ndarray  # words with a space behind each, and a gap of zeros before each text

    @classmethod
    def of(cls, texts: list[list[bytes]], book: Codebook) -> Line:
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        words = list(chain.from_iterable(texts))
        owner = np.repeat(np.arange(len(texts)), counts)
        data = np.frombuffer(b"".join(b"\0\0\0\0" + b" ".join(t) + b" " for t in texts), np.uint8)
        ends = np.nonzero(data == 32)[0]  # one behind each word, none within
        start = np.concatenate([[0], ends[:-1] + 1])
        start[np.cumsum(counts) - counts] += 4
        size = ends - start
        escape = book.escape
        leaf = book.leaves(words, size)
        hashed = book.hashes[leaf]
        spelled = np.nonzero(leaf == escape)[0]
        digest = xxhash.xxh3_64_intdigest
        hashed[spelled] = np.array([digest(words[i], 1) for i in spelled.tolist()], np.uint64)
        return cls(words, owner, size, start, leaf, hashed, data)

    def before(self, k: int) -> np.ndarray:
        """The hash of the token ``k`` places before each one, 0 where the text has none."""
        n = len(self.hashed)
        out = np.zeros(n, np.uint64)
        if n > k:
            out[k:] = np.where(self.text[k:] == self.text[: n - k], self.hashed[: n - k], _U(0))
        return out

    def latest_common(self, common: int) -> np.ndarray:
        """The hash of the last of the ``common`` most frequent words before each token, 0 where the text has none so far."""
        n = len(self.hashed)
        at = np.maximum.accumulate(np.where(self.leaf < common, np.arange(n), -1))
        at = np.concatenate([[-1], at[:-1]])
        return np.where((at >= 0) & (self.text[at] == self.text), self.hashed[at], _U(0))


@dataclass
class Bits:
    """The binary decisions of some tokens."""

    token: np.ndarray  # whose decision it is, from the first of the step
    bit: np.ndarray
    slots: list[np.ndarray]  # in each table; in the last one, of spelled bytes only
    plain: np.ndarray  # logit by the counts alone
    kind: np.ndarray  # depth, for spelled bytes behind those of words


class Contexts:
    """What the predictors know before each token of a line: the word before and the last common word; while one is spelled, the bytes before."""

    def __init__(self, line: Line, book: Codebook):
        self.line, self.book = line, book
        common = line.latest_common(min(COMMON, book.escape))
        self.of_word = [_mix(common + _U(2)), _mix(line.before(1) + _U(1))]
        self.common = common * _U(3)

    def bits(self, a: int, b: int) -> Bits:
        """Decisions of tokens ``a`` to ``b``: those of their code, then those of the bytes of spelled words and the space behind each."""
        line, book = self.line, self.book
        leaf = line.leaf[a:b]
        whose, node, bit = book.words.decisions(book.symbol.take(leaf))
        spelled = np.nonzero(leaf == book.escape)[0]
        sizes = line.size[a:b][spelled] + 1
        who = np.repeat(spelled, sizes)
        at = np.repeat(line.start[a:b][spelled] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(who))
        byte, letter, spelt = book.bytes.decisions(line.data[at])
        near = line.data[at - 1].astype(np.uint64) | line.data[at - 2].astype(np.uint64) << _U(8)
        far = near | line.data[at - 3].astype(np.uint64) << _U(16) | line.data[at - 4].astype(np.uint64) << _U(24)
        contexts = [_mix((near & _U(255)) + self.common[a:b][who] + _U(3)), _mix(near + _U(2 << 40)), _mix((far & _U(0xFFFFFF)) + _U(4 << 40))]
        slots = []
        for k in range(TABLES):
            wide = contexts[k].take(byte) + letter.view(np.uint64)
            if k < len(self.of_word):
                wide = np.concatenate([self.of_word[k][a:b].take(whose) + node.view(np.uint64), wide])
            wide *= _SPREAD
            wide >>= _U(64 - TABLE_BITS)
            slots.append(wide.view(np.int64))
        return Bits(
            np.concatenate([whose, who.take(byte)]),
            np.concatenate([bit, spelt]),
            slots,
            np.concatenate([book.words.plain.take(node), book.bytes.plain.take(letter)]),
            np.concatenate([book.words.depth.take(node), np.minimum(book.bytes.depth, DEEP - 1).take(letter) + DEEP]),
        )


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Mixer:
    """The state of the model: counts of each slot, weights by gate, and what came true of like predictions."""

    def __init__(self) -> None:
        """A state that has learned nothing."""
        self.counts = np.zeros((TABLES, 1 << TABLE_BITS, 2), np.int32)  # of all decisions in a slot, and of those that were 1
        self.weights = np.repeat(np.array([[0.4], [0.2], [0.3], [0.3]], np.float32), _GATES, axis=1)  # (input, gate)
        self.cells = np.zeros((2, _GATES * _CELLS), np.float32)
        self.behind = np.zeros(_GATES)  # decisions that each gate's weights have learned from

    def predict(self, bits: Bits) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, gate, mixed, cell): the predictors' logits of a 1, which weights mix them, their sum, and its cell."""
        inputs, seen = [bits.plain], []
        for k in range(TABLES):
            both = self.counts[k].view(np.int64).ravel().take(bits.slots[k]).view(np.int32).reshape(-1, 2).astype(np.float32)
            n, ones = both[:, 0], both[:, 1]
            inputs.append(np.log((ones + np.float32(0.3)) / (n - ones + np.float32(0.3))))
            seen.append(n)
        level = (seen[1] > 0).view(np.int8) + (seen[1] > 2) + (seen[1] > 20)
        level *= np.int8(3)
        spelled = len(level) - len(seen[2])  # coded decisions come first
        level[spelled:] += seen[2] > 0
        level[spelled:] += seen[2] > 3
        gate = bits.kind * 12 + level
        mixed = self.weights[0].take(gate) * inputs[0]
        for k in range(1, _INPUTS):
            part = slice(len(gate) - len(inputs[k]), None)
            mixed[part] += self.weights[k].take(gate[part]) * inputs[k]
        np.clip(mixed, -_EDGE, _EDGE, out=mixed)
        cell = gate * _CELLS + (np.clip(mixed, -_RANGE, _RANGE) * np.float32(2) + np.float32(_CELLS / 2)).astype(np.int64)
        return inputs, gate, mixed, cell

    def _token_scores(self, bits: Bits, p: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
        """log10 of the probability of each of ``n`` tokens' decisions: the mixed one, averaged with what came true of like ones."""
        known = (self.cells[1].take(cell) + 4 * p) / (self.cells[0].take(cell) + 4)
        p = np.clip((p + known) / 2, 1e-6, 1 - 1e-6)
        return np.bincount(bits.token, np.log10(np.where(bits.bit == 1, p, 1 - p)), minlength=n)

    def scores(self, bits: Bits, n: int) -> np.ndarray:
        _, _, mixed, cell = self.predict(bits)
        return self._token_scores(bits, _squash(mixed), cell, n)

    def learn(self, bits: Bits, n: int, rate: float = 0.3) -> np.ndarray:
        """One online step. Returns the scores before it; then weights follow the error, cells and counts take in the decisions."""
        inputs, gate, mixed, cell = self.predict(bits)
        p = _squash(mixed)
        out = self._token_scores(bits, p, cell, n)
        y = bits.bit.astype(np.float32)
        error = y - p
        total = np.bincount(gate, minlength=_GATES)
        for k in range(_INPUTS):
            part = slice(len(gate) - len(inputs[k]), None)
            self.weights[k] += rate * np.bincount(gate[part], error[part] * inputs[k], minlength=_GATES) / (total + 50)
        self.behind += total
        came = np.bincount(cell, 1.0 + bits.bit * float(1 << 30), minlength=_GATES * _CELLS)  # both sums at once, exact below 2^22 decisions
        ones = np.floor(came / (1 << 30))
        self.cells[0] += came - ones * (1 << 30)
        self.cells[1] += ones
        both = np.ones((len(y), 2), np.int32)
        both[:, 1] = bits.bit
        both = both.view(np.int64).ravel()
        for k in range(TABLES):
            np.add.at(self.counts[k].view(np.int64).ravel(), bits.slots[k], both[len(both) - len(bits.slots[k]) :])
        return out


def held_out(doc_id) -> object:
    """Remainder 0 of the CRC-32 of the id as text by 10; a null id counts as empty text, so it is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): occurrences of the words of training documents. ``docs``: (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update((text or b"").lower().split())
            counts[b""] += batch.num_rows  # the ends
            if len(counts) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
                counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    return docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


#: Numbers in one row of a written state.
_BLOCK = 1 << 17


def _packed(state: Mixer) -> Iterator[pa.RecordBatch]:
    """What sums up over the states of all parts of the training texts: blocks of numbers under their place, compressed."""
    whole = [state.counts.reshape(-1).astype(np.float64), (state.weights * state.behind).ravel(), state.behind, state.cells.reshape(-1).astype(np.float64)]
    line = np.concatenate(whole)
    for i in range(0, len(line), _BLOCK):
        part = line[i : i + _BLOCK]
        if part.any():
            # Counts are small whole numbers; what follows them is kept as it is.
            raw = part.astype("<u4") if i + _BLOCK <= state.counts.size else part
            data = pa.compress(raw.tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([i // _BLOCK], pa.int32()), pa.array([data], pa.binary())], names=["block", "data"])


def _unpacked(block: int, data: bytes) -> np.ndarray:
    state = Mixer()
    whole = state.counts.size + state.weights.size + state.behind.size + state.cells.size
    size = min(_BLOCK, whole - block * _BLOCK)
    counts = (block + 1) * _BLOCK <= state.counts.size
    return np.frombuffer(pa.decompress(data, size * (4 if counts else 8), codec="zstd", asbytes=True), "<u4" if counts else "<f8").astype(np.float64)


def own_share(line: Line, scores: np.ndarray) -> np.ndarray:
    """Token scores in which the text's own words so far have a growing share of the probability, by how often they stood."""
    n = len(scores)
    at = np.arange(n)
    first = np.concatenate([[True], line.text[1:] != line.text[:-1]])
    i = at - np.maximum.accumulate(np.where(first, at, 0))
    same = line.hashed ^ (line.text.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)  # one number for each word of a text
    order = np.argsort(same, kind="stable")
    same = same[order]
    fresh = np.concatenate([[True], same[1:] != same[:-1]])
    stood = np.empty(n, np.int64)
    stood[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    own = OWN_SHARE / (i + OWN_HALF)
    return np.where(stood > 0, np.log10((1 - own * i) * 10.0 ** np.maximum(scores, -300) + own * stood), np.log10(1 - own * i) + scores)


def passages(line: Line, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, context, passage, score) of the passages behind the first of each text, repeated ones once.

    A passage ends behind the text's third word, where the hash of the last three words says so, about
    every ``PASSAGE`` words, and at the text's end. ``context`` is the hash of the three words before it, ``passage`` that of
    context and content: what follows the same three words elsewhere ends at the same place if it is
    the same.
    """
    before = _mix(line.hashed * _U(3) + _mix(line.before(1) * _U(5) + _mix(line.before(2) + _U(7))))
    inside = np.concatenate([line.text[1:] == line.text[:-1], [False]])
    three = line.before(2) != 0
    ends = (before % _U(PASSAGE) == 0) & three | three & (line.before(3) == 0) | ~inside
    last = np.nonzero(ends)[0]
    starts = np.concatenate([[0], last[:-1] + 1])
    kept = np.concatenate([[False], inside[last[:-1]]]) if len(last) else np.zeros(0, bool)
    sums = np.add.reduceat(scores, starts) if len(last) else scores
    starts, last, sums = starts[kept], last[kept], sums[kept]
    context = before[starts - 1]
    stop = line.start[last] + line.size[last]
    data, digest = line.data.tobytes(), xxhash.xxh3_64_intdigest
    content = np.array([digest(data[a:b], s) for a, b, s in zip(line.start[starts].tolist(), stop.tolist(), context.tolist(), strict=True)], np.uint64)
    order = np.lexsort((starts, content, context, line.text[starts]))
    order = order[np.concatenate([[True], (content[order][1:] != content[order][:-1]) | (line.text[starts][order][1:] != line.text[starts][order][:-1])])] if len(order) else order
    return line.text[starts][order], context[order], content[order], sums[order]


def _offsets(owner: np.ndarray, n: int) -> pa.Array:
    """Where each text's part of a list in the order of texts begins."""
    return pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))


_ROW = "doc_id {}, row long, n_tokens long, n_bytes long, known long, base double, part double, rest array<bigint>, passages array<struct<context:bigint,passage:bigint,lp:double>>"
_NAMES = ["doc_id", "row", "n_tokens", "n_bytes", "known", "base", "part", "rest", "passages"]


def _scored(ids: pa.Array, row: int, line: Line, book: Codebook, lp: np.ndarray, logs: np.ndarray) -> pa.RecordBatch:
    """A row for each text of ``line``; ``lp``: its tokens' scores, ``logs``: the base scores of coded words.

    ``part`` is the score but for copied passages; ``rest``: the hashes of spelled words, by which
    their counts are looked up elsewhere; ``row`` numbers rows from the given number on.
    """
    n = len(ids)
    lp = own_share(line, lp)
    spelled = np.nonzero(line.leaf == book.escape)[0]
    digest = xxhash.xxh64_intdigest
    words = pa.array(np.array([digest(line.words[i], 42) for i in spelled.tolist()], np.uint64).view(np.int64))
    owner, *columns = passages(line, lp)
    kinds = [x.view(np.int64) if x.dtype == np.uint64 else x for x in columns]
    found = pa.StructArray.from_arrays([pa.array(x) for x in kinds], names=["context", "passage", "lp"])
    sums = [np.bincount(line.text, x, minlength=n) for x in (line.size + 1, line.leaf != book.escape, logs.take(line.leaf), lp)]
    values = [np.arange(row, row + n), np.bincount(line.text, minlength=n), sums[0].astype(np.int64), sums[1].astype(np.int64), *sums[2:]]
    lists = [pa.ListArray.from_arrays(_offsets(line.text[spelled], n), words), pa.ListArray.from_arrays(_offsets(owner, n), found)]
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, values), *lists], names=_NAMES)


def _first_row(half: int) -> int:
    """Rows of a task are numbered from here on."""
    return (2 * TaskContext.get().partitionId() + half) << 40


def _groups(batches: Iterator[pa.RecordBatch], size: int = GROUP) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(part, rows): up to ``size`` neighbouring rows of a part (the third column), whatever batches they come in."""
    held, n, at = [], 0, None

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        parts = batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b and at is not None and parts[a] != at and held:
                yield at, whole()
                held, n = [], 0
            while a < b:
                at, take = parts[a], min(b - a, size - n)
                held.append(batch.slice(a, take))
                a, n = a + take, n + take
                if n == size:
                    yield at, whole()
                    held, n = [], 0
    if held:
        yield at, whole()


def learn_and_score(docs: DataFrame, book: Codebook, logs: np.ndarray, first: Mixer | None = None) -> DataFrame:
    """Scores of training texts, and the states learned from them. ``docs``: (doc_id, text, part), the parts sorted and whole.

    Every part reads its texts in order, from the ``first`` state on: each step is predicted from what
    has been learned so far, which gives its scores, and then learned from. Rows with a ``block`` hold
    a part's state at its end, some 5 MB whatever its texts, and the part as ``row``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((book.parts(), logs, first and vars(first)))  # CODED words at most, and a state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, logs, begun = shared.value
        state, at, book, row = None, None, Codebook.of_parts(parts), _first_row(0)

        def ended() -> Iterator[pa.RecordBatch]:
            for held in _packed(state):
                columns = [pa.nulls(1, t) for t in types]
                columns[1] = pa.array([at], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, *held.columns], names=[*_NAMES, "block", "data"])

        for part, batch in _groups(batches):
            if state is None or part != at:
                if state is not None:
                    yield from ended()
                state, at = Mixer(), int(part)
                if begun:
                    vars(state).update({k: v.copy() for k, v in begun.items()})
            line = Line.of([tokens(t.as_py()) for t in batch.column(1)], book)
            known = Contexts(line, book)
            lp = book.words.rest.take(book.symbol.take(line.leaf))
            for a in range(0, len(lp), STEP):
                b = min(len(lp), a + STEP)
                lp[a:b] += state.learn(known.bits(a, b), b - a)
            out = _scored(batch.column(0), row, line, book, lp, logs)
            row += batch.num_rows
            empty = [pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([*out.columns, *empty], names=[*_NAMES, "block", "data"])
        if state is not None:
            yield from ended()

    kind = docs.schema["doc_id"].dataType
    schema = _ROW.format(kind.simpleString())
    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema.replace(kind.simpleString(), "long", 1)).fields]
    types[0] = to_arrow_type(kind)
    return docs.mapInArrow(run, f"{schema}, block int, data binary")


def merged(states: DataFrame, first: Mixer | None = None) -> Mixer:
    """One state of many, (block, data, row): counts and what came true add up, weights are averaged by the decisions that they learned from.

    ``first``: the state that all of them began from, which so counts once. Sums run in the order of
    parts, so they are the same in every layout.
    """

    def summed(block: int, total: np.ndarray) -> pa.RecordBatch:
        data = pa.compress(total.tobytes(), codec="zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["block", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by block: one block's sum is held at a time."""
        at, total = None, None
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = _unpacked(block, data.as_py())
                if block != at:
                    if at is not None:
                        yield summed(at, total)
                    at, total = block, part
                else:
                    total = total + part
        if at is not None:
            yield summed(at, total)

    with dropped_shuffles(states.sparkSession):
        many = states.select("row").distinct().count()
        got = states.repartition("block").sortWithinPartitions("block", "row").select("block", "data").mapInArrow(add, "block int, data binary").toArrow()
    if not many:
        return first or Mixer()
    out = Mixer()
    size, sizes = out.counts.size, [out.weights.size, out.behind.size, out.cells.size]
    counts, rest = out.counts.reshape(-1), np.zeros(sum(sizes))
    # A block at a time, so that the driver never holds the counts as wide sums.
    for block, data in zip(got.column(0).to_pylist(), got.column(1), strict=True):
        at = block * _BLOCK
        part = np.frombuffer(pa.decompress(data.as_py(), min(_BLOCK, size + len(rest) - at) * 8, codec="zstd"), "<f8")
        mine = part[: max(0, size - at)]
        if first is not None:
            mine = mine - (many - 1) * first.counts.reshape(-1)[at : at + len(mine)].astype(np.float64)
        counts[at : at + len(mine)] = np.minimum(mine, (1 << 31) - 1).astype(np.int32)
        over = at + len(mine) - size
        if over >= 0:
            rest[over : over + len(part) - len(mine)] = part[len(mine) :]
    weights, behind, cells = np.split(rest, np.cumsum(sizes)[:-1])
    learned = behind > 0
    out.weights[:, learned] = (weights.reshape(out.weights.shape)[:, learned] / behind[learned]).astype(np.float32)
    out.behind, out.cells = behind, cells.astype(np.float32).reshape(out.cells.shape)
    if first is not None:
        out.cells -= np.float32(many - 1) * first.cells
        out.behind = out.behind - (many - 1) * first.behind
    return out


def score_texts(docs: DataFrame, book: Codebook, state: Mixer, logs: np.ndarray) -> DataFrame:
    """Scores of texts that ``state`` has not learned from. ``docs``: (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((book.parts(), vars(state), logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, learned, logs = shared.value
        book, state, row = Codebook.of_parts(parts), Mixer.__new__(Mixer), _first_row(1)
        vars(state).update(learned)
        for batch in batches:
            if not batch.num_rows:
                continue
            line = Line.of([tokens(t.as_py()) for t in batch.column(1)], book)
            known = Contexts(line, book)
            lp = book.words.rest.take(book.symbol.take(line.leaf))
            for a in range(0, len(lp), STEP):
                b = min(len(lp), a + STEP)
                lp[a:b] += state.scores(known.bits(a, b), b - a)
            yield _scored(batch.column(0), row, line, book, lp, logs)
            row += batch.num_rows

    return docs.mapInArrow(run, _ROW.format(docs.schema["doc_id"].dataType.simpleString()))


def copied_passages(rows: DataFrame, keep: Scratch) -> DataFrame:
    """(row, gain): what each document's score gains by passages that followed the same three words in training texts.

    Where a context stood in other training documents, a share of the probability goes to what
    followed it there, by frequency; the share, by how often the context stood, is the part of such
    passages in training documents that had been seen in another. A document's own passages count
    for it only if it stands in the table again. The table of passages grows with the corpus; passages whose context
    stands once are gone before anything else is moved.
    """
    each = rows.select("row", "held_out", F.explode("passages").alias("p")).select("row", "held_out", "p.*")
    again = keep(each.groupBy("context").agg(F.count("*").alias("k")).filter("k > 1").select("context"), "lm-contexts")
    each = keep(each.join(again, "context"), "lm-passages")
    learned = each.filter("not held_out")
    seen = learned.groupBy("context", "passage").agg(F.count("*").alias("c"))
    behind = learned.groupBy("context").agg(F.count("*").alias("all"))
    mine = each.groupBy("row", "context").agg(F.count("*").alias("own")).withColumnsRenamed({"row": "r", "context": "x"})
    met = each.join(seen, ["context", "passage"], "left").join(behind, "context", "left").join(mine, (each["row"] == mine["r"]) & (each["context"] == mine["x"]))
    own = F.when(F.col("held_out"), 0)
    met = met.select(
        "row",
        "held_out",
        "lp",
        (F.coalesce("c", F.lit(0)) - own.otherwise(1)).alias("c"),
        (F.coalesce("all", F.lit(0)) - own.otherwise(F.col("own"))).alias("all"),
    ).filter(F.col("all") > 0)
    met = keep(met.withColumn("level", F.least(F.lit(3), F.floor(F.log2("all"))).cast("int")), "lm-met")
    hits = {r["level"]: (r["hit"] + 0.5) / (r["k"] + 1) for r in met.filter("not held_out").groupBy("level").agg(F.count("*").alias("k"), F.count(F.when(F.col("c") > 0, 1)).alias("hit")).collect()}
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k in range(4) for x in (k, min(0.95, hits.get(k, 0.5)))]), F.col("level")), F.lit(0.5))
    # A passage counts once for a text; what repeats it there has the text's own words to go by.
    gain = F.when(F.col("c") > 0, F.log10(share * F.col("c") / F.col("all") + (1 - share) * F.pow(F.lit(10.0), F.greatest("lp", F.lit(-300.0)))) - F.col("lp")).otherwise(F.log10(1 - share))
    return met.groupBy("row").agg(F.sum(gain).alias("gain"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    ``score`` is the log10 probability of the text's tokens, its end being one, under a model that
    learned from training documents alone. Those are predicted before they are learned from: some
    million tokens first, then parts of some eight million, each going on from the state that those
    left; held-out ones by the merged state of all parts. Parts are made by hashes of ids and texts, so
    scores do not hang on files, partitions or cores. Within a text the words so far get a growing share of the
    next word's probability. Passages that follow the same three words in other training documents
    get a share as well, so a text that the corpus holds twice scores far better than one that it
    holds once.

    Null and empty texts are their end alone. Without any training document, words are spelled by
    bytes of equal chance. Very long texts are read in steps of 4000 tokens and keep their contexts
    across them. Repeated rows count as often as they stand and each get their row; a document that
    stands twice is a copy of itself. Ids may be of any type, and null; an empty table gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    source = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    training = source.filter(~F.col("held_out")).select("doc_id", "text")
    with Scratch(spark) as keep:
        words = keep(count_words(training.select("text")), "lm-counts")
        n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        first = words.filter("c > 1").orderBy(F.desc("c"), "word").limit(CODED).toArrow()
        coded, counts = first.column("word").to_pylist(), first.column("c").to_pylist()
        book = Codebook(coded, counts, n - sum(counts))
        below = n + 0.1 * (v + 1)
        logs = np.log10([*((np.array(counts) + 0.1) / below), 1.0])
        # Parts hang on ids, texts and the corpus's size alone, so scores do not change with cores or files.
        parts, some = max(1, n // PART_TOKENS), max(2, n // FIRST_TOKENS)
        key = F.xxhash64("doc_id", "text")
        placed = training.withColumn("key", key).withColumn("part", F.when(F.pmod("key", F.lit(some)) == 0, -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(parts))).cast("long"))
        inside = ["part", "key"]  # rows of one hash are equal
        begun = placed.filter("part = -1").repartition(1, "part").sortWithinPartitions(*inside).select("doc_id", "text", "part")  # FIRST_TOKENS, about
        opened = keep(learn_and_score(begun, book, logs), "lm-first")
        first = merged(opened.filter("block is not null").select("block", "data", "row"))
        others_ = placed.filter("part >= 0").repartition(parts, "part").sortWithinPartitions(*inside).select("doc_id", "text", "part")
        passed = keep(learn_and_score(others_, book, logs, first), "lm-pass")
        state = merged(passed.filter("block is not null").select("block", "data", "row"), first)
        few = max(spark.sparkContext.defaultParallelism, parts // 4)  # each task reads the code; where a text is scored does not matter
        apart = keep(score_texts(source.filter("held_out").select("doc_id", "text").coalesce(few), book, state, logs), "lm-apart")
        passed = passed.unionByName(opened.withColumn("row", F.col("row") + F.lit(1 << 61)))
        rows = passed.filter("block is null").select(F.lit(False).alias("held_out"), *_NAMES).union(apart.select(F.lit(True), *_NAMES))
        # A spelled word is too rare to be a hot key.
        counted = words.filter((F.col("c") <= (counts[-1] if counts else 1))).select(F.xxhash64("word").alias("word"), "c")  # the others have a code
        rare = rows.select("row", F.explode("rest").alias("word")).join(counted, "word", "left")
        known = rare.groupBy("row").agg(F.count("c").alias("known2"), F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(float(below)))).alias("base2"))
        known = keep(known, "lm-rare")
        gains = keep(copied_passages(rows, keep), "lm-gains")
        score = F.col("part") + F.coalesce("gain", F.lit(0.0))
        out = rows.drop("rest", "passages").join(known, "row", "left").join(gains, "row", "left").select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
            F.lit(int(n)).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"),
            score.alias("score"),
            (-score * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
        )
        return materialize(out, "lm-scores")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the columns of :func:`score_documents`."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
