"""Quality classifier: ordinal cumulative-link regression over hashed text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.common import named, numbered, others, small_batches

#: Hash space of the features. Wide, as one clash with a telling word would mark clean long texts.
SPACE = 1 << 31
#: Labelled rows that the fit may take: those with the lowest hashed ids.
MAX_LABELLED = 16000
#: Steps of the fit between two looks at the weights that are 0.
ROUND = 25
#: The fit ends when no weight and no threshold moves further than this in a round.
SETTLED = 0.01
#: Features of the fit that are widened to sums at once.
CHUNK = 1 << 18

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def features(text: str | None) -> list[int]:
    """Distinct hashed features of a whole text: its words (lower-cased) and punctuation runs, what is frequent in it, and the shares of capitals, repeated lines and repeated words."""
    text = text or ""
    tokens = _TOKEN.findall(text)
    n = max(1, len(tokens))
    counts = Counter(tokens)
    seen = {t.lower() for t in counts}
    said = [f"w {t}" for t in seen]
    capitals = sum(c for t, c in counts.items() if len(t) > 1 and t.isupper())
    for name, share in (
        ("capitals", capitals / n),
        ("marks", sum(c for t, c in counts.items() if not t[0].isalnum()) / n),
        ("distinct", len(seen) / n if n >= 50 else -1),
    ):
        said.append(f"share {name} {int(share * 8)}")
    said += [f"often {t}" for t, c in counts.items() if not t[0].isalnum() and c * 20 >= n and c > 2]
    lines = [x for x in text.splitlines() if x.strip()]
    said.append(f"lines {int(8 * len(set(lines)) / len(lines)) if len(lines) > 3 else -1}")
    said.append(f"length {min(12, len(tokens).bit_length())}")
    return sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) % SPACE for x in said})


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade >= k) = 1 / (1 + exp(threshold_k - score)); one weight vector for all k, thresholds ascending."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each score."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - scores[:, None], -50, 50)))

    def score(self, text: str | None) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(text))


def fit(flat: np.ndarray, lengths: np.ndarray, grades: np.ndarray, levels: int, least_docs: int = 4, l1: float = 0.0003, l2: float = 0.0002, steps: int = 3000) -> OrdinalModel:
    """Fit on hashed features by accelerated proximal gradient. ``flat``: the rows' features end to end, ``lengths`` of them each.

    The loss is the mean of -log P(grade) of the cumulative-link (proportional odds) model, where
    P(grade k) = P(grade >= k) - P(grade >= k + 1): one score moves all grades. The first threshold
    and the logarithms of the gaps above it are what is learned, so thresholds ascend by
    construction. Rows count alike, so the chances are those of the labelled rows. Features of fewer
    than ``least_docs`` rows are left out; the lasso term leaves weights only on telling ones, so
    that long texts do not drift. Without rows all weights are 0 and every text has the top grade;
    a grade that no row has keeps a chance of about one in a million.
    """
    y = np.asarray(grades, np.int64)
    if not len(y):
        return OrdinalModel({}, tuple(-30.0 - 0.1 * k for k in range(levels - 1, 0, -1)))
    shares = np.clip([np.mean(y >= k) for k in range(1, levels)], 1e-6, 1 - 1e-6)
    theta = np.maximum.accumulate(-np.log(shares / (1 - shares)))
    first, gaps = theta[0], np.log(np.maximum(np.diff(theta), 1e-3))
    ids, counts, owner, columns = _told(np.asarray(flat), np.asarray(lengths), least_docs)
    w, v, t = np.zeros(len(ids)), np.zeros(len(ids)), 1.0
    width = np.maximum(1, np.bincount(owner, minlength=len(y)))
    step = 2.0 / np.mean(width) * len(y) / 40
    scale = np.sqrt(np.maximum(1, counts / len(y) * 50))  # frequent features move less
    thresholds = lambda: first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    for start in range(0, steps, ROUND):
        # Weights that are 0 and whose slope the lasso outweighs stay so; a round moves the others only.
        error = _slopes(_summed(owner, columns, v, len(y)), thresholds(), y)[0]
        slope = _summed(columns, owner, error, len(ids)) / len(y)
        active = (w != 0) | (v != 0) | (np.abs(slope) > l1)
        some = active[columns]
        at, number = owner[some], (np.cumsum(active, dtype=np.int32) - 1)[columns[some]]
        aw, av, ascale = w[active], v[active], scale[active]
        before, stood = aw, thresholds()
        for _ in range(min(ROUND, steps - start)):
            score = _summed(at, number, av, len(y))
            error, slopes = _slopes(score, thresholds(), y)
            moved = av - step * (_summed(number, at, error, len(aw)) / len(y) + l2 * av) / ascale
            new = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1 / ascale)
            first -= 2.0 * slopes.sum()
            gaps = np.clip(gaps - 2.0 * np.exp(gaps) * np.cumsum(slopes[::-1])[::-1][1:], -7, 4)  # a gap moves all thresholds above it
            if np.dot(av - new, new - aw) > 0:  # the momentum works against the slope: begin anew
                t = 1.0
            later = (1 + np.sqrt(1 + 4 * t * t)) / 2
            av, aw, t = new + (t - 1) / later * (new - aw), new, later
        w[active], v[active] = aw, av
        if np.abs(thresholds() - stood).max() < SETTLED and np.abs(aw - before).max(initial=0) < SETTLED:
            break
    return OrdinalModel({int(i): float(x) for i, x in zip(ids, w, strict=True) if x}, tuple(float(x) for x in thresholds()))


def _told(flat: np.ndarray, lengths: np.ndarray, least_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of ``least_docs`` rows or more, but not of all, and their counts; whose each occurrence is, and its feature's place.

    Small numbers, made a chunk at a time: the driver holds some ten bytes for each occurrence.
    """
    ids, counts = np.unique(flat, return_counts=True)
    kept = (counts >= least_docs) & (counts < len(lengths))
    ids, counts = ids[kept], counts[kept]
    ends, n, at = np.cumsum(lengths), int(counts.sum()), 0
    owner, columns = np.empty(n, np.int32), np.empty(n, np.int32)
    for a in range(0, len(flat) if len(ids) else 0, CHUNK):
        part = flat[a : a + CHUNK]
        place = np.searchsorted(ids, part)
        mask = ids[np.minimum(place, len(ids) - 1)] == part
        b = at + np.count_nonzero(mask)
        owner[at:b], columns[at:b] = np.searchsorted(ends, np.flatnonzero(mask) + a, side="right"), place[mask]
        at = b
    return ids, counts, owner, columns


def _summed(to: np.ndarray, of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values[of]`` by ``to``, in order, a chunk at a time."""
    out = np.zeros(n)
    for a in range(0, len(to), CHUNK):
        np.add.at(out, to[a : a + CHUNK].astype(np.intp), values[of[a : a + CHUNK]])
    return out


def _slopes(score: np.ndarray, theta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of -log P(grade): of each row by its score, and of their mean by each threshold."""
    rows = np.arange(len(y))
    tails = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -50, 50)))
    padded = np.hstack([np.ones((len(y), 1)), tails, np.zeros((len(y), 1))])
    lower, upper = padded[rows, y], padded[rows, y + 1]  # P(grade >= y), P(grade >= y + 1)
    chance = np.maximum(lower - upper, 1e-12)
    slope = np.zeros((len(y), len(theta) + 2))
    slope[rows, y] = lower * (1 - lower) / chance
    slope[rows, y + 1] -= upper * (1 - upper) / chance
    return lower + upper - 1, slope[:, 1:-1].mean(0)


def loss(model: OrdinalModel, scores: np.ndarray, grades: np.ndarray) -> float:
    """Mean of -log P(grade) of rows with these scores."""
    padded = np.hstack([np.ones((len(grades), 1)), model.tails(scores), np.zeros((len(grades), 1))])
    rows = np.arange(len(grades))
    return float(-np.log(np.maximum(padded[rows, grades] - padded[rows, np.asarray(grades) + 1], 1e-12)).mean())


def grade(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 neither toxic nor good, 2 good and not toxic; repeated ids take their lowest grade, rows without labels or id are left out."""
    points = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    known = labels.select("doc_id", "quality", "toxic").dropna().filter("quality in (0, 1) and toxic in (0, 1)")
    return known.select("doc_id", points.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most ``max_labelled`` labelled documents (the lowest hashed ids), hashed on the executors.

    Repeated ids count once, with the text of the least hash, so reruns agree. Null texts are empty.
    """
    small_batches(docs.sparkSession)
    chosen = grade(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows of 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), found], names=["doc_id", "grade", "features"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    said = rows.mapInArrow(run, f"doc_id {kind}, grade int, features array<int>")
    hashed = F.xxhash64(F.col("features").cast("array<bigint>"))
    one = said.groupBy("doc_id").agg(F.min(F.struct(hashed, "grade", "features")).alias("one"))
    return fit(*_collected(one.select("doc_id", "one.grade", "one.features")), 3)


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features end to end, how many each row has, and grades, by id; four bytes a feature, and no copy of the table stays."""
    got = rows.toArrow()
    order = pc.sort_indices(got.column("doc_id"))
    grades, lengths = got.column("grade").take(order).to_numpy(), pc.list_value_length(got.column("features")).take(order).to_numpy()
    lists, flat, at = got.column("features").combine_chunks(), np.empty(int(lengths.sum()), np.int32), 0
    del got
    starts, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    for a, n in zip(starts[order.to_numpy()].tolist(), lengths.tolist(), strict=True):
        flat[at : at + n] = values[a : a + n]
        at += n
    return flat, lengths, grades


def score_quality(docs: DataFrame, model: OrdinalModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and ``score``, ``p_ge1`` (not toxic), ``p_ge2`` (good as well), ``expected_grade``.

    Every row gets its result, repeated ones each their own; null and empty texts have only the
    features of emptiness; very long texts count whole. An empty table gives no rows. Kept columns
    named like a result's are replaced by it.
    """
    small_batches(docs.sparkSession)
    keep = others(keep, ("score", "p_ge1", "p_ge2", "expected_grade"))
    source = numbered(docs, [*keep, text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t.as_py()) for t in batch.column(len(keep))], float)
            tails = model.tails(scores)
            columns = [scores, tails[:, 0], tails[:, 1], tails.sum(1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(c, pa.float64()) for c in columns)], names=[*keep, "score", "p_ge1", "p_ge2", "expected_grade"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return source.mapInArrow(run, f"{fields}score double, p_ge1 double, p_ge2 double, expected_grade double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their expected grade, tail probabilities and whether they are kept (P(grade 2) of a half or more)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, ["doc_id"]).withColumn("keep", F.col("p_ge2") >= 0.5)


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose P(grade 2) is at least ``least``, with their columns as they are, whatever their names.

    Without labels all rows stay; null and empty texts are judged by the features of emptiness, repeated
    rows alike, very long texts whole; an empty table stays empty.
    """
    model = train(docs, labels, text_col=text_col)
    small_batches(docs.sparkSession)
    at, schema, names = docs.columns.index(text_col), docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t.as_py()) for t in batch.column(at)], float)
            yield batch.filter(pa.array(model.tails(scores)[:, -1] >= least, pa.bool_())).rename_columns(names)

    return numbered(docs, names).mapInArrow(run, schema)
