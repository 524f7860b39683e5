"""How far the sources of a language differ in their words: sketched, counted exactly, compared in pairs."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.llm.common import Scratch, materialize, named, shuffle_partitions, small_batches

#: The sketch: this many rows of this many counters of one byte, cut into pieces of PIECE counters.
#: A task holds DEPTH * WIDTH bytes of it, the driver and each task a bit for each counter.
DEPTH, WIDTH, PIECE = 3, 1 << 22, 1 << 17
#: A task hands on its counts when it holds this many different terms.
HELD = 200_000
SCALE = 1_000_000_000

#: Terms are runs of ASCII letters and of all bytes of other characters; A-Z becomes a-z, anything else a space.
_FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _cells(keys: list[bytes], lang: bytes) -> np.ndarray:
    """(DEPTH, len(keys)): the counter of each (language, term) in each row, two hash halves stepped by the row."""
    seed = xxhash.xxh3_64_intdigest(lang)
    h = np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in keys), np.uint64, len(keys))
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) % np.uint64(WIDTH) for i in range(DEPTH)]).astype(np.int64)


def _texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Three binary columns, nulls as empty, so that Python reads bytes and never decodes."""
    return docs.select(*[F.coalesce(named(c).cast("string"), F.lit("")).cast("binary").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def sketch(texts: DataFrame, least: int, hold: Scratch) -> list[bytes]:
    """For each counter of the merged count-min sketch of document frequencies a bit: is it ``least`` or more?

    Every task counts in how many of its documents a term stands, adds that to the term's counters
    and hands on the counters in compressed pieces; pieces are added up where they meet, one piece's
    sum at a time. Counters stop at 255, so they never say less than the truth below that.
    """
    if not 0 < least <= 255:
        raise ValueError("counters of one byte tell frequencies up to 255")
    pieces = WIDTH // PIECE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((DEPTH, WIDTH), np.uint8)
        found: dict[bytes, Counter] = defaultdict(Counter)

        def add() -> None:
            for lang, seen in found.items():
                keys, n = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
                for row, cells in zip(table, _cells(keys, lang), strict=True):
                    order = np.argsort(cells)
                    at, first = np.unique(cells[order], return_index=True)
                    row[at] = np.minimum(row[at] + np.add.reduceat(n[order], first), 255) if len(at) else 0
            found.clear()

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                seen, before = found[lang], len(found[lang])
                seen.update(set(terms(text.as_py())))
                held += len(seen) - before
                if held > HELD:
                    add()
                    held = 0
        add()
        for i in range(DEPTH):
            for p in range(pieces):
                part = table[i, p * PIECE : (p + 1) * PIECE]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"piece": pa.array([i * pieces + p], pa.int32()), "counts": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
                sums[piece] = np.minimum(sums[piece].astype(np.uint16) + part, 255).astype(np.uint8) if piece in sums else part
        for piece, part in sums.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "bits": pa.array([np.packbits(part >= least).tobytes()], pa.binary())})

    parts = texts.mapInArrow(count, "piece int, counts binary").repartition(min(DEPTH * pieces, shuffle_partitions(texts.sparkSession)), "piece")
    # A bit for each counter, however large the corpus: DEPTH * WIDTH / 8 bytes at most.
    rows = {r["piece"]: bytes(r["bits"]) for r in hold(parts.mapInArrow(merge, "piece int, bits binary"), "divergence-sketch").collect()}
    return [b"".join(rows.get(i * pieces + p, bytes(PIECE // 8)) for p in range(pieces)) for i in range(DEPTH)]


def term_counts(texts: DataFrame, least: int, hold: Scratch) -> DataFrame:
    """(lang, source, term, n): occurrences of the terms that ``least`` documents of the language or more hold, counted exactly."""
    bits = sketch(texts, least, hold)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [np.frombuffer(row, np.uint8) for row in bits]
        counts: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)
        docs: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)

        def give() -> Iterator[pa.RecordBatch]:
            for group, seen in docs.items():
                keys = list(seen)
                may = np.ones(len(keys), bool)
                for row, cells in zip(table, _cells(keys, group[0]), strict=True):
                    may &= (row[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
                keys = [k for k, ok in zip(keys, may, strict=True) if ok]
                n = counts[group]
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([group[0]] * len(keys), pa.binary()),
                        "source": pa.array([group[1]] * len(keys), pa.binary()),
                        "term": pa.array(keys, pa.binary()),
                        "n": pa.array([n[k] for k in keys], pa.int64()),
                        "docs": pa.array([seen[k] for k in keys], pa.int64()),
                    }
                )
            counts.clear()
            docs.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = terms(text.as_py())
                seen = docs[lang, source]
                before = len(seen)
                seen.update(set(words))
                counts[lang, source].update(words)
                held += len(seen) - before
                if held > HELD:
                    yield from give()
                    held = 0
        yield from give()

    as_text = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")]
    survivors = texts.mapInArrow(count, "lang binary, source binary, term binary, n bigint, docs bigint").select(*as_text, "n", "docs")
    by_source = hold(survivors.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-survivors")
    kept = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("all")).filter(F.col("all") >= least)
    return hold(by_source.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "divergence-terms")


def _rate(n: Column, total: Column, terms_: Column) -> Column:
    """1 + floor(1e9 (n + 2) / (total + 2 V)) in decimals, as counts of words times 1e9 can pass a long."""
    whole = (n.cast("decimal(20,0)") + 2).cast("decimal(22,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", whole.cast("decimal(38,0)"), (total.cast("decimal(20,0)") + terms_.cast("decimal(20,0)") * 2).cast("decimal(38,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are 1e9 + 1 at most, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(
    docs: DataFrame, least: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", salts: int = 16
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and by which terms.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps
    those in ``least`` of its documents or more. A merged count-min sketch of document frequencies,
    which never says too little, rules terms out where they are read; the others are counted exactly.
    A count becomes a smoothed rate p of parts in a billion, and two rates differ by
    floor((p - q)^2 / (p + q)). Part ``pair``: the sum over all kept terms for each other source.
    Terms that neither of two sources has add the same amount each, and those that one of them has
    depend on its count alone, so only the terms of both are joined. Part ``term``: the ``top`` terms
    that a source has more of than its language.

    Null texts, languages and sources are empty strings; documents without terms, and empty texts,
    still make their group occur. Repeated rows are documents of their own; very long texts are read
    whole. A language that keeps no term has pairs of value 0 and no terms; a language of one source
    has no pairs; an empty table gives no rows. Ties in value go by item. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = _texts(docs, text_col, lang_col, source_col)
    with Scratch(spark) as hold:
        counts = term_counts(texts, least, hold)
        vocabulary = counts.groupBy("lang").agg(F.count_distinct("term").alias("V"))
        occurring = texts.select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).distinct()
        totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = occurring.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").fillna(0, ["total", "V"])
        # The rate of a term that the group does not have.
        groups = hold(groups.withColumn("p0", F.when(F.col("V") > 0, _rate(F.lit(0), F.col("total"), F.col("V")))), "divergence-groups")
        rates = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "p0", "V", _rate(F.col("n"), F.col("total"), F.col("V")).alias("p"))
        rates = hold(rates, "divergence-rates")

        def side(x: str) -> DataFrame:
            return groups.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "p0", "V")])

        # Sources of a language meet: as many rows as the result has. Salted, as there are few languages.
        salted = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        others = side("b").withColumn("salt", salted)
        none = F.coalesce(F.col("V_b") * _apart(F.col("p0_a"), F.col("p0_b")), F.lit(0))
        here = side("a").withColumn("salt", F.pmod(F.hash("source_a"), F.lit(salts)))
        apart = here.join(others, ["lang", "salt"]).filter("source_a <> source_b").select("lang", "source_a", "source_b", none.cast("long").alias("value"))
        # What a term of one source adds against a source that lacks it hangs on its rate alone.
        shapes = rates.groupBy("lang", F.col("source").alias("source_a"), F.col("p0").alias("p0_a"), "p").agg(F.count("*").alias("terms"))
        shapes = shapes.withColumn("salt", F.pmod(F.hash("source_a", "p"), F.lit(salts)))
        gain = F.col("terms") * (_apart(F.col("p"), F.col("p0_b")) - _apart(F.col("p0_a"), F.col("p0_b")))
        single = shapes.join(others, ["lang", "salt"]).filter("source_a <> source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(gain).alias("value"))
        # The terms of both, once for each pair of sources.
        a, b = (rates.select("lang", "term", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "p0")]) for x in "ab")
        both = a.join(b, ["lang", "term"]).filter("source_a < source_b")
        mended = _apart(F.col("p_a"), F.col("p_b")) - _apart(F.col("p_a"), F.col("p0_b")) - _apart(F.col("p0_a"), F.col("p_b")) + _apart(F.col("p0_a"), F.col("p0_b"))
        shared = both.groupBy("lang", "source_a", "source_b").agg(F.sum(mended).alias("value"))
        back = [F.col("lang"), F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), F.col("value")]
        summed = apart.union(single).union(single.select(*back)).union(shared).union(shared.select(*back))
        pairs = summed.groupBy("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item")).agg(F.sum("value").alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))

        by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_q")).join(counts.groupBy("lang").agg(F.sum("n").alias("total_q")), "lang").join(vocabulary, "lang")
        by_lang = by_lang.select("lang", "term", _rate(F.col("n_q"), F.col("total_q"), F.col("V")).alias("q"))
        more = rates.join(by_lang, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
        best = more.withColumn("rank", rank).filter(F.col("rank") <= top)  # the first ones of each task before any move
        best = best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
        return materialize(pairs.union(best), "divergence")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all languages of ``documents``; see :func:`audit`."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


#: The same from all terms of all groups.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
vocab AS (SELECT lang, count(*)::HUGEINT AS V FROM kept GROUP BY 1),
n AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
grp AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS c FROM grp g JOIN kept k ON g.lang = k.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * V) AS p FROM cells JOIN vocab USING (lang)),
lc AS (SELECT lang, term, sum(c) AS c FROM cells GROUP BY 1, 2),
q AS (SELECT lang, term, 1 + (1000000000 * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * V) AS q FROM lc JOIN vocab USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(pv.value, 0)::BIGINT AS value FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pv ON pv.lang = g.lang AND pv.source = g.source AND pv.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 10
"""
