"""Personal data, and the terms around it that give it away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.llm.common import Scratch, lower_ascii, materialize, named, others

#: Kinds in the order in which spans are listed; the last is the method's own.
KINDS = ["email", "ip", "card", "phone", "term"]
#: Patterns that match as the plain ones do from left to right, but never go back into what they have read: where a
#: run cannot match from its first character, it cannot from a later one. Card numbers are whole chains of 16 to 19
#: digits at once; addresses may begin where the last one ended, within a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
#: Terms are runs of letters, marks and digits.
_TERM_CHARS = r"[\p{L}\p{M}\p{N}]"
#: Characters before and after an entity that count as its surroundings.
AROUND = 120
_SPAN = "array<struct<kind:int,start:int,end:int>>"


def _worth_a_look(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind in ("email", "phone"):
        return text.contains("@" if kind == "email" else "+")
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")


def _passes(kind: Column, value: Column) -> Column:
    """What a match has to be besides its pattern: octets up to 255, Luhn's sum, 8 to 15 digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    luhn = F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda d, i: doubled(d.cast("int"), i)), F.lit(0), lambda a, x: a + x) % 10 == 0
    at = {k: i for i, k in enumerate(KINDS)}
    return (
        F.when(kind == at["ip"], value.rlike(_OCTETS))
        .when(kind == at["card"], luhn)
        .when(kind == at["phone"], F.length(digits).between(8, 15))
        .otherwise(F.lit(True))
    )


def _matches(text: str, kind: Column, pattern: Column, where: Column) -> dict[str, Column]:
    """Columns that cut the text at its matches: what stands between them, and the matches."""
    return {
        "_between": F.when(where, F.split(F.col(text), pattern, -1)),
        "_found": F.when(where, F.regexp_extract_all(F.col(text), pattern, F.lit(0))),
        "_kind": kind,
    }


def _hits(around: int) -> Column:
    """Each match with its number, the length of what stands before it and the text around it, from the columns of :func:`_matches`."""
    n = F.size("_found")
    zipped = F.arrays_zip(F.col("_found").alias("value"), F.slice("_between", F.lit(1), n).alias("left"), F.slice("_between", F.lit(2), n).alias("right"))
    hit = lambda z, i: F.struct(
        F.col("_kind").alias("kind"), i.alias("i"), F.length(z["left"]).alias("gap"), z["value"].alias("value"), F.right(z["left"], F.lit(around)).alias("left"), F.left(z["right"], F.lit(around)).alias("right")
    )
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,value:string,left:string,right:string>>")
    return F.when(n > 0, F.transform(zipped, hit)).otherwise(empty)


def _placed(hits: DataFrame) -> DataFrame:
    """``start`` and ``end`` of exploded hits: what stands before them of their text, summed along it. ``hits``: row, kind, i, gap, value."""
    along = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("value")
    return hits.withColumn("end", F.sum(F.col("gap") + size).over(along).cast("int")).withColumn("start", F.col("end") - size)


def scan(docs: DataFrame, keep: list[str], text_col: str, hold: Scratch, around: int = AROUND) -> tuple[DataFrame, DataFrame]:
    """All documents (row, ``keep``, and ``text`` where something matches) and the valid base spans (row, kind, start, end, entity, left, right, same).

    ``same`` tells equal texts by a hash. Offsets are code points. The texts are read once; positions
    are summed over the matches alone.
    """
    own = docs.select(*[named(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(named(text_col), F.lit("")).alias("text"))
    found = own
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        found = found.withColumns(_matches("text", F.lit(i), F.lit(pattern), _worth_a_look(kind, F.col("text")))).withColumn(f"_h{i}", _hits(around)).drop("_between", "_found", "_kind")
    hits = F.concat(*[F.col(f"_h{i}") for i in range(len(PATTERNS))])
    found = found.withColumn("hits", hits).drop(*[f"_h{i}" for i in range(len(PATTERNS))])
    kept = found.withColumns({"row": F.monotonically_increasing_id(), "same": F.xxhash64("text"), "text": F.when(F.size("hits") > 0, F.col("text"))})
    kept = hold(kept, "pii-scan")
    spans = _placed(kept.filter(F.size("hits") > 0).select("row", "same", F.explode("hits").alias("h")).select("row", "same", "h.*"))
    spans = spans.filter(_passes(F.col("kind"), F.col("value")))
    norm = F.when(F.col("kind") == 0, lower_ascii(F.col("value"))).when(F.col("kind") == 1, F.col("value")).otherwise(F.regexp_replace("value", "[^0-9]", ""))
    entity = F.concat_ws(":", F.col("kind").cast("string"), norm)
    return kept.drop("hits", "same"), hold(spans.select("row", "kind", "start", "end", entity.alias("entity"), "left", "right", "same"), "pii-spans")


def _context_terms(around: int, least_chars: int) -> Column:
    """The terms around an entity, without other entities' parts and words that the cut may have split."""
    left = F.when(F.length("left") >= around, F.regexp_replace("left", f"^{_TERM_CHARS}+", "")).otherwise(F.col("left"))
    right = F.when(F.length("right") >= around, F.regexp_replace("right", f"{_TERM_CHARS}+$", "")).otherwise(F.col("right"))
    text = F.concat(left, F.lit("\n"), right)
    for pattern in PATTERNS.values():
        text = F.regexp_replace(text, pattern, "\n")
    return F.array_distinct(F.filter(F.regexp_extract_all(lower_ascii(text), F.lit(f"{_TERM_CHARS}+"), F.lit(0)), lambda t: F.length(t) >= least_chars))


def disclosure(docs: DataFrame, text_col: str, pairs: DataFrame, mentions: DataFrame, n_docs: int, least: int, support: int) -> DataFrame:
    """(entity, term, ratio): pointwise mutual information of each pair over the entity's own information content.

    Frequencies are counts of documents: with the entity, with the term anywhere, with the term around
    the entity. Pairs need ``support`` unlike texts. A ratio of 1 says that the term tells the entity
    for sure. ``pairs``: (row, same, entity, term), distinct; ``mentions``: (row, entity), distinct.
    """
    by_text = pairs.groupBy("entity", "term", "same").agg(F.count("*").alias("n"))
    both = by_text.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts")).filter(F.col("texts") >= support)
    words = F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce(named(text_col), F.lit(""))), F.lit(f"{_TERM_CHARS}{{{least},}}"), F.lit(0)))
    # Every task sums up its own words before anything moves.
    terms = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    entities = mentions.groupBy("entity").agg(F.count("*").alias("n_entity"))
    met = both.join(terms, "term").join(entities, "entity").filter(F.col("n_entity") < n_docs)
    total = F.lit(float(n_docs))
    ratio = F.log2(F.col("n_both") * total / (F.col("n_entity").cast("double") * F.col("n_term"))) / F.log2(total / F.col("n_entity"))
    return met.select("entity", "term", ratio.alias("ratio"))


def find_personal(
    docs: DataFrame, keep: list[str], generalise: float = 0.85, remove: float = 0.95, support: int = 2, around: int = AROUND, least_chars: int = 3, text_col: str = "text"
) -> DataFrame:
    """One row per document: ``keep``, ``base`` and ``terms`` (arrays of spans, sorted), and ``text`` where it has any match.

    Base spans are addresses, IPs, card and phone numbers. Each distinct value is a protected entity;
    a term within ``around`` characters of it discloses it as far as the corpus shows: PMI(entity;
    term) over the entity's information content, both from counts of documents. From ``generalise`` on
    every occurrence of the term in that document becomes a span of kind ``term`` with level 1, from
    ``remove`` on with level 2. A pair needs ``support`` unlike texts, so copies alone prove nothing;
    a document without entities has no spans, and base spans stay as they are.

    Null and empty texts have no spans; very long ones are read whole; repeated rows each get their
    row; an entity in all documents discloses nothing; an empty table gives no rows. Kept columns
    named like a result's are replaced by it.
    """
    keep = others(keep, ("base", "terms", "text"))
    with Scratch(docs.sparkSession) as hold:
        rows, spans = scan(docs, keep, text_col, hold, around)
        mentions = spans.select("row", "entity").distinct()
        pairs = hold(spans.select("row", "same", "entity", F.explode(_context_terms(around, least_chars)).alias("term")).distinct(), "pii-pairs")
        telling = disclosure(docs, text_col, pairs, mentions, rows.count(), least_chars, support).filter(F.col("ratio") >= generalise)
        told = pairs.join(telling, ["entity", "term"]).groupBy("row", "term").agg(F.max("ratio").alias("ratio"))
        told = told.groupBy("row").agg(F.sort_array(F.collect_list("term")).alias("told"), F.collect_list(F.when(F.col("ratio") >= remove, F.col("term"))).alias("gone"))  # of one text
        pattern = F.concat(F.lit(f"(?<!{_TERM_CHARS})(?:"), F.array_join("told", "|"), F.lit(f")(?!{_TERM_CHARS})"))
        told = rows.filter("text is not null").join(told, "row").select("row", "gone", lower_ascii(F.col("text")).alias("text"), pattern.alias("pattern"))
        cut = told.withColumns(_matches("text", F.lit(len(PATTERNS)), F.col("pattern"), F.lit(True))).withColumn("hits", _hits(0))
        terms = _placed(cut.select("row", "gone", F.explode("hits").alias("h")).select("row", "gone", "h.*"))
        terms = terms.select("row", "kind", "start", "end", F.when(F.array_contains("gone", F.col("value")), 2).otherwise(1).alias("level"))
        every = spans.select("row", "kind", "start", "end", F.lit(0).alias("level")).union(terms)
        # Of one text. Sorted by kind and start.
        span, is_base = F.struct("kind", "start", "end"), F.col("kind") < len(PATTERNS)
        each = every.groupBy("row").agg(
            F.sort_array(F.collect_list(F.when(is_base, span))).alias("base"), F.sort_array(F.collect_list(F.when(~is_base, F.struct("kind", "start", "end", "level")))).alias("terms")
        )
        each = each.withColumn("terms", F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))
        out = rows.join(each, "row", "left").select(
            *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
            F.coalesce("base", F.array().cast(_SPAN)).alias("base"),
            F.coalesce("terms", F.array().cast("array<struct<kind:int,start:int,end:int,level:int>>")).alias("terms"),
            "text",
        )
        return materialize(out, "pii")


def listed(spans: Column) -> Column:
    """kind:start:end in the order of the spans, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, text_col: str = "text", **settings: float) -> DataFrame:
    """``docs`` with base spans replaced by their kind, disclosing terms by ``<word>`` or ``<number>``, or removed.

    Settings as in :func:`find_personal`. Spans that overlap are replaced as one, by the first one's
    mark. Nulls stay null, texts without spans stay as they are; all other columns come back as they
    are, whatever their names.
    """
    keep = list(docs.columns)
    inner = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)])
    at = keep.index(next(c for c in keep if c.lower() == text_col.lower()))
    found = find_personal(inner, list(inner.columns), text_col=f"c{at}", **settings)
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS[:-1]])
    text = F.col("text")
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(marks, s["kind"]).alias("mark")))
    worded = lambda s: F.when(s["level"] == 2, "").when(F.substring(text, s["start"] + 1, s["end"] - s["start"]).rlike("^[0-9]+$"), "<number>").otherwise("<word>")
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), worded(s).alias("mark")))
    joined = F.array_sort(F.concat(base, terms))
    # Spans in order; one that begins inside what is covered already only makes it longer.
    covered = F.aggregate(
        joined,
        F.array().cast("array<struct<start:int,end:int,mark:string>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1)["end"], F.lit(-1)) > s["start"]),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"), F.element_at(acc, -1)["mark"].alias("mark"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    found = found.withColumn("_cover", F.when(F.size("base") + F.size("terms") > 0, covered))
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(F.col("_cover"), i - 1)["end"])
    pieces = F.transform("_cover", lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), s["mark"]))
    rest = F.element_at("_cover", -1)["end"]
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, rest + 1, F.length(text)))
    return found.select(*[(F.when(F.col("_cover").isNull(), F.col(f"c{i}")).otherwise(clean) if i == at else F.col(f"c{i}")).alias(c) for i, c in enumerate(keep)])


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; see :func:`find_personal`. ``n_general`` and ``n_removed`` count the spans of disclosing terms."""
    found = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    level = lambda n: F.size(F.filter("terms", lambda s: s["level"] == n)).cast("long")
    plain = F.transform("terms", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:-1])],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", plain)).alias("spans"),
        level(1).alias("n_general"),
        level(2).alias("n_removed"),
    )
