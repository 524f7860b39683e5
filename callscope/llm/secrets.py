"""Secret scans judged by how many repositories and owners share a candidate."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.common import Scratch, materialize, named, others, small_batches

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the short ones need not be matched and dropped
#: Kinds in the order in which spans at one start are listed.
KINDS = ["assign", "access", "hex", "owned"]
#: What the method weighs beyond the base kinds: credentials by their issuers' public formats, key blocks, and mixed long runs.
_MORE = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{36,}"
    r"|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{10,}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"
)
_MIXED = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]")]


def _entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) of the base kinds, by start and then kind."""
    found = [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def more_spans(text: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Candidates outside the base spans; a plain long run must mix cases and digits and look random."""
    covered = [(a, b) for _, a, b, _ in taken]
    out = []
    for m in _MORE.finditer(text):
        value = m[0]
        known = re.match(r"gh[pousr]_|[srp]k_|xox|AIza|eyJ|-----", value)
        if not known and not (all(p.search(value) for p in _MIXED) and _entropy(value) >= 3.5):
            continue
        if not any(a < m.end() and m.start() < b for a, b in covered):
            out.append(("owned", m.start(), m.end(), value))
    return out



_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())])
_SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint,hash:string>>"


def candidates(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, ``base`` and ``more``: arrays of (kind, start, end, hash); offsets are code points, ``hash`` the secret's SHA-256. No secret leaves the scan."""
    small_batches(docs.sparkSession)
    source = docs.select(*[named(c) for c in keep], named(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(s: tuple[str, int, int, str]) -> dict:
            return {"kind": s[0], "start": s[1], "end": s[2], "hash": hashlib.sha256(s[3].encode()).hexdigest()}

        for batch in batches:
            base, more = [], []
            for text in batch.column(len(keep)):
                value = text.as_py() or ""
                found = base_spans(value)
                base.append([row(s) for s in found])
                more.append([row(s) for s in more_spans(value, found)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(base, pa.list_(_SPAN)), pa.array(more, pa.list_(_SPAN))], names=[*keep, "base", "more"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return source.mapInArrow(run, f"{fields}base {_SPAN_SQL}, more {_SPAN_SQL}")


def ownership(spans: DataFrame, repository: str, owner: str) -> DataFrame:
    """(hash, n_repositories, n_owners). Distinct pairs are taken before anything is counted, so a value copied into a third of all rows is a few rows by then."""
    repos = spans.select("hash", F.col(repository).alias("r")).distinct().groupBy("hash").agg(F.count("*").alias("n_repositories"))
    owners = spans.select("hash", F.col(owner).alias("o")).distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    return repos.join(owners, "hash")


def scan_secrets(docs: DataFrame, keep: list[str], repository: str, owner: str, max_owners: int = 1, max_repositories: int = 10, text_col: str = "text") -> DataFrame:
    """One row per document: ``keep``, ``base`` spans, ``owned`` spans, and ``n_live`` and ``n_copied`` of all candidates.

    A candidate is any span of a base kind (assignments, access keys, hex runs) or of the method's
    own patterns. Its hash is counted over the whole table by distinct ``repository`` and ``owner``
    (nulls are one repository and one owner). It looks live if at most ``max_owners`` owners hold it,
    in at most ``max_repositories`` repositories; a value that more owners share, or that one owner
    has all over, is a copied example. Base spans are always reported; the method's own are added
    (as kind ``owned``) only where they look live. Null and empty texts have no spans, very long ones
    are scanned whole; repeated rows each get their row and are one repository; an empty table gives
    no rows. Kept columns named like a result's are replaced by it.
    """
    keep = others(keep, ("base", "owned", "n_live", "n_copied"))
    spare = [f"_k{i}" for i in range(len(keep))]
    own = docs.select(*[named(c).alias(s) for c, s in zip(keep, spare, strict=True)], named(repository).alias("_repo"), named(owner).alias("_owner"), named(text_col).alias("_text"))
    with Scratch(docs.sparkSession) as hold:
        scanned = materialize(candidates(own, [*spare, "_repo", "_owner"], "_text").withColumn("_row", F.monotonically_increasing_id()), "secrets-scan")
        spans = scanned.select("_row", "_repo", "_owner", F.explode(F.concat("base", "more")).alias("s")).select("_row", "_repo", "_owner", "s.*")
        counts = hold(ownership(spans, "_repo", "_owner"), "secrets-counts")
        live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
        judged = spans.select("_row", "kind", "start", "end", "hash").join(counts, "hash").withColumn("live", live)
        span = F.struct("kind", "start", "end")
        each = judged.groupBy("_row").agg(
            F.collect_list(F.when((F.col("kind") == "owned") & F.col("live"), span)).alias("owned"),  # of one text
            F.count(F.when(F.col("live"), 1)).alias("n_live"),
            F.count(F.when(~F.col("live"), 1)).alias("n_copied"),
        )
        each = materialize(each, "secrets-judged")
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return scanned.join(each, "_row", "left").select(
        *[F.col(s).alias(c) for c, s in zip(keep, spare, strict=True)], F.col("base"), F.coalesce("owned", empty).alias("owned"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied")
    )


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is its own repository here, its source the owner."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    found = scan_secrets(docs, ["doc_id"], "doc_id", "source")
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(plain), 256).alias("base_sha256"),
        listed(F.concat(plain, "owned")).alias("spans"),
        "n_live",
        "n_copied",
    )
