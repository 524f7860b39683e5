"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixing, shards.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as
Parquet before the next one reads it. Stages take nulls in any column, empty and very long texts,
repeated rows and ids, ids of any type, empty tables and columns of any name; what they do with them
stands with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callscope.llm.common import Scratch, materialize
from callscope.llm.decontaminate import drop_leaks
from callscope.llm.mixing import sample_mix
from callscope.llm.quality import keep_good
from callscope.llm.shards import shard_rows
from callscope.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade (good and not toxic) is a half or more.

    Null and empty texts are judged by the features of emptiness, repeated rows alike, long texts
    whole. Without labels nothing is known against any row and all stay.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints within four bits or equal keys of least hashes, then shingles of five words with a similarity of 0.8 or more.

    The one of the smallest id stays, nulls last, ties by text hash. Null, empty and wordless texts are
    one group; of repeated rows one stays; rows of one id, or of none, with unlike texts are different
    documents; long texts are compared whole.
    """
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, to a tenth of its bytes in edits.

    Null and empty texts and items hold and match nothing; repeated rows go or stay together; long
    texts are searched whole; an empty benchmark leaves all.
    """
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times.

    A null source is a source of its own; texts without words have no size and go with their source's
    whole epochs; repeated rows, and ids whose text is the same, are taken alike.
    """
    return sample_mix(docs, keep_rows=True)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, and each row's shard and slot; columns of these names are replaced.

    Null ids come first, null and empty texts have size 1, repeated rows get neighbouring slots.
    """
    return shard_rows(docs, 8)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The classifier and the hashing stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted once the next one is written, but for the last one's input, which the result may read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as keep:
        before = None
        for name, stage in STAGES[:-2]:
            docs, old = keep(stage(spark, docs, sf_dir), f"pipeline-{name}"), before
            if old is not None:
                keep.drop(old)
            before = docs
        docs = materialize(STAGES[-2][1](spark, docs, sf_dir), f"pipeline-{STAGES[-2][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
