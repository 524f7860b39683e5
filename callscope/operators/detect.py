"""Calls against dimensions, and values that several places agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sdk_methods(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """Each call with its registry entry: an exact key, else the earliest pattern (``*`` one segment, ``**`` any).

    Exact keys are an equi-join; patterns are joined on the root, whose entries they are, and tested there.
    """
    exact = registry.filter(~F.col("pattern").contains("*"))
    wild = registry.filter(F.col("pattern").contains("*"))
    regex = F.concat(F.lit("^"), F.replace(F.replace(F.replace(F.regexp_replace("pattern", r"\.", r"\\."), F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit(r"[^.]+")), F.lit("\x01"), F.lit(".+")), F.lit(r"\z"))
    by_key = calls.join(exact.withColumnRenamed("pattern", "segs"), ["root", "segs"]).select("call", "method", "path", F.lit(0).alias("wild"), "ord")
    by_pattern = calls.join(wild.withColumn("regex", regex), "root").filter(F.expr("segs rlike regex")).select("call", "method", "path", F.lit(1).alias("wild"), "ord")
    best = by_key.union(by_pattern).groupBy("call").agg(F.min_by(F.struct("method", "path"), F.struct("wild", "ord")).alias("b"))
    return best.select("call", "b.*")


def agreed(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The value of each key whose rows all have the same one."""
    out = rows.groupBy(by).agg(F.min(value).alias(value), F.max(value).alias("_other"))
    return out.filter(F.col(value) == F.col("_other")).drop("_other")


def class_members(bases: DataFrame, fields: DataFrame, depth: int = 10) -> DataFrame:
    """(cls, name, value): members of a class, its own before its bases', nearer bases before farther, earlier before later.

    One join for each level; a class is met once on a path, so cycles end.
    """
    own = bases.select("cls").union(fields.select("cls")).distinct()
    now = own.select("cls", F.col("cls").alias("at"), F.lit(0).alias("depth"), F.lit("").alias("rank"), F.array("cls").alias("path"))
    reach = now.select("cls", "at", "depth", "rank")
    up = bases.filter("base is not null").select(F.col("cls").alias("at"), "ord", "base")
    for level in range(1, depth + 1):
        now = now.join(up, "at").filter("not array_contains(path, base)").select("cls", F.col("base").alias("at"), F.lit(level).alias("depth"), F.concat("rank", F.format_string("%03d", "ord")).alias("rank"), F.concat("path", F.array("base")).alias("path"))
        reach = reach.union(now.select("cls", "at", "depth", "rank"))
        if level < depth and now.limit(1).count() == 0:
            break
    met = reach.join(fields.withColumnRenamed("cls", "at"), "at")
    return met.groupBy("cls", "name").agg(F.min_by("value", F.struct("depth", "rank")).alias("value"))


def body_encoding(role: Column, serializer: Column, content_type: Column) -> Column:
    """Encoding of a body, by the option it is given in, what makes it a string, and the content type."""
    kind = F.lower(content_type)
    return (
        F.when(role.isNull(), "none")
        .when(role == "json", "json")
        .when(role.isin("form", "formData"), "form")
        .when(role.isin("files", "multipart"), "multipart")
        .when(serializer.isin("JSON.stringify", "json.dumps", "json_encode"), "json")
        .when(serializer.isin("URLSearchParams", "urlencode", "http_build_query", "qs.stringify"), "form")
        .when(serializer == "FormData", "multipart")
        .when(kind.rlike(r"^\s*application/(?:[\w.-]+\+)?json\b"), "json")
        .when(kind.rlike(r"^\s*application/x-www-form-urlencoded\b"), "form")
        .when(kind.rlike(r"^\s*multipart/"), "multipart")
        .when(kind.rlike(r"^\s*(?:text|application)/(?:[\w.-]+\+)?xml\b"), "xml")
        .otherwise("raw")
    )
