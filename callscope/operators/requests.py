"""Requests of a call site: ids, numbering, fan-out and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.operators.ordered import numbered, range_placed
from callscope.operators.tables import dealt


def call_id(place: Column, n: Column, name: Column) -> Column:
    """First 12 hex digits of the SHA-1 of ``file:line:col``, ``#n`` unless n is 0, and the operation's name."""
    number = F.when(n > 0, F.concat(F.lit("#"), n.cast("string"))).otherwise("")
    named = F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(" "), name)).otherwise("")
    return F.substring(F.sha1(F.concat(place, number, named)), 1, 12)


def one_per_request(calls: DataFrame) -> DataFrame:
    """Drop repeats and number the rest: (seq, place, id, op, name, sent) -> the kept rows with ``n`` and the new ``id``.

    A named operation is numbered among equal ids, any other among all distinct requests of its
    place. Windows run inside a place, whose rows are those of one call site.
    """
    first = calls.withColumn("_rn", F.row_number().over(Window.partitionBy("place", "id", "op", "sent").orderBy("seq"))).filter("_rn = 1").drop("_rn")
    first = first.withColumn("_first", F.min("seq").over(Window.partitionBy("place", "sent")))
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    n = F.when(named, F.row_number().over(Window.partitionBy("place", "id", named).orderBy("seq")) - 1).otherwise(F.dense_rank().over(Window.partitionBy("place").orderBy("_first")) - 1)
    numbered = first.withColumn("n", n.cast("long")).drop("_first")
    return numbered.withColumn("id", F.when(F.col("n") == 0, F.col("id")).otherwise(call_id(F.col("place"), F.col("n"), F.col("name"))))


def candidates(calls: DataFrame, limit: int = 20) -> DataFrame:
    """Fan out over a host table: one row for each host of a raw call that has two or more; over ``limit`` only the first, marked.

    ``calls``: (raw_id, ord, host). Rows of one host are one, the first.
    """
    hosts = calls.groupBy("raw_id", "host").agg(F.min("ord").alias("ord"))
    by_raw = Window.partitionBy("raw_id")
    ranked = dealt(hosts, "raw_id").withColumns({"hosts": F.count("*").over(by_raw), "k": F.row_number().over(by_raw.orderBy("ord"))})
    return ranked.filter((F.col("hosts") <= limit) | (F.col("k") == 1)).select("raw_id", "host", "ord", ((F.col("hosts") >= 2) & (F.col("hosts") <= limit)).alias("candidate"), (F.col("hosts") > limit).alias("limited"))


def merge_models(calls: DataFrame) -> DataFrame:
    """Calls that differ by their model only as one, at the first one's place, with every model in the order of the calls.

    ``calls``: (ord, request, model); calls without a model add none.
    """
    first = calls.filter("model is not null").groupBy("request", "model").agg(F.min("ord").alias("ord"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "model"))), lambda x: x["model"])  # of one request
    models = first.groupBy("request").agg(listed.alias("models"))
    return calls.groupBy("request").agg(F.min("ord").alias("ord")).join(models, "request", "left").select("ord", "request", F.coalesce("models", F.array().cast("array<string>")).alias("models"))


def diverse(expansions: DataFrame, keep: int = 3) -> DataFrame:
    """The first ``keep`` inner calls of a wrapper, repeats of a path behind other paths. ``expansions``: (call_id, ord, path); ties in ord go by path."""
    again = F.row_number().over(Window.partitionBy("call_id", "path").orderBy("ord"))
    ranked = expansions.withColumn("again", again)
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("again", "ord", "path"))
    return ranked.withColumn("rank", place).filter(F.col("rank") <= keep).drop("again")


def call_order() -> list[Column]:
    """By file as a person sorts, then line, column and sequence."""
    return [F.collate("file", "UNICODE"), F.col("line"), F.col("col"), F.col("seq")]


def with_place(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Number the rows in an order from 1 in ``place``, gapless; equal rows in any order.

    The rows are written in range partitions once, so that sizes and rows are those of the same parts
    whatever a later plan reads of them; one row for each part is summed up front.
    """
    return numbered(range_placed(rows, order, "places"))
