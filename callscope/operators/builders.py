"""Maps that are built step by step: what a key holds where the map is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators.ordered import Running, range_placed, run_on
from callscope.operators.tables import Scratch, materialize

#: What a step does: set a key, delete one, start anew, or something unreadable, after which no older key is known.
OPS = ("set", "delete", "clear", "unknown")


def read_maps(steps: DataFrame, reads: DataFrame) -> DataFrame:
    """(read, state, value, set_at): for each read of a key whether the map then has it: set, absent or unknown.

    ``steps``: (builder, at, op, key, value), places distinct within a builder; ``reads``: (read,
    builder, at, key), before a step at the same place. A map after some steps is, for each key, its
    last set or delete, and for all keys the last clear or unknown step; two such maps of neighbouring
    stretches merge into one, the later winning. So steps and reads lie in range partitions, each
    merges its own, and what the ones before leave of a builder, or of a builder's key, is carried over
    their ends: a builder or a key with any share of the rows is never one task. A key that nothing
    speaks of is absent, or unknown behind an unknown step. Null keys of steps are unreadable: the
    whole map is unknown from there.
    """
    op = F.when(F.col("op").isin("set", "delete") & F.col("key").isNull(), "unknown").otherwise(F.col("op"))
    none = F.lit(None)
    line = steps.select("builder", F.col("at").cast("long").alias("at"), F.lit(1).alias("turn"), op.alias("op"), "key", "value", none.cast(reads.schema["read"].dataType).alias("read")).union(
        reads.select("builder", F.col("at").cast("long").alias("at"), F.lit(0).alias("turn"), none.cast("string").alias("op"), "key", none.cast(steps.schema["value"].dataType).alias("value"), "read")
    )
    with Scratch(steps.sparkSession) as hold:
        place = F.struct("at", "op")
        along = range_placed(line, [F.col("builder"), F.col("at"), F.col("turn"), F.col("read")], "built", hold)
        whole = run_on(along, 1, {"all_keys": Running(F.when(F.col("op").isin("clear", "unknown"), place), "last")}).select(*line.columns, "all_keys")
        keyed = whole.filter("read is not null or op in ('set', 'delete')")
        by_key = range_placed(keyed, [F.col("builder"), F.col("key"), F.col("at"), F.col("turn"), F.col("read")], "built-keys", hold)
        entry = F.when(F.col("op").isNotNull(), F.struct("at", "op", "value"))
        met = run_on(by_key, 2, {"entry": Running(entry, "last")}).filter("read is not null")
        fresh = F.col("entry").isNotNull() & (F.col("all_keys").isNull() | (F.col("entry.at") > F.col("all_keys.at")))
        state = F.when(fresh, F.when(F.col("entry.op") == "set", "set").otherwise("absent")).otherwise(F.when(F.col("all_keys.op") == "unknown", "unknown").otherwise("absent"))
        return materialize(met.select("read", state.alias("state"), F.when(fresh & (F.col("entry.op") == "set"), F.col("entry.value")).alias("value"), F.when(fresh, F.col("entry.at")).alias("set_at")), "maps-read")


def final_entries(steps: DataFrame) -> DataFrame:
    """(builder, key, value, complete): what each builder holds after all its steps; incomplete behind an unknown step. Aggregates by key and by builder alone."""
    op = F.when(F.col("op").isin("set", "delete") & F.col("key").isNull(), "unknown").otherwise(F.col("op"))
    rows = steps.withColumn("op", op)
    last = rows.filter("op in ('clear', 'unknown')").groupBy("builder").agg(F.max("at").alias("_from"), F.max_by("op", "at").alias("_by"))
    entries = rows.filter("op in ('set', 'delete')").groupBy("builder", "key").agg(F.max_by(F.struct("at", "op", "value"), "at").alias("_e"))
    met = entries.join(last, "builder", "left").filter("_e.op = 'set' and (_from is null or _e.at > _from)")
    return met.select("builder", "key", F.col("_e.value").alias("value"), F.coalesce(F.col("_by") != "unknown", F.lit(True)).alias("complete"))
