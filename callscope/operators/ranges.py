"""Which ranges a place lies in, by equi-joins on bins as long as the ranges, and what edits inside branches leave of a dict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.operators.tables import Scratch, materialize

#: Offsets lie below 2 to this power.
BITS = 40


def _level(x: Column) -> Column:
    """Log of the largest power of two that divides x; BITS for 0."""
    low = x.bitwiseAND(-x)
    return F.when(x == 0, F.lit(BITS)).otherwise(F.length(F.bin(low)) - 1)


def blocks(start: Column, end: Column) -> Column:
    """The least set of aligned blocks (level, block) that cover start to end, both included: two for each level at most."""
    stop = end + 1

    def grow(acc: Column, _: Column) -> Column:
        at = acc["at"]
        # The largest aligned block that begins here and does not pass the end.
        fits = F.least(_level(at), F.length(F.bin(stop - at)) - 1)
        block = F.struct(fits.cast("int").alias("level"), F.call_function("shiftright", at, fits.cast("int")).alias("block"))
        more = F.struct((at + F.call_function("shiftleft", F.lit(1).cast("long"), fits.cast("int"))).alias("at"), F.concat(acc["out"], F.array(block)).alias("out"))
        return F.when(at < stop, more).otherwise(acc)

    none = F.array().cast("array<struct<level:int,block:bigint>>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * BITS)), F.struct(start.cast("long").alias("at"), none.alias("out")), grow, lambda a: a["out"])


#: Ranges of one class are up to 2 to this power times as long as its shortest.
STEP = 6


def _binned(ranges: DataFrame, by: list[str]) -> tuple[DataFrame, list[int]]:
    """Ranges under the bins that they lie in (``level``, ``bin``), two at most, and the levels in use: a bin of a level is as long as the longest range of its class."""
    cut = ranges.filter(F.col("start").between(0, F.col("end"))).withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})
    bits = F.length(F.bin(F.col("end") - F.col("start")))  # a range is at most 2 to this power long
    cut = cut.withColumn("level", (F.ceil(bits / STEP) * STEP).cast("int"))
    levels = sorted(r.level for r in cut.select("level").distinct().collect())  # BITS / STEP + 1 numbers at most
    first, last = (F.call_function("shiftright", F.col(c), F.col("level")) for c in ("start", "end"))
    return cut.withColumn("bin", F.explode(F.sequence(first, last))), levels


def _asked(points: DataFrame, levels: list[int]) -> DataFrame:
    """Each point in its one bin of each level."""
    rows = points.withColumn("level", F.explode(F.array([F.lit(x) for x in levels]).cast("array<int>")) if len(levels) != 1 else F.lit(levels[0]))
    return rows.withColumn("bin", F.call_function("shiftright", F.col("at").cast("long"), F.col("level")))


def stabbed(points: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Each point (``by``, point, at) with each range (``by``, range, start, end) of its group that holds it, ends included.

    Ranges are classed by length. A range lies in two of its class's bins at most and a point in one
    bin of each class that some range is in, so points meet ranges by equal keys alone, and the lengths
    64 times apart are few. A pair meets once, as a point has one bin of the range's class. Ranges that
    end before they start, or begin below 0, hold nothing.
    """
    cut, levels = _binned(ranges.select(*by, "range", "start", "end"), by)
    met = _asked(points.select(*by, "point", F.col("at").cast("long").alias("at")), levels).join(cut, [*by, "level", "bin"])
    return met.filter(F.col("at").between(F.col("start"), F.col("end"))).select(*by, "point", "at", "range", "start", "end")


def _held(points: DataFrame, ranges: DataFrame, by: list[str], merged: dict[str, Column], counted: str) -> DataFrame:
    """Points, each once, with maxima (``merged``) and the number (``counted``) of the ranges that hold it. Points of one bin are where their ranges are, so with one class of lengths nothing moves after the join."""
    cut, levels = _binned(ranges, by)
    cut = cut.withColumns({f"_x_{n}": c for n, c in merged.items()}).select(*by, "level", "bin", "start", "end", *[f"_x_{n}" for n in merged])
    cut = cut.select(*[F.col(c).alias(f"_{c}") for c in cut.columns])
    asked = _asked(points, levels or [0])
    same = [F.col(c) == F.col(f"_{c}") for c in (*by, "level", "bin")]
    met = asked.join(cut, reduce(lambda x, y: x & y, same) & F.col("at").between(F.col("_start"), F.col("_end")), "left")
    held = met.groupBy(*points.columns, "level", "bin").agg(*[F.max(f"__x_{n}").alias(n) for n in merged], F.count("_bin").alias(counted))
    if len(levels) > 1:
        return held.groupBy(*points.columns).agg(*[F.max(n).alias(n) for n in merged], F.sum(counted).alias(counted))
    return held.drop("level", "bin")


def innermost(points: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Each point with the range that holds it and begins last, the shorter of two and then the lesser, and how many hold it (``depth``); null and 0 where none does. Points are distinct."""
    met = _held(points, ranges, by, {"_in": F.struct("start", (-F.col("end")).alias("end"), "range")}, "depth")
    return met.withColumn("range", F.col("_in.range")).drop("_in").select(*points.columns, "range", "depth")


def reach_of(edits: DataFrame, branches: DataFrame, uses: DataFrame) -> DataFrame:
    """Add ``reach`` (always, group or maybe), ``group_id``, ``branch`` and ``group_size`` to edits.

    ``edits``: (fn, edit, at), distinct; ``branches``: (fn, branch, start, end, group_id, group_size), the group
    null where a block is not part of an exhaustive chain; ``uses``: (fn, use_at), one row each, where
    the edited value is read. Branches that hold the use as well are open: what is in them runs before
    it. An edit in no other branch always runs; in one of an exhaustive chain it is part of a group.
    """
    holds = F.coalesce(F.col("use_at").between(F.col("start"), F.col("end")), F.lit(False))
    shut = branches.join(uses.select("fn", "use_at"), "fn", "left").filter(~holds).drop("use_at")
    met = _held(edits, shut, ["fn"], {c: F.col(c) for c in ("branch", "group_id", "group_size")}, "_n")
    grouped = (F.col("_n") == 1) & F.col("group_id").isNotNull()
    reach = F.when(F.col("_n") == 0, "always").when(grouped, "group").otherwise("maybe")
    return met.withColumns({"reach": reach, **{c: F.when(grouped, F.col(c)) for c in ("branch", "group_id", "group_size")}}).drop("_n")


def edited_entries(edits: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, key, optional, n_values, first_value, last_value): the entries that a dict has after its edits.

    ``edits``: (``by``, key, at, op, value, reach, group_id, branch, group_size); op is set, default or
    remove. The last set or remove that always runs decides what a key was before it; what follows
    only adds: a set that may not run adds an alternative, a default adds one where there is none yet,
    a remove that may not run makes the entry optional. An entry that begins with a set that may not
    run is optional; one that every branch of an exhaustive chain sets, after the last removal, is not.
    Everything is an aggregate by key, so no key's edits are folded one by one in a task; a key whose
    last word is a removal has no row.
    """
    key = [*by, "key"]
    resets = F.col("op").isin("set", "remove") & (F.col("reach") == "always")
    with Scratch(edits.sparkSession) as hold:
        edits = hold(edits, "edits-reached")
        last = edits.filter(resets).groupBy(*key).agg(F.max_by(F.struct("at", "op"), "at").alias("_r")).select(*key, F.col("_r.at").alias("_from"), F.col("_r.op").alias("_op"))
        rows = edits.join(last, key, "left").filter("_from is null or at >= _from").withColumn("_starts", F.coalesce(F.col("_op") == "set", F.lit(False)))
        rows = hold(rows, "edits")
        adds = F.col("op").isin("set", "default")
        first = rows.groupBy(*key).agg(
            F.min(F.when(adds, F.struct("at", "reach"))).alias("_f"),
            F.max(F.when((F.col("op") == "remove") & (F.col("reach") != "always"), F.col("at"))).alias("_gone"),
            F.max(F.when(F.col("op") == "remove", F.col("at"))).alias("_cleared"),
        ).filter("_f is not null")
        rows = hold(rows.join(first, key), "edits-from")
        stands = F.col("op").isin("set") | (adds & (F.col("at") == F.col("_f.at")))
        value = F.when(stands, F.struct("at", "value"))
        after = adds & (F.col("reach") == "group") & (F.col("at") > F.coalesce("_cleared", F.lit(-1)))
        covered = rows.filter(after).groupBy(*key, "group_id").agg(F.count_distinct("branch").alias("_n"), F.max("group_size").alias("_of")).groupBy(*key).agg(F.max(F.col("_n") >= F.col("_of")).alias("_all"))
        out = rows.groupBy(*key).agg(
            F.count(value).alias("n_values"), F.min_by("value", F.when(stands, F.col("at"))).alias("first_value"), F.max_by("value", F.when(stands, F.col("at"))).alias("last_value"),
            F.first("_starts").alias("_starts"), F.first("_f.reach").alias("_reach"), F.first("_f.at").alias("_at"), F.first("_gone").alias("_gone"),
        )
        maybe = (~F.col("_starts") & (F.col("_reach") != "always")) | F.coalesce(F.col("_gone") > F.col("_at"), F.lit(False))
        optional = maybe & ~F.coalesce("_all", F.lit(False))
        return materialize(out.join(covered, key, "left").select(*key, optional.alias("optional"), "n_values", "first_value", "last_value"), "entries")
