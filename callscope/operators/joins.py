"""Joins by place, time, nearness and reach."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import fixed
from callscope.operators.components import components
from callscope.operators.ordered import Running, range_placed, run_on
from callscope.operators.tables import Scratch, dealt, materialize


def as_of(uses: DataFrame, assigns: DataFrame, by: list[str], at: str = "at", use_key: str = "use_id") -> DataFrame:
    """Each use with the last assignment before it, else the first one after, else nulls.

    ``uses``: by, ``at``, the key. ``assigns``: by, ``at``, ``value``; of several at one place the
    greatest value counts. Both lie in one line of range partitions, and what the partitions before
    one hold of its first name is carried on, so a name with most of the rows is no single task. A use
    that nothing comes before gets its name's first assignment.
    """
    u = uses.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_use"), F.lit(None).cast(assigns.schema["value"].dataType).alias("_value"), F.col(use_key))
    a = assigns.select(*by, F.col(at).alias("_at"), F.lit(0).alias("_use"), F.col("value").alias("_value"), F.lit(None).cast(uses.schema[use_key].dataType).alias(use_key))
    entry = F.struct(F.col("_at").alias("at"), F.col("_value").alias("value"))
    with Scratch(uses.sparkSession) as hold:
        # At one place an assignment follows the use: it is not before it.
        line = range_placed(u.unionByName(a), [*[F.col(c) for c in by], F.col("_at"), -F.col("_use"), F.col("_value"), F.col(use_key)], "as-of", hold)
        met = run_on(line, len(by), {"_last": Running(F.when(F.col("_use") == 0, entry), "last")}).filter("_use = 1").select(use_key, *by, "_at", "_last")
        first = a.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.min(entry).alias("_first"))
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        met = met.join(first, reduce(lambda x, y: x & y, same), "left").withColumn("_met", F.coalesce("_last", "_first"))
        return materialize(met.select(use_key, *by, F.col("_at").alias(at), F.col("_met.value").alias("value"), F.col("_met.at").alias("assigned_at")), "as-of")


def longest_prefix(names: DataFrame, roots: DataFrame, name: str = "name", separator: str = ".") -> DataFrame:
    """Each dotted name with its best package root: own and declared ones before longer ones.

    ``roots``: (root, package, declared, own). Names are exploded into their prefixes for an equi-join.
    """
    parts = F.split(F.col(name), f"\\{separator}")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
    met = names.select(name).distinct().select(name, F.explode(prefixes).alias("root")).join(roots, "root")
    rank = F.length("root") + F.when(F.col("declared"), 1000).otherwise(0) + F.when(F.col("own"), 1000).otherwise(0)
    best = met.groupBy(name).agg(F.max_by("package", F.struct(rank, "package")).alias("package"))
    return names.join(best, name, "left")


def nearest_up(items: DataFrame, settings: DataFrame, path: str = "path", key: str = "key") -> DataFrame:
    """Each item with the value of its key in the nearest directory at or above its file.

    ``settings``: (dir, key, value); the root is the empty string.
    """
    parts = F.split(F.col(path), "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    asked = items.select(path, key).distinct().select(path, key, F.explode(dirs).alias("dir"))
    best = asked.join(settings, ["dir", key]).groupBy(path, key).agg(F.max_by(F.struct("value", "dir"), F.length("dir")).alias("_b"))
    return items.join(best.select(path, key, "_b.value", "_b.dir"), [path, key], "left")


def match_inventory(entries: DataFrame, calls: DataFrame, tolerance: int = 3) -> DataFrame:
    """Pair entries and calls of a file that are at most ``tolerance`` lines apart, each used once.

    Nearest pairs first, calls through no wrapper before others, then by entry: a greedy choice, so
    each file's near pairs are settled in one Python group; their number is bounded by the file's
    entries and the lines around them. Lines meet in bands as wide as the tolerance, by equi-join. ``entries``: (entry, repo, file, line). ``calls``: (call, repo, file, line, via).
    """
    width = max(1, tolerance)
    band = F.floor(F.col("line") / width)
    e = entries.withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    c = calls.withColumn("_band", band).withColumnRenamed("line", "call_line")
    pairs = e.join(c, ["repo", "file", "_band"]).withColumn("distance", F.abs(F.col("line") - F.col("call_line"))).filter(F.col("distance") <= tolerance)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, used, out = set(), set(), []
        for row in pdf.sort_values(["distance", "via", "entry", "call"]).itertuples():
            if row.entry in taken or row.call in used:
                continue
            taken.add(row.entry)
            used.add(row.call)
            out.append((row.entry, row.call, row.distance))
        return pd.DataFrame(out, columns=["entry", "call", "distance"])

    met = pairs.select("repo", "file", "entry", "call", "via", "distance").groupBy("repo", "file").applyInPandas(settle, "entry long, call long, distance int")
    return entries.join(met, "entry", "left")


def changed_scope(files: DataFrame, imports: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed files and those that import one directly. ``imports``: (path, target)."""
    importers = imports.join(changed.withColumnRenamed("path", "target"), "target", "left_semi").select("path")
    return files.join(changed.select("path").union(importers).distinct(), "path", "left_semi")


def unexplained_hosts(named: DataFrame, calls: DataFrame) -> DataFrame:
    """Hosts that no call's host explains, exactly or by a template. ``named``: (host); ``calls``: (host).

    Templates are keyed by the domain behind their last placeholder, so the pattern test runs on
    hosts under that domain only.
    """
    low = F.lower(F.regexp_replace("host", r":[^:{}]*\z", ""))
    seen = calls.filter("host is not null").select(low.alias("t")).distinct()
    left = named.join(seen.filter(~F.col("t").contains("{")).withColumnRenamed("t", "host"), "host", "left_anti")
    tail = F.regexp_extract("t", r"\}([^}]*)\z", 1)
    domain = F.regexp_extract(tail, fixed.TAIL_DOMAIN, 1)
    templates = seen.filter(F.col("t").contains("{") & (domain != "")).select(domain.alias("domain"), "t")
    # What is written out is matched as it is, between the placeholders.
    parts = F.transform(F.split("t", r"\{[^}]*\}", -1), lambda x: F.when(x == "", x).otherwise(F.concat(F.lit("\\Q"), x, F.lit("\\E"))))
    pattern = F.concat(F.lit("^"), F.array_join(parts, fixed.SOME_LABELS), F.lit(r"\z"))
    keyed = left.withColumn("domain", F.substring_index("host", ".", -2))
    explained = keyed.join(templates.withColumn("pattern", pattern), "domain").filter(F.expr("host rlike pattern")).select("host").distinct()
    return left.join(explained, "host", "left_anti")


def sdk_coverage(known: DataFrame, declared: DataFrame, sites: DataFrame, calls: DataFrame) -> DataFrame:
    """Status of each known package that is declared or imported. ``known``: (package, provider, supported)."""
    d = declared.select("package").distinct().withColumn("declared", F.lit(True))
    s = sites.groupBy("package").agg(F.count_distinct("file").alias("import_sites"))
    c = calls.groupBy("package").agg(F.count("*").alias("calls"))
    rows = d.join(s, "package", "full").join(known, "package").join(c, "package", "left")
    imported, n = F.col("import_sites").isNotNull(), F.coalesce("calls", F.lit(0))
    status = F.when(~imported, "declared-not-imported").when(~F.col("supported"), "unsupported").when(n > 0, "ok").otherwise("imported-no-calls")
    return rows.select("package", "provider", F.coalesce("declared", F.lit(False)).alias("declared"), imported.alias("imported"), F.coalesce("import_sites", F.lit(0)).alias("import_sites"), n.alias("calls"), status.alias("status"))


def expand_wrappers(calls: DataFrame, inner: DataFrame, hops: int = 4, keep: int = 3) -> DataFrame:
    """Requests that wrapper calls reach. ``calls``: (call, fn); ``inner``: (fn, ord, target, request), a function's own calls.

    A call of a function reaches the function's requests, and through its inner calls those of
    others, up to ``hops`` away; each level takes its first ``keep`` inner calls. What a function
    reaches does not hang on the call, and no shortest way enters a function twice, so it is settled
    backwards from the requests, with one join for each hop over functions alone; the calls meet it
    once. A function that most others call is one function there. The joins are merges: as Parquet
    these tables are so small that Spark would broadcast millions of rows to every task.
    """
    first = inner.withColumn("_k", F.row_number().over(Window.partitionBy("fn").orderBy("ord"))).filter(F.col("_k") <= keep)
    with Scratch(inner.sparkSession) as hold:
        first = hold(first.select("fn", "target", "request"), "wrappers-first")
        own = first.filter("request is not null").select("fn", "request", F.lit(1).alias("hops"))
        through = first.filter("target <> fn").select("fn", "target")
        reach = own
        for _ in range(hops - 1):
            further = through.join(reach.withColumnRenamed("fn", "target").hint("merge"), "target").select("fn", "request", (F.col("hops") + 1).alias("hops"))
            reach = dealt(own.union(further), "fn", "request").groupBy("fn", "request").agg(F.min("hops").alias("hops"))
        reach = materialize(reach, "wrappers")
    met = calls.select("call", "fn").join(reach.hint("merge"), "fn").select("call", "request", "hops")
    return dealt(met, "call", "request").groupBy("call", "request").agg(F.min("hops").alias("hops"))


def file_groups(edges: DataFrame) -> DataFrame:
    """(file, group): files that see each other over imports, by the least file of the group. ``edges``: (src, dst); loops make a group of one."""
    groups = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), loops=True)
    return groups.select(F.col("node").alias("file"), F.col("root").alias("group"))
