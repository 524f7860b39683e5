"""Trees as tables: elements of markup by running depth, shapes of declared types by grafting, facts by the nearest scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.operators.tables import dealt, materialize

#: A tag with its attributes; no part is read twice, however long.
TAG = r"""</?[A-Za-z_][\w:.-]*+(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
#: Elements whose content is no markup.
RAW = ("script", "style")
DEPTH = 6


def _markup(text: Column) -> Column:
    """Without comments, CDATA sections and the content of scripts and styles."""
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"(?s)<!\[CDATA\[.*?\]\]>", "")
    for name in RAW:
        text = F.regexp_replace(text, rf"(?is)(<{name}\b[^>]*>).*?(</{name}>)", "$1$2")
    return text


def elements(docs: DataFrame, key: str, text: str, fold: bool = True) -> DataFrame:
    """(key, node, name, depth, parent, matched): every element of XML or HTML texts, numbered as its tag stands.

    The tags of a text are rows; a running sum of opened less closed ones is their depth, and an
    element's parent is the last one opened before it at the depth above, a running value over the rows
    of that depth. Names that a text opens and closes unequally often (``<p>``, ``<br>``) have no
    content there, like ``<br/>``. ``matched`` is false for a whole text of which some tag closes an
    element of another name. ``fold`` reads names without case. Null texts and those without tags have
    no rows.
    """
    i = F.col("node")
    tags = docs.select(key, F.posexplode(F.regexp_extract_all(_markup(F.col(text)), F.lit(TAG), F.lit(0))).alias("node", "tag"))
    name = F.regexp_extract("tag", r"^</?([^\s/>]+)", 1)
    closes, alone = F.col("tag").startswith("</"), F.col("tag").endswith("/>")
    rows = tags.select(key, "node", (F.lower(name) if fold else name).alias("name"), F.when(closes, -1).when(alone, 0).otherwise(1).alias("turn"))
    of_name = Window.partitionBy(key, "name")
    rows = rows.withColumn("even", F.sum("turn").over(Window.partitionBy(key, "name")) == 0).filter("even or turn >= 0")
    rows = rows.withColumn("turn", F.when(F.col("even"), F.col("turn")).otherwise(0))
    along = Window.partitionBy(key).orderBy(i).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("depth", F.sum("turn").over(along).cast("int") + F.when(F.col("turn") == 1, 0).otherwise(1))
    # An opened element stands at its own depth for what follows, and asks at the depth above for its parent; a tag that closes asks at its own.
    level = F.when(F.col("turn") == -1, F.array("depth")).when(F.col("turn") == 1, F.array("depth", F.col("depth") - 1)).otherwise(F.array(F.col("depth") - 1))
    at = rows.select("*", F.explode(level).alias("level"))
    opened = F.when((F.col("turn") == 1) & (F.col("level") == F.col("depth")), F.struct(i.alias("node"), F.col("name").alias("name")))
    above = F.last(opened, ignorenulls=True).over(Window.partitionBy(key, "level").orderBy(i).rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn("_above", above)
    wrong = (F.col("turn") == -1) & ~F.coalesce(F.col("_above.name") == F.col("name"), F.lit(False))
    at = at.withColumn("matched", ~F.max(wrong).over(Window.partitionBy(key)))
    asks = (F.col("turn") >= 0) & (F.col("level") == F.col("depth") - 1)
    return at.filter(asks).select(key, "node", "name", "depth", F.when(F.col("depth") > 1, F.col("_above.node")).alias("parent"), "matched")


def expand_types(fields: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(type, path, kind, level): the shape of every declared type, fields of its fields' types included.

    ``fields``: (type, field, kind, ref), ref the type of a field that has one. Each type is expanded
    once and grafted wherever it is used: a round puts the trees so far under the leaves that they
    still have open, so their height doubles. A field whose type is on its own way already is kept as
    kind ``circle``, one that would pass ``depth`` fields as ``deep``; neither goes on. A ref that no
    row declares is an object without fields.
    """
    own = fields.select("type", F.col("field").alias("path"), "kind", "ref", F.col("ref").isNotNull().alias("open"), F.array("type").alias("way"), F.lit(1).alias("level"))
    made = [materialize(_cut(own, depth), "type-shapes")]  # what each round adds, written once
    while not made[-1].filter("open").isEmpty():
        nodes = reduce(DataFrame.unionByName, [t.withColumn("open", F.lit(False)) for t in made[:-1]], made[-1])
        below = nodes.select(F.col("type").alias("ref"), *[F.col(c).alias(f"_{c}") for c in ("path", "kind", "ref", "open", "way", "level")])
        grafted = made[-1].filter("open").join(below, "ref").filter((F.col("level") + F.col("_level") <= depth) & ~F.arrays_overlap("way", "_way"))
        grafted = grafted.select(
            "type", F.concat("path", F.lit("."), "_path").alias("path"), F.col("_kind").alias("kind"), F.col("_ref").alias("ref"), F.col("_open").alias("open"), F.concat("way", "_way").alias("way"), (F.col("level") + F.col("_level")).alias("level")
        )
        made.append(materialize(_cut(grafted, depth), "type-shapes"))
    return reduce(DataFrame.unionByName, [t.select("type", "path", "kind", "level") for t in made])


def _cut(nodes: DataFrame, depth: int) -> DataFrame:
    """Fields that go no further; those that an inner tree goes on from may be cut on a longer way."""
    circle = F.coalesce(F.array_contains("way", F.col("ref")), F.lit(False))
    deep = F.col("ref").isNotNull() & (F.col("level") >= depth)
    kind = F.when(circle, "circle").when(deep, "deep").otherwise(F.col("kind"))
    return nodes.withColumns({"kind": kind, "open": F.col("open") & ~circle & ~deep})


#: Scopes from most to least specific.
SCOPES = ("file", "folder", "repo", "all")


def _scoped(rows: DataFrame) -> Column:
    keys = [F.struct(F.lit(n).alias("rank"), (F.col(s).cast("string") if s != "all" else F.lit("")).alias("key")) for n, s in enumerate(SCOPES)]
    return F.explode(F.array(*keys))


def by_nearest_scope(calls: DataFrame, facts: DataFrame) -> DataFrame:
    """(call, scope, value): what the code itself says of each call's name, in the most specific scope that says anything.

    ``calls``: (call, name, file, folder, repo); ``facts``: (name, value, file, folder, repo), found in
    the scanned data. Facts are summed up for all scopes at once, each scope's as one value or a
    disagreement; calls meet them by equal keys in one join. Where the nearest scope disagrees, or none
    knows the name, the value is null: a wider one is not asked. Null values are not facts.
    """
    lo, hi = F.min("value"), F.max("value")
    said = facts.filter("value is not null").select("name", "value", _scoped(facts).alias("s")).groupBy("name", "s.rank", "s.key").agg(lo.alias("lo"), hi.alias("hi"))
    asks = calls.select("call", "name", _scoped(calls).alias("s")).select("call", "name", "s.rank", "s.key")
    met = dealt(asks, "name", "rank", "key").join(said, ["name", "rank", "key"]).groupBy("call").agg(F.min(F.struct("rank", "lo", "hi")).alias("_m"))
    scope = F.get(F.array(*[F.lit(s) for s in SCOPES]), F.col("_m.rank"))
    return calls.select("call").join(met, "call", "left").select("call", scope.alias("scope"), F.when(F.col("_m.lo") == F.col("_m.hi"), F.col("_m.lo")).alias("value"))


ABI = "array<struct<type:string,name:string,stateMutability:string>>"


def abi_methods(files: DataFrame) -> DataFrame:
    """(path, method, reads): the functions that contract interfaces in JSON declare, and whether they only read. ``files``: (path, body); what is no such JSON has none."""
    entries = files.select("path", F.explode(F.from_json("body", ABI)).alias("e")).filter("e.type = 'function' and e.name is not null")
    return entries.select("path", F.col("e.name").alias("method"), F.coalesce(F.col("e.stateMutability").isin("view", "pure"), F.lit(False)).alias("reads")).distinct()
