"""Registries of SDK methods: JSON files in a folder, read as a dimension that calls are joined to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The parts of a registry file that joins need; others are left unread.
SCHEMA = (
    "package string, provider string, host string, auth string, basePath string, imports array<string>, aliases array<string>, instance struct<names: array<string>>, "
    "methods map<string, struct<method: string, path: string, host: string>>"
)


def read_registries(spark: SparkSession, folder: str) -> DataFrame:
    """(entry, package, root, names, provider, host, auth, key, method, path) of all registry files below a folder."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return registry_rows(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")))


def registry_rows(files: DataFrame) -> DataFrame:
    """A row for each method of each registry, and each of its import roots. ``files``: (path, body).

    ``root`` is what code imports: the registry's imports, else its package and the package's other
    names. ``names`` are the constructors and factories of its client; empty if any will do. A file
    may hold one registry or a list of them; files that are neither, and registries without methods,
    give no rows. ``entry`` orders registries by file and place.
    """
    several = F.from_json("body", f"array<struct<{_typed(SCHEMA)}>>")
    one = F.from_json("body", SCHEMA)
    listed = F.when(F.ltrim("body").startswith("["), several).otherwise(F.array(one))
    each = files.select("path", F.posexplode(listed).alias("at", "r")).filter("r.methods is not null and r.package is not null")
    entry = F.dense_rank
    from pyspark.sql import Window

    # Registries are files written by hand: a few hundred rows, numbered before their methods are spread.
    numbered = each.withColumn("entry", entry().over(Window.orderBy("path", "at")))
    none = F.array().cast("array<string>")
    roots = F.when(F.size(F.coalesce("r.imports", none)) > 0, F.col("r.imports")).otherwise(F.array_distinct(F.concat(F.array("r.package"), F.coalesce("r.aliases", none))))
    spread = numbered.select("entry", "r", F.explode(roots).alias("root")).select("entry", "r", "root", F.explode("r.methods").alias("key", "m"))
    return spread.select(
        "entry",
        F.col("r.package").alias("package"),
        "root",
        F.coalesce("r.instance.names", none).alias("names"),
        F.col("r.provider").alias("provider"),
        F.coalesce("m.host", "r.host").alias("host"),
        F.col("r.auth").alias("auth"),
        "key",
        F.col("m.method").alias("method"),
        F.concat(F.coalesce("r.basePath", F.lit("")), F.coalesce("m.path", F.lit(""))).alias("path"),
    )


def _typed(ddl: str) -> str:
    """A schema's columns as the fields of a struct."""
    out, depth, name = [], 0, True
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if name and not depth and c == " " and out and out[-1] not in (",", " "):
            out.append(": ")
            name = False
            continue
        name = name or (c == "," and not depth)
        out.append(c)
    return "".join(out)


def match_sdk_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """SDK calls of code against registries: the columns of ``calls`` and package, provider, host, auth, key, method, path.

    ``calls``: (call, root, ctor, key, ...): the imported package, the constructor or factory that made
    the client (empty: none, the package's own function), and the names behind it. A registry that
    lists constructors takes only those. Exact keys win over wildcards (``*`` one name, ``**`` one or
    more), earlier registries over later ones.
    """
    fits = (F.size("names") == 0) | F.array_contains("names", F.col("ctor")) | (F.col("ctor") == "")
    said = ["root", "entry", "package", "provider", "host", "auth", "method", "path"]
    exact = calls.join(methods.filter(~F.col("key").contains("*")), ["root", "key"]).filter(fits).select("call", F.lit(0).alias("rank"), F.col("key").alias("met"), *said)
    quoted = F.regexp_replace("pattern", r"([.+?^$(){}|\[\]\\])", r"\\$1")
    deep = F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^.]+")), F.lit("\u0001"), F.lit(".+"))
    wild = methods.filter(F.col("key").contains("*")).withColumnRenamed("key", "pattern").withColumn("regex", F.concat(F.lit("^"), deep, F.lit(r"\z")))
    loose = calls.join(wild, "root").filter(fits & F.expr("key rlike regex")).select("call", F.lit(1).alias("rank"), F.col("pattern").alias("met"), *said)
    best = exact.union(loose).groupBy("call").agg(F.min_by(F.struct(*said), F.struct("rank", "entry")).alias("m"))
    # A call may stand there with several roots; the one that met its registry stays.
    met = best.select("call", F.col("m.root").alias("root"), *[f"m.{c}" for c in said if c not in ("root", "entry")])
    return calls.join(met, ["call", "root"]).select(*calls.columns, "package", "provider", "host", "auth", "method", "path")
