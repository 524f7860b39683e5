"""Files of a repository as tables: selection, environment examples, manifests, WSDL, MCP configuration, inventories.

All take rows (path, body); :func:`read_files` makes them from a directory any Hadoop file system holds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import fixed, text

#: Larger files are not read as configuration.
CONFIG_BYTES = 4 * 1024 * 1024


def read_files(spark: SparkSession, path: str, max_bytes: int = CONFIG_BYTES) -> DataFrame:
    """(path, body) of the text files below ``path`` of at most ``max_bytes`` bytes; the size filter is pushed to the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= max_bytes)
    root = re.sub(r"^[a-z]+:/*", "/", path.rstrip("/"))
    return files.select(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{re.escape(root)}/", "").alias("path"), F.decode("content", "UTF-8").alias("body"))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ``**/`` any directories, ``*`` within one, ``?`` a character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}\\z"


def _any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)


def select_files(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    keep = _any(F.col("path"), include) if include else F.lit(True)
    return files.filter(keep & ~_any(F.col("path"), exclude or []))


def inside(files: DataFrame, root: str) -> DataFrame:
    """Files that still lie below ``root`` where their links lead; ``real`` is the resolved path, null for plain files."""
    return files.filter(F.col("real").isNull() | F.col("real").startswith(root.rstrip("/") + "/"))


def language_files(files: DataFrame, extensions: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The files of a language: those with its endings, minus dependencies, build output and what is excluded; include globs never add other endings."""
    ends = F.col("path").rlike("(?:" + "|".join(re.escape(e) for e in extensions) + r")\z")
    return select_files(files.filter(ends), include, [*fixed.SHARED_EXCLUDES, *(exclude or [])])


def left_out(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files that the selection leaves out, and why."""
    excluded = _any(F.col("path"), exclude or [])
    reason = F.when(excluded, "excluded").when(~_any(F.col("path"), include) if include else F.lit(False), "not-included")
    return files.withColumn("reason", reason).filter("reason is not null")


def is_shell(path: Column, body: Column) -> Column:
    return path.rlike(r"\.(?:sh|bash|zsh)\z") | F.substring_index(body, "\n", 1).rlike(r"^#!.*\b(?:ba|z|da|k)?sh\b")


def directory(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*\z", 1), r"^\./", "")


def _env_lines(files: DataFrame) -> DataFrame:
    lines = files.select("path", directory(F.col("path")).alias("dir"), F.posexplode(F.split("body", r"\r?\n", -1)).alias("n", "line")).filter("n < 5000 and length(line) <= 1000")
    part = lambda i: F.regexp_extract("line", fixed.ENV_LINE, i)
    return lines.select("path", "dir", "n", (part(1) != "").alias("commented"), part(2).alias("key"), F.concat(part(3), part(4), part(5)).alias("value")).filter("key <> '' and value <> ''")


def env_examples(files: DataFrame) -> DataFrame:
    """(dir, key, value, path, commented): what a directory's example files say of a variable; plain lines beat commented ones, the first of each wins.

    Values that read as placeholders document nothing, and so does a variable commented out with several values.
    """
    lines = _env_lines(files)
    many = lines.filter("commented").groupBy("path", "key").agg((F.count_distinct("value") > 1).alias("many"))
    good = lines.filter(F.col("value").rlike(fixed.ENV_VALUE) & ~F.col("value").rlike(fixed.ENV_PLACEHOLDER))
    first = good.groupBy("path", "dir", "key").agg(F.min_by(F.struct("value", "commented"), F.struct("commented", "n")).alias("b")).select("path", "dir", "key", "b.*")
    kept = first.join(many, ["path", "key"], "left").filter("not commented or not coalesce(many, false)")
    return kept.groupBy("dir", "key").agg(F.min_by(F.struct("value", "path", "commented"), F.struct("commented", "path")).alias("b")).select("dir", "key", "b.*")


def env_hints(files: DataFrame) -> DataFrame:
    """(key, value): the last plain assignment of a variable in any file."""
    return _env_lines(files).filter("not commented").groupBy("key").agg(F.max_by("value", F.struct("path", "n")).alias("value"))


def manifests(files: DataFrame) -> DataFrame:
    """(dir, ecosystem, package, version) of package.json, requirements.txt, go.mod and composer.json; broken files give no rows."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(directory(F.col("path")).alias("dir"), name.alias("name"), "body")

    def json_pairs(file: str, ecosystem: str, *keys: str) -> DataFrame:
        kind = "struct<" + ",".join(f"{k}:map<string,string>" for k in keys) + ">"
        maps = F.concat(*[F.coalesce(F.map_entries(F.col(f"j.{k}")), F.array().cast("array<struct<key:string,value:string>>")) for k in keys])
        parsed = rows.filter(F.col("name") == file).withColumn("j", F.from_json("body", kind))
        return parsed.select("dir", F.lit(ecosystem).alias("ecosystem"), F.explode(maps).alias("e")).select("dir", "ecosystem", text.normalise_package(F.lit(ecosystem), F.col("e.key")).alias("package"), F.col("e.value").alias("version"))

    def lines(file: str) -> DataFrame:
        return rows.filter(F.col("name") == file).select("dir", F.explode(F.split("body", r"\r?\n", -1)).alias("line"))

    requirement = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;#\s][^;#]*)?"
    pip = lines("requirements.txt").filter(F.col("line").rlike(requirement)).select(
        "dir", F.lit("pypi").alias("ecosystem"), text.normalise_package(F.lit("pypi"), F.regexp_extract("line", requirement, 1)).alias("package"), F.regexp_replace(F.trim(F.regexp_extract("line", requirement, 2)), "^==", "").alias("version")
    )
    module = r"^\s*(?:require\s+)?([a-z0-9][^\s(]*\.[^\s(]*/[^\s(]+)\s+(v\S+)"
    go = lines("go.mod").filter(F.col("line").rlike(module)).select("dir", F.lit("go").alias("ecosystem"), F.regexp_extract("line", module, 1).alias("package"), F.regexp_extract("line", module, 2).alias("version"))
    return json_pairs("package.json", "npm", "dependencies", "devDependencies", "peerDependencies").union(pip).union(go).union(json_pairs("composer.json", "packagist", "require"))


def wsdl(files: DataFrame) -> DataFrame:
    """(path, operation, address) of WSDL files up to 2 MB."""
    small = files.filter(F.length("body") <= 2 * 1024 * 1024)
    names = F.array_distinct(F.regexp_extract_all("body", F.lit(r"<(?:\w+:)?operation\b[^>]*\bname=[\"']([^\"']+)[\"']"), F.lit(1)))
    address = F.regexp_extract("body", r"<(?:\w+:)?address\b[^>]*\blocation=[\"']([^\"']+)[\"']", 1)
    return small.select("path", F.explode(names).alias("operation"), F.nullif(address, F.lit("")).alias("address"))


def plain_json(body: Column) -> Column:
    """JSONC as JSON: comments outside strings and trailing commas go."""
    without = F.regexp_replace(body, r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*(?s:.*?)\*/', "$1")
    return F.regexp_replace(without, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")


def mcp_servers(files: DataFrame, limit: int = 50) -> DataFrame:
    """(path, server, url, transport, bridge): the HTTP servers that configuration files declare, the first ``limit`` of a file; servers run by a command alone are none, unless a bridge names a URL."""
    kind = "map<string,struct<type:string,transport:string,url:string,command:string,args:array<string>>>"
    parsed = files.withColumn("j", F.from_json(plain_json(F.col("body")), f"struct<mcpServers:{kind},servers:{kind},mcp:{kind}>"))
    each = parsed.select("path", F.posexplode(F.map_entries(F.coalesce("j.mcpServers", "j.servers", "j.mcp"))).alias("i", "e")).filter(F.col("i") < limit)
    bridged = F.try_element_at(F.filter("e.value.args", lambda a: a.rlike(r"^https?://")), F.lit(1))
    url = F.coalesce("e.value.url", bridged)
    kinds = F.create_map(*[F.lit(x) for pair in fixed.MCP_TRANSPORTS.items() for x in pair])
    named = F.try_element_at(kinds, F.coalesce("e.value.type", "e.value.transport"))
    by_path = F.when(url.rlike(r"/sse(?:/|\z)"), "sse").otherwise("streamable-http")
    return each.filter(url.isNotNull()).select("path", F.col("e.key").alias("server"), url.alias("url"), F.coalesce(named, by_path).alias("transport"), F.col("e.value.url").isNull().alias("bridge"))


def inventory(rows: DataFrame) -> DataFrame:
    """Checked entries: normal paths, whole-number lines (others are rejected), and whether an entry says its service is internal."""
    file = F.regexp_replace(F.replace("file", F.lit("\\"), F.lit("/")), r"^(?:\./|/)+", "")
    line = F.when(F.col("line").rlike(r"^\d+\z"), F.col("line").try_cast("int"))
    service = F.lower("service")
    says = F.when(service.isin("internal", "first-party", "own", "self", "backend") | (service == F.lower("repo")), "internal").when(service != "", "third-party")
    return rows.select("entry", "repo", file.alias("file"), line.cast("long").alias("line"), says.alias("says")).filter("line is not null")


#: Text files that are read for names.
MAX_FILES = 100_000


def first_files(files: DataFrame, limit: int = MAX_FILES) -> DataFrame:
    """The first ``limit`` files by path, a bound that the result depends on."""
    return files.orderBy("path").limit(limit)


def typescript_scope(files: DataFrame) -> DataFrame:
    """Files that the TypeScript front end reads: no tests, declarations, build output or minified text."""
    path, body = F.col("path"), F.col("body")
    name = path.rlike(r"\.(?:[mc]?[tj]sx?|html?|vue|svelte|astro)\z")
    out = path.rlike(r"(?:^|/)(?:node_modules|dist|build|out|coverage|vendor|\.next|__tests__|__mocks__)/|\.(?:test|spec)\.|\.d\.[mc]?ts\z|\.min\.")
    longest = F.array_max(F.transform(F.split(body, "\n"), lambda x: F.length(x)))
    return files.filter(name & ~out & ~F.coalesce(longest > 5000, F.lit(False)))


def is_mcp_config(path: Column) -> Column:
    return path.rlike(r"(?:^|/)(?:\.mcp\.json|mcp\.json|mcp_config\.json|claude_desktop_config\.json|opencode\.jsonc?)\z")


def loaded_values(reads: DataFrame, files: DataFrame) -> DataFrame:
    """Values of configuration that code loads by a literal path. ``reads``: (src, literal, key as a JSON path); files up to 4 MB."""
    joined = F.concat_ws("/", F.nullif(directory(F.col("src")), F.lit("")), F.col("literal"))
    folded = F.aggregate(
        F.filter(F.split(joined, "/"), lambda s: ~s.isin("", ".")),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    small = files.filter(F.octet_length("body") <= CONFIG_BYTES).select(F.col("path").alias("target"), "body")
    met = reads.withColumn("target", F.array_join(folded, "/")).join(small, "target", "left")
    return met.withColumn("value", F.expr("get_json_object(body, key)"))


def spring_properties(files: DataFrame, profiles: list[str]) -> DataFrame:
    """(key, value) of ``.properties`` files, keys relaxed (case and dashes do not matter); profiles override the plain file, later ones earlier ones."""
    profile = F.regexp_extract("path", r"application-([\w-]+)\.properties\z", 1)
    rank = F.when(profile == "", 0)
    for i, p in enumerate(profiles):
        rank = rank.when(profile == p, i + 1)
    lines = files.filter(F.col("path").rlike(r"application(?:-[\w-]+)?\.properties\z")).select(rank.alias("rank"), F.posexplode(F.split("body", r"\r?\n", -1)).alias("n", "line")).filter("rank is not null")
    pair = r"^\s*([^#!=:\s][^=:]*?)\s*[=:]\s*(.*?)\s*\z"
    pairs = lines.filter(F.col("line").rlike(pair)).select("rank", "n", F.lower(F.regexp_replace(F.regexp_extract("line", pair, 1), "[-_]", "")).alias("key"), F.regexp_extract("line", pair, 2).alias("value"))
    return pairs.groupBy("key").agg(F.max_by("value", F.struct("rank", "n")).alias("value"))
