"""What a scan says about its call rows: statistics, diagnostics, coverage, evaluation, checks and texts.

A call row holds at least ``seq``, ``file``, ``line``, ``col``, ``language``, ``client``, ``provider``,
``host_kind``, ``host``, ``method`` and ``path``; functions name what else they read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import fixed

FACETS = ("language", "client", "provider", "host_kind")


def stats(calls: DataFrame, facets: Sequence[str] = FACETS) -> DataFrame:
    """(facet, key, n, first_seq): counts by each facet in one pass; ties go to the key seen first."""
    keys = [F.col(f) for f in facets]
    sets = calls.groupingSets([[k] for k in keys], *keys).agg(*[F.grouping(f).alias(f"_{f}") for f in facets], F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    facet = F.coalesce(*[F.when(F.col(f"_{f}") == 0, F.lit(f)) for f in facets])
    return sets.select(facet.alias("facet"), F.coalesce(*keys).alias("key"), "n", "first_seq")


def top_counts(counts: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(facet, text): the most frequent keys of each facet as ``a=3, b=2``. ``sizes``: how many of which facet."""
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "first_seq"))
    shown = counts.filter(F.col("facet").isin(*sizes)).withColumn("k", rank).filter(F.col("k") <= size[F.col("facet")])
    listed = F.array_sort(F.collect_list(F.struct("k", F.concat_ws("=", "key", F.col("n").cast("string")).alias("t"))))
    return shown.groupBy("facet").agg(F.array_join(F.transform(listed, lambda x: x["t"]), ", ").alias("text"))


def has_shape(body_type: Column) -> Column:
    return F.coalesce(~body_type.isin("dynamic", "unknown"), F.lit(False))


def shape_counts(calls: DataFrame) -> DataFrame:
    """(calls, with_body, with_dynamic) of rows with ``body_type`` and ``n_dynamic``."""
    return calls.agg(F.count("*").alias("calls"), F.count_if(has_shape(F.col("body_type"))).alias("with_body"), F.count_if(F.col("n_dynamic") > 0).alias("with_dynamic"))


def file_counts(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """(language, seen, scanned). Both: (file, language), distinct files."""
    read = scanned.select("file").distinct().withColumn("_read", F.lit(True))
    return files.join(read, "file", "left").groupBy("language").agg(F.count("*").alias("seen"), F.count("_read").alias("scanned"))


#: Reasons that the caller of a scan asked for; up to so many files of these are listed one by one.
REQUESTED, LISTED = ("excluded", "not-included"), 200


def diagnostics(skipped: DataFrame, problems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((reason, n, complete), listed): counts by reason, and the skipped files that are listed.

    ``skipped``: (file, reason); ``problems``: calls dropped or not followed, any columns. A scan is
    complete if nothing was lost: no file skipped for a reason of its own, no problem. Files left out
    on request are listed only while there are at most 200 of them, all reasons together.
    """
    asked = F.col("reason").isin(*REQUESTED)
    facts = skipped.agg(F.count_if(asked).alias("asked"), F.count_if(~asked).alias("lost")).crossJoin(problems.agg(F.count("*").alias("problems")))  # one row each
    complete = facts.select(((F.col("lost") == 0) & (F.col("problems") == 0)).alias("complete"))
    counts = skipped.groupBy("reason").agg(F.count("*").alias("n")).crossJoin(F.broadcast(complete))
    listed = skipped.crossJoin(F.broadcast(facts.select("asked"))).filter(~asked | (F.col("asked") <= LISTED)).drop("asked")
    return counts, listed


def host_coverage(mentions: DataFrame, unexplained: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """((language, named, explained), top): hosts by the language of their first mention; the unexplained ones in most files.

    ``mentions``: (host, file, line, language); ``unexplained``: (host).
    """
    at = F.struct("file", "line")
    seen = mentions.groupBy("host").agg(F.count_distinct("file").alias("files"), F.count("*").alias("literals"), F.min_by("language", at).alias("language"))
    marked = seen.join(unexplained.select("host").distinct().withColumn("_no", F.lit(True)), "host", "left")
    by_language = marked.groupBy("language").agg(F.count("*").alias("named"), F.count_if(F.col("_no").isNull()).alias("explained"))
    return by_language, marked.filter("_no").orderBy(F.desc("files"), "host").limit(most).drop("_no")


def import_sites(imports: DataFrame, calls: DataFrame, aliases: DataFrame, declared: DataFrame) -> DataFrame:
    """(package, import_sites, calls). ``imports``: (package, file); ``calls``: (package); ``aliases``: (package, alias); ``declared``: (package).

    Calls of a package count for those of its other names that the manifests declare, unless they
    declare the package itself.
    """
    sites = imports.groupBy("package").agg(F.count_distinct("file").alias("import_sites"))
    own = calls.groupBy("package").agg(F.count("*").alias("n"))
    stated = declared.select("package").distinct()
    renamed = aliases.distinct().join(stated, "package", "left_anti").join(stated.withColumnRenamed("package", "alias"), "alias", "left_semi")
    extra = own.join(renamed, "package").select(F.col("alias").alias("package"), "n")
    counted = own.union(extra).groupBy("package").agg(F.sum("n").alias("calls"))
    return sites.join(counted, "package", "full").select("package", F.coalesce("import_sites", F.lit(0)).alias("import_sites"), F.coalesce("calls", F.lit(0)).alias("calls"))


def packages_in_scope(declared: DataFrame, known: DataFrame, imported: DataFrame) -> DataFrame:
    """(package): known ones that are declared or imported."""
    names = known.select("package")
    return declared.select("package").intersect(names).union(imported.select("package").intersect(names)).distinct()


def provider_class(provider: Column) -> Column:
    return F.when(provider.isin("internal", "unknown"), provider).when(provider.startswith("env:"), "env").otherwise("resolved")


# What an inventory calls its own backend, and what it calls third parties.
INTERNAL_KINDS = ["internal", "first-party", "own", "self", "backend"]
THIRD_PARTY_KINDS = ["third-party", "thirdparty", "external", "3p"]


def inventory_says(kind: Column, service: Column, repo: Column) -> Column:
    """Whether an inventory entry is third-party or internal, by its kind, else its service; null if it does not say."""
    named = F.lower(service)
    own = named.isin(INTERNAL_KINDS) | (named == F.lower(repo))
    return (
        F.when(kind.isin(THIRD_PARTY_KINDS), "third-party")
        .when(kind.isin(INTERNAL_KINDS), "internal")
        .when(F.coalesce(named, F.lit("")) == "", None)
        .when(own, "internal")
        .otherwise("third-party")
    )


def evaluation_totals(matches: DataFrame) -> DataFrame:
    """One row for each repository and one for all (repo null): how its inventory was met.

    ``matches``: (repo, entry_line, kind, service, call_line, provider, via); the last three null where
    no call matched.
    """
    hit = F.col("call_line").isNotNull()
    cls, says = provider_class(F.col("provider")), inventory_says(F.col("kind"), F.col("service"), F.col("repo"))
    third = hit & ~F.coalesce(says == "internal", F.lit(False)) & ~(says.isNull() & (cls == "internal"))
    return matches.select(
        "repo",
        hit.alias("hit"),
        (hit & (F.col("call_line") == F.col("entry_line"))).alias("same"),
        (hit & F.coalesce("via", F.lit(False))).alias("via"),
        F.when(hit, cls).alias("cls"),
        (third & says.isNotNull()).alias("by_inventory"),
        (third & says.isNull()).alias("by_report"),
        (third & cls.isin("unknown", "env")).alias("open"),
    ).rollup("repo").agg(
        F.count("*").alias("entries"),
        *[F.count_if(c).alias(n) for c, n in (("hit", "matched"), ("same", "same_line"), ("via", "through_wrapper"))],
        *[F.count_if(F.col("cls") == c).alias(c) for c in ("resolved", "internal", "unknown", "env")],
        *[F.count_if(c).alias(n) for c, n in (("by_inventory", "third_by_inventory"), ("by_report", "third_by_report"), ("open", "third_unresolved"))],
    )


def run_totals(calls: DataFrame) -> DataFrame:
    """One row for each ``repo`` and one for all (repo null): files, calls, fixed hosts, SDK calls, bodies, dynamic parts, unresolved providers."""
    cls = provider_class(F.col("provider"))
    return calls.rollup("repo").agg(
        F.count_distinct("file").alias("files"),
        F.count("*").alias("calls"),
        F.count_if(F.col("host_kind").isin("literal", "const")).alias("fixed_host"),
        F.count_if(F.col("client") == "sdk").alias("sdk"),
        F.count_if(has_shape(F.col("body_type"))).alias("body"),
        F.count_if(F.col("n_dynamic") > 0).alias("dyn"),
        F.count_if(cls.isin("unknown", "env")).alias("unresolved"),
    )


def label_precision(labels: DataFrame) -> DataFrame:
    """(host_kind, labelled, real, provider_ok, path_ok, body_ok, with_body, precision): hand labels, for each host kind and all (null).

    ``labels``: host_kind and is_call, provider_ok, path_ok, body_ok as ``y``, ``n``, ``partial``, ``na``
    or nothing; rows without is_call are not labelled. Shares without rows are null.
    """
    real = F.col("is_call") == "y"
    judged = F.coalesce(~F.col("body_ok").isin("", "na"), F.lit(False))
    return (
        labels.filter(F.coalesce("is_call", F.lit("")) != "")
        .rollup("host_kind")
        .agg(
            F.count("*").alias("labelled"),
            F.count_if(real).alias("real"),
            F.count_if(real & (F.col("provider_ok") == "y")).alias("provider_ok"),
            F.count_if(real & (F.col("path_ok") == "y")).alias("path_ok"),
            F.count_if(real & judged & (F.col("body_ok") == "y")).alias("body_ok"),
            F.count_if(real & judged).alias("with_body"),
        )
        .withColumn("precision", F.round(F.col("real") / F.nullif(F.col("labelled"), F.lit(0)), 6))
    )


#: Operations listed for one request.
OPERATIONS = 50


def distinct_operations(operations: DataFrame, most: int = OPERATIONS) -> DataFrame:
    """(request, type, name, ord): each operation of a request once, at its first place; more than ``most`` are one without a type and name.

    ``operations``: (request, ord, type, name).
    """
    once = operations.groupBy("request", "type", "name").agg(F.min("ord").alias("ord"))
    counted = once.groupBy("request").agg(F.count("*").alias("_n"), F.min("ord").alias("_first"))
    few = once.join(counted.filter(F.col("_n") <= most).select("request"), "request", "left_semi").select("request", "type", "name", "ord")
    none = F.lit(None).cast("string")
    return few.union(counted.filter(F.col("_n") > most).select("request", none, none, "_first"))


def limit_entries(calls: DataFrame) -> DataFrame:
    """(file, line, reason, detail): one entry for each place and bound that a document was read past. ``calls``: file, line, limit."""
    return calls.filter("limit is not null").select("file", "line", F.lit("graphql-limit").alias("reason"), F.col("limit").alias("detail")).distinct()


def first_of_each(rows: DataFrame, by: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group, with their ``place`` from 1. The rank keeps few rows a group, so none is gathered."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= most)


def union_results(parts: Sequence[DataFrame]) -> DataFrame:
    """Results of several front ends as one, by column name; what one does not give is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def match_registry(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls against SDK methods: (call, package, key, provider, host, method, path), the best entry of each call.

    ``calls``: (call, chain), names from the import on, joined by dots. ``methods``: (entry, root, key,
    provider, package, host, method, path); ``key`` is what follows the import root, where ``*`` stands
    for one name and ``**`` for one or more. Exact keys win over wildcards, earlier entries over later
    ones. Chains are cut at each dot, so roots and keys meet in equi-joins; only rows of a root that
    has wildcards are matched by pattern.
    """
    names = F.split("chain", r"\.")
    cuts = F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda i: F.struct(F.array_join(F.slice(names, F.lit(1), i), ".").alias("root"), F.array_join(F.slice(names, i + 1, F.size(names)), ".").alias("key")))
    each = calls.filter(F.size(names) > 1).select("call", F.explode(cuts).alias("c")).select("call", "c.root", "c.key")
    said = ["entry", "package", "provider", "host", "method", "path"]
    exact = each.join(methods.filter(~F.col("key").contains("*")), ["root", "key"]).select("call", "key", F.lit(0).alias("rank"), *said)
    quoted = F.regexp_replace("pattern", r"([.+?^$(){}|\[\]\\])", r"\\$1")
    deep = F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^.]+")), F.lit("\u0001"), F.lit(".+"))
    wild = methods.filter(F.col("key").contains("*")).withColumnRenamed("key", "pattern").withColumn("regex", F.concat(F.lit("^"), deep, F.lit(r"\z")))
    loose = each.join(wild, "root").filter(F.expr("key rlike regex")).select("call", "key", F.lit(1).alias("rank"), *said)
    best = exact.union(loose).groupBy("call").agg(F.min_by(F.struct("key", *said), F.struct("rank", "entry")).alias("m"))
    return best.select("call", "m.package", "m.key", "m.provider", "m.host", "m.method", "m.path")


#: Callers read for a parameter, for a client, and clients that they may agree on.
VALUE_CALLERS, CALLERS, CLIENTS = 20, 50, 4


def receivers(uses: DataFrame, callers: DataFrame, declared: DataFrame) -> DataFrame:
    """(use, client, source): the clients that an untyped parameter may be.

    ``uses``: (use, fn, param, key, repo), a method called on a parameter; ``callers``: (fn, param, ord,
    client), what callers pass; ``declared``: (repo, key, package), declared SDKs that have the
    method. The first four distinct clients of the first 50 callers, else the one package that the
    manifests declare with that method.
    """
    read = first_of_each(callers, ["fn", "param"], ["ord"], CALLERS).filter("client is not null")
    passed = first_of_each(read.groupBy("fn", "param", "client").agg(F.min("ord").alias("ord")), ["fn", "param"], ["ord"], CLIENTS)
    by_caller = uses.join(passed, ["fn", "param"]).select("use", "client", F.lit("caller").alias("source"))
    single = declared.groupBy("repo", "key").agg(F.min("package").alias("client"), F.max("package").alias("_other")).filter("client = _other")
    open_ = uses.join(by_caller.select("use").distinct(), "use", "left_anti")
    return by_caller.union(open_.join(single, ["repo", "key"]).select("use", "client", F.lit("manifest").alias("source")))


def single_setup(setups: DataFrame) -> DataFrame:
    """(repo, value): a repository's setting where exactly one call gives it. ``setups``: (repo, value), a row for each setup call."""
    return setups.groupBy("repo").agg(F.count("*").alias("_n"), F.min("value").alias("value")).filter("_n = 1").drop("_n")


def param_values(callers: DataFrame, defaults: DataFrame) -> DataFrame:
    """(param, found, unread): the values that callers pass for a parameter, in their order, the default first where some caller omits it.

    ``callers``: (param, ord, given, spread, value), a row for each call of the function; value null for
    none given or ``None``. ``defaults``: (param, value). The first 20 callers are read; more, or a
    spread, make the parameter ``unread``. Parameters of which nothing is known are left out.
    """
    count = callers.groupBy("param").agg(F.count("*").alias("_n"))
    read = first_of_each(callers, ["param"], ["ord"], VALUE_CALLERS)
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("given") & F.col("value").isNotNull(), F.struct("ord", "value")))), lambda x: x["value"])  # 20 at most
    told = read.groupBy("param").agg(listed.alias("values"), F.bool_or(~F.col("given") & F.col("spread")).alias("spread"), F.bool_or(~F.col("given") & ~F.col("spread")).alias("omitted"))
    every = told.join(count, "param").join(defaults.withColumnRenamed("value", "default"), "param", "full")
    omitted = F.coalesce("omitted", F.lit(True))
    values = F.concat(F.when(omitted & F.col("default").isNotNull(), F.array("default")).otherwise(F.array().cast("array<string>")), F.coalesce("values", F.array().cast("array<string>")))
    unread = F.coalesce(F.col("spread") | (F.col("_n") > VALUE_CALLERS), F.lit(False))
    return every.select("param", values.alias("found"), unread.alias("unread")).filter((F.size("found") > 0) | F.col("unread"))


def header_values(values: DataFrame) -> DataFrame:
    """(call, header, value, alternatives): the first literal value of each header, null if one cannot be read; all of them where there are several.

    ``values``: (call, header, ord, value); a value that cannot be read, that looks secret, or that a
    credential header holds is null.
    """
    name = F.lower("header")
    told = F.when(~name.isin(fixed.CREDENTIAL_HEADERS) & ~F.col("value").rlike(fixed.SECRET), F.col("value"))
    rows = values.select("call", name.alias("header"), "ord", told.alias("value"))
    once = rows.groupBy("call", "header", "value").agg(F.min("ord").alias("ord"))
    known = F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("ord", "value")))), lambda x: x["value"])  # of one header
    each = once.groupBy("call", "header").agg(known.alias("known"), F.bool_or(F.col("value").isNull()).alias("unread"))
    several = (F.size("known") > 1) | (F.col("unread") & (F.size("known") > 0))
    return each.select("call", "header", F.when(~F.col("unread"), F.get("known", F.lit(0))).alias("value"), F.when(several, F.col("known")).alias("alternatives"))


def with_env_hints(calls: DataFrame, hints: DataFrame) -> DataFrame:
    """Add ``hint_host``, ``hint_path`` and ``hint_scheme`` to calls whose host is a variable. ``hints``: (env_name, value), an example of each.

    Only values that are HTTP URLs tell; a lone slash is no path.
    """
    value = F.col("_value")
    rest = F.regexp_extract(value, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    return (
        calls.join(hints.select("env_name", F.col("value").alias("_value")).filter(F.col("_value").rlike("(?i)^https?://[^/?#]")), "env_name", "left")
        .withColumns(
            {
                "hint_host": F.lower(F.regexp_extract(value, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#]+)", 1)),
                "hint_path": F.regexp_replace(rest, r"/\z", ""),
                "hint_scheme": F.lower(F.regexp_extract(value, r"(?i)^(https?)://", 1)),
            }
        )
        .drop("_value")
    )


# Verbs that send and that read, names of URLs and of fetch functions, texts that are URLs.
SENDING, READING = ["post", "put", "patch", "delete", "request", "send"], ["get", "head", "options", "stream"]
URL_NAME, URL_TEXT, FETCH_NAME = r"(?i)url|uri|href|endpoint|path|link|route", r"^(?:https?:)?//|^/", r"(?i)fetch|request|http"


def unfollowed(sites: DataFrame, detected: DataFrame) -> DataFrame:
    """(site, reason): calls on something passed in whose target is not known. ``detected``: (site), found as calls.

    ``sites``: (site, root_kind, root, verb, first_text, first_name): what is called on, the method
    (null: the root itself), and the first argument as a literal or a name. Reading verbs need a
    literal URL, so that a cache's ``get`` is none.
    """
    literal = F.coalesce(F.col("first_text").rlike(URL_TEXT), F.lit(False))
    like = literal | F.coalesce(F.col("first_name").rlike(URL_NAME), F.lit(False))
    verb = F.col("verb")
    reason = (
        F.when(verb.isNull(), F.when(F.col("root").rlike(FETCH_NAME), "injected-fetch"))
        .when(~verb.isin(*SENDING, *READING), F.when(verb.rlike(FETCH_NAME), "injected-fetch"))
        .when(verb.isin(SENDING) | literal, "injected-client")
    )
    passed = sites.filter(F.col("root_kind").isin("param", "field") & like)
    return passed.join(detected, "site", "left_anti").select("site", reason.alias("reason")).filter("reason is not null")


# Kinds of hosts, authentication and bodies that a call row may have.
HOST_KINDS = ["literal", "const", "env", "relative", "unknown"]


def call_checks() -> list[tuple[str, Column]]:
    """What every call row has to hold, in the order in which failures are named."""
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return [
        ("id", F.coalesce(F.col("id").rlike(r"^[0-9a-f]{12}\z"), F.lit(False))),
        ("location.file", given("file")),
        ("location.line", F.coalesce(F.col("line") >= 1, F.lit(False))),
        ("client", given("client")),
        ("provider", given("provider")),
        ("method", F.coalesce(F.col("method").rlike(r"^[A-Z]+\z"), F.lit(False))),
        ("hostKind", F.coalesce(F.col("host_kind").isin(HOST_KINDS), F.lit(False))),
        ("pathTemplate", F.coalesce(F.col("path").startswith("/"), F.lit(False))),
    ]


def split_valid(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, dropped): rows that hold all checks; the others as (file, line, reason, detail), with the first that failed."""
    failed = F.coalesce(*[F.when(~ok, F.lit(name)) for name, ok in call_checks()])
    marked = calls.withColumn("_failed", failed)
    dropped = marked.filter("_failed is not null").select(F.coalesce("file", F.lit("?")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), F.lit("schema-invalid").alias("reason"), F.concat("_failed", F.lit(": invalid")).alias("detail"))
    return marked.filter("_failed is null").drop("_failed"), dropped


def json_lines(calls: DataFrame, operation: str | None = None) -> DataFrame:
    """(json): a row as one JSON object without absent fields; an operation keeps its name, be it null. ``operation``: a struct column with name."""
    plain = [c for c in calls.columns if c != operation]
    body = F.to_json(F.struct(*plain))
    if operation is None:
        return calls.select(body.alias("json"))
    name = F.coalesce(F.to_json(F.array(F.col(operation)["name"])), F.lit("[null]"))
    inner = F.concat(F.lit(f'"{operation}":{{"name":'), F.expr("substring(_n, 2, length(_n) - 2)"), F.lit("}"))
    joined = F.when(F.col(operation).isNull(), F.col("_b")).otherwise(F.concat(F.expr("substring(_b, 1, length(_b) - 1)"), F.when(F.col("_b") == "{}", "").otherwise(","), inner, F.lit("}")))
    return calls.withColumns({"_b": body, "_n": name}).select(joined.alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, without absent fields."""
    rows.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_lines(lines: DataFrame, path: str, column: str = "text") -> None:
    """A text sink; rows keep their partitions' order."""
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def table_lines(calls: DataFrame) -> DataFrame:
    """(file, place, text): a section for each file, its name first, then a line for each call by line and column."""
    first = Window.partitionBy("file").orderBy("line", "col", "seq")
    row = F.concat_ws("  ", F.lpad(F.col("line").cast("string"), 5, " "), F.rpad("method", 7, " "), F.rpad("provider", 17, " "), "path", F.col("n_dynamic").cast("string"))
    head = calls.groupBy("file").agg(F.min("language").alias("language")).select("file", F.lit(0).alias("place"), F.concat_ws("  ", "file", "language").alias("text"))
    return head.union(calls.select("file", F.row_number().over(first).alias("place"), row.alias("text")))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def diagnostics_line(d: DataFrame) -> Column:
    """Text of a row of files_seen, files_scanned, skipped, limits, tables, unfollowed, dropped and complete."""
    some = lambda c, text: F.when(F.col(c) > 0, text)
    return F.concat_ws(
        ", ",
        F.format_string("scanned %d/%d files", "files_scanned", "files_seen"),
        some("skipped", F.concat(F.col("skipped").cast("string"), F.lit(" skipped"))),
        some("unfollowed", F.concat(plural(F.col("unfollowed"), "call", "calls"), F.lit(" not followed"))),
        some("limits", F.concat(plural(F.col("limits"), "GraphQL document", "GraphQL documents"), F.lit(" not fully read"))),
        some("tables", F.concat(plural(F.col("tables"), "host table", "host tables"), F.lit(" too large to list"))),
        some("dropped", F.concat(plural(F.col("dropped"), "call", "calls"), F.lit(" dropped"))),
        F.when(F.col("complete"), "complete"),
    )


def coverage_warnings(coverage: DataFrame) -> DataFrame:
    """(package, text): a line for each imported SDK whose calls are missing. ``coverage``: package, import_sites, status."""
    where = F.concat(F.col("package"), F.lit(" imported in "), plural(F.col("import_sites"), "file", "files"))
    text = F.when(F.col("status") == "unsupported", F.concat(where, F.lit(", no registry: its calls are not listed"))).when(F.col("status") == "imported-no-calls", F.concat(where, F.lit(", but no call was found (used through a wrapper?)")))
    return coverage.select("package", text.alias("text")).filter("text is not null")


def markdown_lines(totals: DataFrame) -> DataFrame:
    """(repo, text): the rows of :func:`run_totals` as a Markdown table's."""
    cells = ["files", "calls", "fixed_host", "sdk", "body", "dyn", "unresolved"]
    return totals.select("repo", F.concat(F.lit("| "), F.concat_ws(" | ", F.coalesce("repo", F.lit("total")), *[F.col(c).cast("string") for c in cells]), F.lit(" |")).alias("text"))


def sample_for_labels(calls: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` rows, an equal part of each stratum, by seeded hash: (the rows, ``pick``). One row for each stratum is counted first."""
    strata = calls.select(stratum).distinct().agg(F.count("*").alias("_strata"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    pick = F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))
    return calls.crossJoin(F.broadcast(strata)).withColumn("pick", pick).filter(F.col("pick") <= F.ceil(F.lit(n) / F.greatest(F.col("_strata"), F.lit(1)))).drop("_strata")
