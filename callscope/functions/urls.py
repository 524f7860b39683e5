"""URLs and paths as column expressions. Templates hold ``{name}`` and ``{env:NAME}`` where a value is not known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import fixed

SCHEME = r"(?i)^([a-z][a-z0-9+.-]*)://"


def _none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def after(text: Column, start: Column) -> Column:
    """What follows the first characters that ``start`` is long."""
    return F.substring(text, F.length(start) + 1, F.length(text))


def safe_key(key: Column) -> Column:
    return ~key.isin(fixed.UNSAFE_KEYS)


def canonical_path(path: Column) -> Column:
    """Single slashes, a leading one, no trailing one; ``{env:X}`` shortened to ``{X}``."""
    single = F.regexp_replace(F.regexp_replace(path, r"\{env:([^}]+)\}", "{$1}"), "/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(single, r"\A(?!/)", "/"), r"(?s)(?<=.)/\z", "")


def looks_like_id(segment: Column) -> Column:
    return segment.rlike(fixed.ID_SEGMENT)


def placeholders(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(r"\{([^}]+)\}"), F.lit(1))


def segments(path: Column) -> Column:
    """Segments without the leading empty one."""
    parts = F.split(path, "/")
    return F.when(parts[0] == "", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that later ones use several times.

    It goes through a generator of one row, as Catalyst moves filters and projections into a plain
    column's expression and then repeats it, but never into what a generator makes.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def with_shape(rows: DataFrame, template: Column, via_const: Column, out: str = "u") -> DataFrame:
    """Add a struct of host_kind, host, env_name, scheme, path and query (names), all from one URL template.

    Null templates drop out, as they name no URL.
    """
    none = F.lit(None).cast("string")
    text = F.ltrim(F.regexp_replace(template, r"(?i)^(\s*[a-z][a-z0-9+.-]*://)[^/?#]*@", "$1"))
    rows = once(rows.filter(template.isNotNull()), text, "_text")
    t = F.col("_text")
    pieces = F.struct(
        F.lower(F.regexp_extract(t, SCHEME, 1)).alias("scheme"),
        F.regexp_extract(t, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1).alias("host"),
        F.regexp_extract(t, r"(?is)^[a-z][a-z0-9+.-]*://[^/?#]*(.*)\z", 1).alias("rest"),
        F.regexp_extract(t, r"^\{([^}]+)\}", 1).alias("leading"),
        F.regexp_replace(t, r"^\{[^}]+\}", "").alias("tail"),
    )
    rows = once(rows, pieces, "_a")
    scheme, leading = _none_if_empty(F.col("_a.scheme")), _none_if_empty(F.col("_a.leading"))
    tail, rest = F.col("_a.tail"), F.col("_a.rest")
    prefix = F.lower(F.substring_index("_a.host", "{", 1))
    host = F.concat(prefix, after(F.col("_a.host"), prefix))
    names = F.struct(
        prefix.alias("prefix"), host.alias("host"), F.regexp_extract(host, r"\{env:([^}]+)\}", 1).alias("env"), F.regexp_extract("_a.leading", r"^env:(.*)\z", 1).alias("leading")
    )
    rows = once(rows, names, "_b")
    prefix, host = F.col("_b.prefix"), F.col("_b.host")
    env, lead_env = _none_if_empty(F.col("_b.env")), _none_if_empty(F.col("_b.leading"))
    known = F.when(via_const, "const").otherwise("literal")
    path_open = (prefix.contains(".") | prefix.startswith("localhost")) & ~prefix.endswith(".")
    slashed = F.when((tail == "") | tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))

    def found(kind: Column | str, host_: Column, env_: Column, rest_: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), host_.alias("host"), env_.alias("env"), rest_.alias("rest"))

    place = (
        F.when(scheme.isNotNull() & env.isNotNull(), found("env", host, env, rest))
        .when(scheme.isNotNull() & host.contains("{") & prefix.endswith(":"), found(known, host, none, rest))
        .when(scheme.isNotNull() & host.contains("{") & path_open, found(known, prefix, none, F.concat(F.lit("/"), after(host, prefix), rest)))
        .when(scheme.isNotNull() & host.contains("{"), found("unknown", host, none, rest))
        .when(scheme.isNotNull(), found(known, host, none, rest))
        .when(lead_env.rlike(fixed.PATH_PREFIX_ENV) & tail.startswith("/"), found("relative", none, none, tail))
        .when(lead_env.isNotNull(), found("env", none, lead_env, slashed))
        .when(leading.isNotNull(), found("unknown", none, none, slashed))
        .otherwise(found("relative", none, none, F.col("_text")))
    )
    rows = once(rows, place, "_p")
    plain = F.substring_index("_p.rest", "#", 1)
    names = F.transform(F.split(F.split_part(plain, F.lit("?"), F.lit(2)), "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    names = F.filter(names, lambda k: (k != "") & safe_key(k) & ~k.contains("{"))
    shape = F.struct(
        F.col("_p.kind").alias("host_kind"),
        F.col("_p.host").alias("host"),
        F.col("_p.env").alias("env_name"),
        scheme.alias("scheme"),
        canonical_path(F.split_part(plain, F.lit("?"), F.lit(1))).alias("path"),
        names.alias("query"),
    )
    return once(rows, shape, out).drop("_text", "_a", "_b", "_p")


def dot_segments(path: Column) -> Column:
    """``.`` and ``..`` segments resolved as RFC 3986 has it; a path that ends in one keeps its slash."""
    parts = F.split(path, "/")
    last_open = F.element_at(parts, -1).isin(".", "..")
    folded = F.aggregate(
        F.filter(parts, lambda s: s != "."),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(folded, "/")
    return F.when(last_open & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def join_url(base: Column, path: Column) -> Column:
    """``base`` and ``path`` with one slash between; an absolute path wins, and so does any path over an empty base."""
    slash = ~base.endswith("/") & ~path.startswith("/") & (path != "") & ~path.startswith("?")
    return F.when(path.rlike(SCHEME) | (base == ""), path).otherwise(F.concat(base, F.when(slash, "/").otherwise(""), path))
