"""Names, secrets and small texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.functions import fixed


def language_of(path: Column) -> Column:
    """Language by the extension, ``typescript`` for any other."""
    table = F.create_map(*[F.lit(x) for pair in fixed.EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^.]*)\z", 1))), F.lit("typescript"))


def file_kind(path: Column) -> Column:
    """Kind of a file that may name tools, by where it lies."""
    rel = F.concat(F.lit("/"), path)
    name = F.element_at(F.split(rel, "/"), -1)
    instructions = name.isin(fixed.INSTRUCTION_NAMES) | rel.endswith("/.github/copilot-instructions.md")
    for folder in fixed.INSTRUCTION_DIRS:
        instructions = instructions | rel.contains(folder)
    code = F.lit(False)
    for extension in fixed.CODE_EXTENSIONS:
        code = code | name.endswith(extension)
    return (
        F.when(rel.rlike(r"/\.claude/settings(\.[\w-]+)*\.json\z"), "settings")
        .when(rel.contains("/.claude/agents/"), "agent")
        .when(rel.contains("/.claude/commands/"), "command")
        .when((name == "SKILL.md") | rel.contains("/.claude/skills/"), "skill")
        .when(instructions, "instructions")
        .when(rel.contains("/.github/workflows/"), "workflow")
        .when(code, "code")
        .otherwise("other")
    )


def looks_secret(text: Column) -> Column:
    return text.rlike(fixed.SECRET)


def is_credential_key(key: Column) -> Column:
    return key.rlike(fixed.CREDENTIAL_KEY)


def is_credential_header(name: Column) -> Column:
    return F.lower(name).isin(fixed.CREDENTIAL_HEADERS)


def redact(text: Column) -> Column:
    """The whole string goes if any of it looks secret."""
    return F.when(looks_secret(text), "<redacted>").otherwise(text)


def printable(text: Column) -> Column:
    """Control and direction characters as ``\\uXXXX``."""
    each = F.regexp_extract_all(text, F.lit(r"(?s)."), F.lit(0))
    shown = F.transform(each, lambda c: F.when(c.rlike(fixed.UNPRINTABLE), F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(_code_point(c)), 4, "0")))).otherwise(c))
    return F.when(text.rlike(fixed.UNPRINTABLE), F.array_join(shown, "")).otherwise(text)


def _code_point(c: Column) -> Column:
    return F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long")


def soap_action_name(action: Column) -> Column:
    """Last segment of an action that is not blank, or null."""
    bare = F.regexp_replace(F.trim(action), r'^"(.*)"\z', "$1")
    return F.trim(F.try_element_at(F.filter(F.split(bare, "[/#:]"), lambda s: F.trim(s) != ""), F.lit(-1)))


def package_of(spec: Column) -> Column:
    """Package that an import specifier or a CDN's URL names; null for files, aliases and other URLs."""
    cdn = F.lower(F.regexp_extract(F.trim(spec), fixed.CDN, 1))
    bare = F.regexp_replace(spec, r"^(?:node|npm):", "")
    scoped = F.concat(F.split_part(bare, F.lit("/"), F.lit(1)), F.lit("/"), F.regexp_replace(F.split_part(bare, F.lit("/"), F.lit(2)), r"^(.)([^@]*)@.*\z", "$1$2"))
    plain = F.regexp_replace(F.split_part(bare, F.lit("/"), F.lit(1)), r"^(.[^@]*)@.*\z", "$1")
    return (
        F.when(spec.rlike(r"(?i)^https?://"), F.when(cdn != "", cdn))
        .when(spec.rlike(r"^(?:\.|/|~|@/|jsr:)"), None)
        .when(bare.startswith("@"), F.when(bare.contains("/"), scoped).otherwise(bare))
        .otherwise(plain)
    )


def normalise_package(ecosystem: Column, name: Column) -> Column:
    """A package's name as its registry compares it."""
    low = F.lower(F.trim(name))
    return F.when(ecosystem == "pypi", F.regexp_replace(low, r"[-_.]+", "-")).when(ecosystem == "crates", F.replace(low, F.lit("_"), F.lit("-"))).when(ecosystem.isin("packagist", "maven", "pub"), low).otherwise(F.trim(name))


def tool_names(text: Column) -> Column:
    """Array of (server, tool) of the ``mcp__server__tool`` names in a text; templates and placeholders are no names."""
    whole = F.regexp_extract_all(text, F.lit(rf"(?s){fixed.TOOL_NAME}.?"), F.lit(0))
    server = lambda m: F.regexp_extract(m, r"^mcp__([A-Za-z0-9-]+(?:_[A-Za-z0-9-]+)*)", 1)
    rest = lambda m: F.substring(m, F.length(server(m)) + 6, F.length(m))
    tool = lambda m: F.when(rest(m).startswith("__"), F.regexp_extract(rest(m), r"^__([A-Za-z0-9_-]*)", 1))
    behind = lambda m: F.regexp_extract(m, r"(?s)^mcp__[A-Za-z0-9_-]*(.?)", 1)
    named = F.transform(whole, lambda m: F.struct(server(m).alias("server"), F.when(behind(m) != "*", tool(m)).alias("tool"), behind(m).alias("next"), tool(m).alias("raw")))
    kept = F.filter(
        named,
        lambda n: ~n["next"].isin("$", "{", "<", "%")
        & ~F.lower(n["server"]).isin(fixed.PLACEHOLDER_NAMES)
        & ~F.coalesce(F.lower(n["raw"]).isin(fixed.PLACEHOLDER_NAMES), F.lit(False))
        & ((n["next"] == "*") | n["raw"].isNull() | (n["raw"] != "")),
    )
    return F.transform(kept, lambda n: F.struct(n["server"].alias("server"), n["tool"].alias("tool")))


def snake_case(key: Column) -> Column:
    return F.lower(F.regexp_replace(key, r"([a-z0-9])([A-Z])", "$1_$2"))


def attributes(tag: Column) -> Column:
    """Attributes of an HTML tag's text as a map, names lower-cased, the last of a name kept."""
    group = lambda i: F.regexp_extract_all(tag, F.lit(fixed.HTML_ATTRIBUTE), F.lit(i))
    names = F.transform(group(1), F.lower)
    values = F.transform(F.arrays_zip(group(2).alias("a"), group(3).alias("b"), group(4).alias("c")), lambda v: F.concat(v["a"], v["b"], v["c"]))
    pairs = F.transform(F.arrays_zip(names.alias("k"), values.alias("v")), lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i")))
    last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"])))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def auth_scheme(value: Column) -> Column:
    head = F.lower(F.trim(value))
    return F.when(head.startswith("bearer"), "bearer").when(head.startswith("basic"), "basic").when(head.startswith("token"), "apikey").otherwise("unknown")


def key_role(key: Column, siblings: Column) -> Column:
    """``link``, ``weak`` or null for the key of a literal; ``siblings``: the other keys of its object, null for an argument."""
    plain = lambda k: F.regexp_replace(F.lower(F.regexp_replace(k, r"""^["'`]+|["'`]+\z""", "")), r"[-_\s]", "")
    request = F.exists(siblings, lambda s: plain(s).isin(fixed.REQUEST_KEYS))
    return F.when(plain(key).isin(fixed.LINK_KEYS), "link").when(plain(key).isin(fixed.WEAK_KEYS) & siblings.isNotNull() & ~request, "weak")


def shell_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def without_templates(code: Column) -> Column:
    """Server-side template tags as names of the same length, line ends kept, so that what stands behind keeps its place."""
    tag = r"(?s)\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|<\?(?:php|=).*?\?>"
    plain = F.split(code, tag, -1)
    names = F.transform(F.regexp_extract_all(code, F.lit(tag), F.lit(0)), lambda t: F.regexp_replace(t, r"[^\r\n]", "_"))
    return F.array_join(F.transform(plain, lambda p, i: F.concat(p, F.coalesce(F.get(names, i), F.lit("")))), "")
