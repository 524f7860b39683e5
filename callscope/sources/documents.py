"""Configuration documents as rows of values: JSON with comments, TOML, a plain subset of YAML, Spring settings, manifests."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions import text
from callscope.operators.frontend import scan_files
from callscope.sources.config import CONFIG_BYTES, directory

#: Lines of a YAML file that are read.
YAML_LINES = 20_000

Value = tuple[str, str | None, str, int]  # key path, text, kind, line


def flat(value: object, key: str = "") -> Iterator[tuple[str, object]]:
    """(key path, scalar) of nested values: ``a.b[0].c``."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flat(v, f"{key}.{k}" if key else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from flat(v, f"{key}[{i}]")
    else:
        yield key, value


def scalar(value: object) -> tuple[str | None, str]:
    if value is None:
        return None, "null"
    if isinstance(value, bool):
        return str(value).lower(), "boolean"
    return str(value), "number" if isinstance(value, int | float) else "string"


_COMMENT = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.DOTALL)


def json_values(body: str) -> list[Value]:
    """Values of JSON with comments and trailing commas; comments go with their line ends kept, so lines hold."""
    plain = _COMMENT.sub(lambda m: m[1] or re.sub(r"[^\n]", " ", m[0]), body)
    plain = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or " ", plain)
    return list(_placed(json.loads(plain), plain, lambda k: json.dumps(k, ensure_ascii=False)))


def toml_values(body: str) -> list[Value]:
    return list(_placed(tomllib.loads(body), body, lambda k: k))


def _placed(value: object, body: str, written) -> Iterator[Value]:
    """Values with the line where their last key stands: keys are looked for in the order of the document."""
    at = 0
    for key, leaf in flat(value):
        name = re.sub(r"\[\d+\]", "", key).rpartition(".")[2]
        found = body.find(written(name), at)
        at = found if found >= 0 else at
        told, kind = scalar(leaf)
        yield key, told, kind, body.count("\n", 0, at) + 1


_KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s#'"\[\]{},&*!|>%@`-][^#]*?|-[^\s#:][^#]*?))\s*:(?:\s+|\Z)""")


def _bare(line: str) -> str:
    """A line without its comment."""
    quote = None
    for i, c in enumerate(line):
        if quote:
            quote = None if c == quote and line[i - 1] != "\\" else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " \t[{,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


def _yaml_scalar(word: str) -> object:
    if word in ("", "~", "null", "Null", "NULL"):
        return None
    if word[0] == '"' and word[-1] == '"' and len(word) > 1:
        try:
            return json.loads(word)
        except ValueError:
            return word[1:-1]
    if word[0] == "'" and word[-1] == "'" and len(word) > 1:
        return word[1:-1].replace("''", "'")
    if word.lower() in ("true", "false"):
        return word.lower() == "true"
    if re.fullmatch(r"[-+]?\d+", word):
        return int(word)
    return float(word) if re.fullmatch(r"[-+]?\d+\.\d*(?:[eE][-+]?\d+)?", word) else word


def _flow(word: str) -> object:
    """A value in brackets; nested ones too. What does not close is text."""
    at = 0

    def skip() -> None:
        nonlocal at
        while at < len(word) and word[at] in " \t\n":
            at += 1

    def one(stops: str) -> object:
        nonlocal at
        skip()
        if word[at : at + 1] == "[":
            at, out = at + 1, []
            while True:
                skip()
                if word[at : at + 1] == "]":
                    at += 1
                    return out
                out.append(one(",]"))
                skip()
                if word[at : at + 1] == ",":
                    at += 1
                elif word[at : at + 1] != "]":
                    raise ValueError(word)
        if word[at : at + 1] == "{":
            at, made = at + 1, {}
            while True:
                skip()
                if word[at : at + 1] == "}":
                    at += 1
                    return made
                key = one(":,}")
                skip()
                if word[at : at + 1] == ":":
                    at += 1
                    made[str(key)] = one(",}")
                else:
                    made[str(key)] = None
                skip()
                if word[at : at + 1] == ",":
                    at += 1
                elif word[at : at + 1] != "}":
                    raise ValueError(word)
        m = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'').match(word, at)
        if m:
            at = m.end()
            return _yaml_scalar(m[0])
        start = at
        while at < len(word) and word[at] not in stops:
            at += 1
        return _yaml_scalar(word[start:at].strip())

    value = one("")
    return value


def yaml_documents(body: str) -> list[list[Value]]:
    """Values of each document of a YAML file: maps, lists, scalars, blocks of text and bracketed values by indentation.

    Anchors, aliases, tags and merges are not followed; such values are left out. Files beyond
    ``YAML_LINES`` lines give nothing.
    """
    lines = body.split("\n")
    if len(lines) > YAML_LINES:
        raise ValueError("too many lines")
    documents: list[list[Value]] = [[]]
    # Open levels: indentation, key path, and the next index of a list.
    levels: list[list] = [[-1, "", None]]
    i = 0

    def say(key: str, word: str, line: int, indent: int) -> int:
        """Put a value down; returns the lines taken behind its own."""
        nonlocal i
        if re.match(r"[|>][-+0-9]*\Z", word):
            held, k = [], i + 1
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > indent):
                held.append(lines[k])
                k += 1
            pad = min((len(x) - len(x.lstrip()) for x in held if x.strip()), default=0)
            cut = [x[pad:].rstrip() for x in held]
            while cut and not cut[-1]:
                cut.pop()
            documents[-1].append((key, ("\n" if word[0] == "|" else " ").join(cut), "string", line))
            return k - i - 1
        if word[:1] in "[{":
            whole, k = word, i + 1
            while whole.count("[") + whole.count("{") > whole.count("]") + whole.count("}") and k < len(lines):
                whole += " " + _bare(lines[k]).strip()
                k += 1
            try:
                documents[-1].extend((p, *scalar(v), line) for p, v in flat(_flow(whole), key))
            except (ValueError, IndexError):
                documents[-1].append((key, whole, "string", line))
            return k - i - 1
        if word[:1] not in "&*!":
            documents[-1].append((key, *scalar(_yaml_scalar(word)), line))
        return 0

    while i < len(lines):
        bare = _bare(lines[i])
        if bare.strip() in ("---", "...") or bare.startswith("--- "):
            documents.append([])
            levels = [[-1, "", None]]
            i += 1
            continue
        rest, indent = bare.lstrip(" "), len(bare) - len(bare.lstrip(" "))
        if not rest or rest.startswith("%"):
            i += 1
            continue
        taken = 0
        while True:
            item = rest == "-" or rest.startswith("- ")
            # A list may stand at the indentation of its key.
            while len(levels) > 1 and (levels[-1][0] > indent or levels[-1][0] == indent and not item):
                levels.pop()
            if item:
                if levels[-1][2] is None or levels[-1][0] != indent:
                    levels.append([indent, levels[-1][1], 0])
                base = f"{levels[-1][1]}[{levels[-1][2]}]"
                levels[-1][2] += 1
                inner = rest[1:].lstrip(" ")
                indent += len(rest) - len(inner)
                rest = inner
                levels.append([indent - 1, base, None])
                if not rest:
                    levels[-1][0] = indent - 0.5  # deeper than the list, above whatever follows
                    break
                if not (rest.startswith("- ") or _KEY.match(rest)):
                    taken = say(base, rest, i + 1, indent - 2)
                    break
                continue
            m = _KEY.match(rest)
            if m:
                name = m[1] if m[1] is not None else m[2] if m[2] is not None else m[3].strip()
                key = f"{levels[-1][1]}.{name}" if levels[-1][1] else name
                word = rest[m.end() :].strip()
                levels.append([indent, key, None])
                if word and name != "<<":
                    taken = say(key, word, i + 1, indent)
            break
        i += 1 + taken
    return [d for d in documents if d] or [[]]


def values_of(path: str, body: str) -> list[tuple]:
    """(doc, key, value, kind, line, problem) of a configuration file, by its ending."""
    try:
        if re.search(r"\.ya?ml\Z", path):
            return [(n, *v, None) for n, d in enumerate(yaml_documents(body)) for v in d]
        if path.endswith(".toml"):
            return [(0, *v, None) for v in toml_values(body)]
        if re.search(r"\.jsonc?\Z|\.json5\Z", path):
            return [(0, *v, None) for v in json_values(body)]
    except (ValueError, RecursionError) as e:
        return [(0, None, None, None, getattr(e, "lineno", None), "too-large" if str(e) == "too many lines" else "parse-error")]
    return []


def document_values(files: DataFrame) -> DataFrame:
    """(path, doc, key, value, kind, line, problem): every scalar of the JSON, TOML and YAML files up to 4 MB; a broken file gives one row that says so."""
    return scan_files(files.filter(F.octet_length("body") <= CONFIG_BYTES), values_of, "doc long, key string, value string, kind string, line long, problem string")


def resolved(src, literal):
    """The path that a literal names from a file's folder."""
    joined = F.concat_ws("/", F.nullif(directory(src), F.lit("")), literal)
    parts = F.filter(F.split(joined, "/"), lambda s: ~s.isin("", "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when((s == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s)))), "/")


def loaded_documents(reads: DataFrame, files: DataFrame) -> DataFrame:
    """(src, key, value): values of configuration that code loads by a literal path, whatever its format. ``reads``: (src, literal, key)."""
    wanted = reads.withColumn("target", resolved(F.col("src"), F.col("literal")))
    values = document_values(files.join(wanted.select(F.col("target").alias("path")).distinct(), "path", "left_semi")).filter("key is not null")
    found = values.groupBy(F.col("path").alias("target"), "key").agg(F.min_by("value", "doc").alias("value"))
    return wanted.join(found, ["target", "key"], "left").select("src", "key", "value")


_PROPERTY = re.compile(r"\s*([^#!=:\s][^=:]*?)\s*[=:]\s*(.*?)\s*\Z")


def spring_rows(path: str, body: str) -> list[tuple]:
    """(doc, key, value, line) of an ``application`` file or of one that such a file imports."""
    if path.endswith(".properties"):
        out, doc = [], 0
        for n, line in enumerate(body.split("\n"), 1):
            if line.strip() in ("#---", "!---"):
                doc += 1
            elif m := _PROPERTY.match(line):
                out.append((doc, m[1], m[2], n))
        return out
    try:
        return [(n, k, v, line) for n, d in enumerate(yaml_documents(body)) for k, v, _, line in d]
    except ValueError:
        return []


def relaxed(key):
    """A key as Spring compares it: case, dashes and underscores do not matter."""
    return F.lower(F.regexp_replace(key, "[-_]", ""))


def spring_values(files: DataFrame, profiles: list[str]) -> DataFrame:
    """(key, value): Spring settings of ``application`` files, ``.properties`` and YAML, under active profiles.

    A file or document of a profile counts only if it is active, and overrides plain ones; later
    profiles override earlier ones, later documents of a file earlier ones. Files that an active
    document imports override it; imports go one file deep.
    """
    rows = scan_files(files.filter(F.col("path").rlike(r"\.(?:properties|ya?ml)\z")), spring_rows, "doc long, key string, value string, line long")
    profile = F.nullif(F.regexp_extract("path", r"application-([\w-]+)\.\w+\z", 1), F.lit(""))
    own = F.max(F.when(relaxed(F.col("key")).isin("spring.config.activate.onprofile", "spring.profiles"), F.col("value")))
    rank = F.when(F.col("profile").isNull(), 0)
    for i, p in enumerate(profiles):
        rank = rank.when(F.col("profile") == p, i + 1)
    documents = rows.groupBy("path", "doc").agg(own.alias("said"), F.collect_set(F.when(relaxed(F.regexp_replace("key", r"\[\d+\]\z", "")) == "spring.config.import", F.col("value"))).alias("imports"))
    documents = documents.withColumn("profile", F.coalesce("said", profile)).withColumn("rank", rank)
    main = F.col("path").rlike(r"(?:^|/)application(?:-[\w-]+)?\.\w+\z")
    active = documents.filter(main & F.col("rank").isNotNull()).select("path", "doc", "rank", "imports")
    named = F.regexp_replace(F.regexp_replace("imports", r"^(?:optional:)?(?:classpath:|file:)?/*(?:\./)?", ""), r"\[\.\w+\]\z", "")
    each = active.withColumn("imports", F.explode(F.flatten(F.transform("imports", lambda x: F.split(x, r"\s*[,;]\s*")))))
    imported = each.select(F.concat(F.regexp_extract("path", r"^(.*/)?[^/]*\z", 1), named).alias("path"), "rank", F.col("doc").alias("by"))
    values = rows.select("path", "doc", relaxed(F.col("key")).alias("key"), "value", "line")
    direct = values.join(active.drop("imports"), ["path", "doc"]).select("key", "value", F.struct("rank", F.lit(0).alias("in"), "path", "doc", "line").alias("at"))
    second = values.join(imported, "path").select("key", "value", F.struct("rank", F.lit(1).alias("in"), "path", "doc", "line").alias("at"))
    return direct.union(second).groupBy("key").agg(F.max_by("value", "at").alias("value"))


_REQUIREMENT = re.compile(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;#]*)")
_GRADLE = re.compile(r"""\b(?:implementation|api|compileOnly|runtimeOnly|testImplementation|kapt|ksp|annotationProcessor|compile)\s*\(?\s*["']([^"':\s]+):([^"':\s]+)(?::([^"'\s]+))?["']""")
_POM = re.compile(r"<dependency>(.*?)</dependency>", re.DOTALL)


def manifest_rows(path: str, body: str) -> list[tuple]:
    """(ecosystem, package, version) of a manifest, by its name; broken ones give no rows."""
    name = path.rsplit("/", 1)[-1]
    try:
        if name == "pyproject.toml":
            return list(_pyproject(tomllib.loads(body)))
        if name == "Cargo.toml":
            data = tomllib.loads(body)
            return [("crates", v.get("package", k) if isinstance(v, dict) else k, (v.get("version") if isinstance(v, dict) else v) or "") for s in ("dependencies", "dev-dependencies", "build-dependencies") for k, v in data.get(s, {}).items()]
        if name == "pubspec.yaml":
            found = [(k.split(".", 2)[1], v if k.count(".") == 1 else "") for d in yaml_documents(body) for k, v, _, _ in d if re.match(r"(?:dev_)?dependencies\.", k)]
            bare = [(m[1], "") for m in re.finditer(r"(?m)^  ([a-z]\w*):\s*$", body)]
            return [("pub", k, v or "") for k, v in dict([*[b for b in bare if any(b[0] == k for k, _ in found)], *found]).items()]
        if re.fullmatch(r"build\.gradle(?:\.kts)?", name):
            return [("maven", f"{m[1]}:{m[2]}", m[3] or "") for m in _GRADLE.finditer(re.sub(r"//[^\n]*|/\*.*?\*/", "", body, flags=re.DOTALL))]
        if name == "pom.xml":
            one = lambda block, tag: m[1].strip() if (m := re.search(rf"<{tag}>(.*?)</{tag}>", block, re.DOTALL)) else ""
            blocks = _POM.findall(re.sub(r"<!--.*?-->", "", body, flags=re.DOTALL))
            return [("maven", f"{one(b, 'groupId')}:{one(b, 'artifactId')}", one(b, "version")) for b in blocks]
        if name.endswith(".versions.toml"):
            data = tomllib.loads(body)
            versions = data.get("versions", {})
            return [r for v in data.get("libraries", {}).values() if (r := _catalog(v, versions))]
    except (ValueError, AttributeError, TypeError):
        return []
    return []


def _pyproject(data: dict) -> Iterator[tuple]:
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    lines = [*project.get("dependencies", []), *(x for group in project.get("optional-dependencies", {}).values() for x in group), *(x for group in data.get("dependency-groups", {}).values() for x in group if isinstance(x, str))]
    for line in lines:
        if m := _REQUIREMENT.match(line):
            yield "pypi", m[1], m[2].strip().removeprefix("==").strip()
    groups = [poetry.get("dependencies", {}), poetry.get("dev-dependencies", {}), *(g.get("dependencies", {}) for g in poetry.get("group", {}).values())]
    for group in groups:
        for k, v in group.items():
            if k != "python":
                yield "pypi", k, (v.get("version", "") if isinstance(v, dict) else v) or ""


def _catalog(entry: object, versions: dict) -> tuple | None:
    """A library of a version catalog: ``group:name:version``, or a table of these."""
    if isinstance(entry, str):
        group, name, version = (entry.split(":") + ["", ""])[:3]
        return "maven", f"{group}:{name}", version
    module = entry.get("module") or f"{entry['group']}:{entry['name']}"
    version = entry.get("version", "")
    if isinstance(version, dict):
        version = versions.get(version.get("ref"), "")
    return "maven", module, version if isinstance(version, str) else ""


def more_manifests(files: DataFrame) -> DataFrame:
    """(dir, ecosystem, package, version) of pyproject.toml, Cargo.toml, pubspec.yaml, Gradle files and catalogs and pom.xml."""
    known = F.col("path").rlike(r"(?:^|/)(?:pyproject\.toml|Cargo\.toml|pubspec\.yaml|build\.gradle(?:\.kts)?|pom\.xml|[\w.-]*\.versions\.toml)\z")
    rows = scan_files(files.filter(known), manifest_rows, "ecosystem string, package string, version string")
    return rows.select(directory(F.col("path")).alias("dir"), "ecosystem", text.normalise_package(F.col("ecosystem"), F.col("package")).alias("package"), "version")


def changed_files(lines: DataFrame) -> DataFrame:
    """(path, status) of ``git diff --name-status`` lines: renames count as a deletion and an addition. ``lines``: (line)."""
    parts = F.split("line", "\t")
    status = F.substring(parts[0], 1, 1)
    plain = F.array(F.struct(parts[1].alias("path"), status.alias("status")))
    moved = F.array(F.struct(parts[1].alias("path"), F.lit("D").alias("status")), F.struct(F.try_element_at(parts, F.lit(3)).alias("path"), F.lit("A").alias("status")))
    copied = F.array(F.struct(F.try_element_at(parts, F.lit(3)).alias("path"), F.lit("A").alias("status")))
    told = lines.filter(F.size(parts) >= 2).select(F.explode(F.when(status == "R", moved).when(status == "C", copied).otherwise(plain)).alias("c"))
    return told.select("c.*").filter("path is not null").distinct()
