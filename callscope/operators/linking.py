"""Files read alone, linked as tables: what one takes from another is filled in by joins on the module's path.

Front ends leave ``{import:module#name}`` in URLs and ``import:module#name`` as clients where a name
comes from another file, and give ``export`` rows for what theirs offer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.operators.tables import Scratch, materialize

def link(rows: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(path, line, client, method, url, headers, body_keys) of the calls among a front end's rows, over file borders.

    ``rows``: (path, kind, line, name, method, url, headers, body_keys). What files offer each other is
    settled first, however many files it goes through: names that are passed on point at what they name
    in log rounds, texts and clients made of others' are filled in from the inside out. Calls then meet
    settled names once for each that they hold. What cannot be found, or runs in a circle, stays a
    placeholder; calls on imported things that are no clients drop out. Exports grow with the files, so
    the joins merge: none is sent to the driver to be broadcast.
    """
    with Scratch(rows.sparkSession) as hold:
        rows = hold(rows, "front-end")
        calls = rows.filter("kind = 'call'").select("path", "line", F.col("name").alias("client"), "method", "url", "headers", "body_keys")
        exports = rows.filter("kind = 'export'").select(F.col("path").alias("x_path"), F.col("name").alias("x_name"), F.col("method").alias("x_kind"), F.col("url").alias("x_url"), F.col("headers").alias("x_client"))
        # A folder's index file stands for the folder; what it names itself is still seen from inside.
        stems = exports.withColumns({"x_stem": module_stem(F.col("x_path")), "x_from": module_stem(F.col("x_path"))}).drop("x_path")
        index = r"(?:^|/)(?:index|__init__)\z"
        stems = stems.union(stems.filter(F.col("x_stem").rlike(index)).withColumn("x_stem", F.regexp_replace("x_stem", index, "")))
        stems = settled(stems.dropDuplicates(["x_stem", "x_name", "x_kind"]), aliases, hold)
        calls = _link_clients(calls, stems, aliases)
        calls = hold(calls.filter(~F.col("client").startswith("import:")), "linked")
        while not calls.filter(F.col("url").contains("{import:")).isEmpty():
            new = hold(_fill(calls, "url", F.col("path"), stems, aliases), "linked")
            hold.drop(calls)
            calls = new
        return materialize(calls, "calls-linked")


def settled(stems: DataFrame, aliases: dict[str, str], hold: Scratch) -> DataFrame:
    """Exports (x_stem, x_name, x_kind, x_url, x_client, x_from) of kinds text and client alone, with nothing imported left in them."""
    stems = hold(_absolute(stems, aliases), "exports")
    sizes = stems.agg(F.count(F.when(F.col("x_kind") == "again", 1)), F.count(F.when(F.col("x_client").startswith("import:"), 1)), F.count(F.when(F.col("x_url").contains("{import:"), 1))).first()
    if sizes[0]:
        stems = hold(_passed_on(stems, sizes[0], hold), "exports")
    stems = stems.filter("x_kind <> 'again'")
    if sizes[2]:
        stems = _rounds(stems, _fill_texts, F.col("x_url").contains("{import:"), hold)
        # Only circles are left.
        stems = stems.withColumn("x_url", F.regexp_replace("x_url", r"\{import:[^#]*#(?:[^}.]*\.)*([^}.]*)\}", "{$1}"))
    if sizes[1]:
        stems = _rounds(stems, _base_clients, F.col("x_client").startswith("import:"), hold)
    return stems


def _absolute(stems: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """What an export imports by stems that do not hang on its own file."""
    module, rest = F.regexp_extract("x_client", r"^import:([^#]*)#", 1), F.regexp_extract("x_client", r"(#.*)\z", 1)
    client = F.when(F.col("x_client").startswith("import:"), F.concat(F.lit("import:/"), _target(F.col("x_from"), F.regexp_replace(module, "^/", ""), aliases), rest)).otherwise(F.col("x_client"))
    pieces = F.split("x_url", r"\{import:", -1)

    def hole(piece: Column, i: Column) -> Column:
        inner = F.regexp_replace(F.substring_index(piece, "#", 1), "^/", "")
        return F.when(i == 0, piece).otherwise(F.concat(F.lit("{import:/"), _target(F.col("x_from"), inner, aliases), F.substring(piece, F.instr(piece, "#"), F.length(piece))))

    return stems.withColumns({"x_client": client, "x_url": F.array_join(F.transform(pieces, hole), "")})


def _passed_on(stems: DataFrame, most: int, hold: Scratch) -> DataFrame:
    """Names that only pass on another file's, replaced by what they lead to: pointers jump to their target's target. Circles lead nowhere and drop out."""
    first = (F.regexp_extract("x_url", r"^\{import:/?([^#]*)#", 1), F.regexp_extract("x_url", r"#(.*)\}\z", 1))
    jumps = hold(stems.filter("x_kind = 'again'").select("x_stem", "x_name", first[0].alias("to_stem"), first[1].alias("to_name")).dropDuplicates(["x_stem", "x_name"]), "passed-on")
    for _ in range(max(1, most.bit_length())):
        further = jumps.select(F.col("x_stem").alias("to_stem"), F.col("x_name").alias("to_name"), F.col("to_stem").alias("_stem"), F.col("to_name").alias("_name"))
        met = jumps.join(further.hint("merge"), ["to_stem", "to_name"], "left")
        new = hold(met.select("x_stem", "x_name", F.coalesce("_stem", "to_stem").alias("to_stem"), F.coalesce("_name", "to_name").alias("to_name"), F.col("_stem").isNotNull().alias("moved")), "passed-on")
        hold.drop(jumps)
        jumps = new
        if jumps.filter("moved").isEmpty():
            break
    ends = stems.filter("x_kind <> 'again'").select(F.col("x_stem").alias("to_stem"), F.col("x_name").alias("to_name"), "x_kind", "x_url", "x_client", "x_from")
    found = jumps.join(ends.hint("merge"), ["to_stem", "to_name"]).select(*stems.columns)
    return stems.filter("x_kind <> 'again'").unionByName(found)


def _rounds(stems: DataFrame, step: Callable[[DataFrame], DataFrame], open_: Column, hold: Scratch) -> DataFrame:
    """``step`` until no open export is settled any more; those left wait for each other."""
    stems, before = hold(stems, "exports"), -1
    while True:
        left = stems.filter(open_).count()
        if left in (0, before):
            return stems
        new = hold(step(stems), "exports")
        hold.drop(stems)
        stems, before = new, left


def _fill_texts(stems: DataFrame) -> DataFrame:
    """Every hole that a settled text or no export at all stands for is filled; one round for each level of nesting and hole of a text."""
    at = (F.regexp_extract("x_url", r"\{import:/?([^#}]*)#", 1), F.regexp_extract("x_url", r"\{import:[^#]*#([^}]*)\}", 1))
    keyed = stems.withColumns({"_stem": F.when(F.col("x_url").contains("{import:"), at[0]), "_name": at[1]})
    texts = stems.filter("x_kind = 'text'").dropDuplicates(["x_stem", "x_name"]).select(F.col("x_stem").alias("_stem"), F.col("x_name").alias("_name"), F.col("x_url").alias("_text"))
    met = keyed.join(texts.hint("merge"), ["_stem", "_name"], "left")
    waits = F.coalesce(F.col("_text").contains("{import:"), F.lit(False))
    hole = F.concat(F.lit("{import:/"), F.col("_stem"), F.lit("#"), F.col("_name"), F.lit("}"))
    told = F.coalesce("_text", F.concat(F.lit("{"), F.regexp_extract("_name", r"([^.]*)\z", 1), F.lit("}")))
    return met.withColumn("x_url", F.when(F.col("_stem").isNull() | waits, F.col("x_url")).otherwise(F.replace(F.col("x_url"), hole, told))).select(*stems.columns)


_WHOLE_URL = r"(?i)^[a-z][a-z0-9+.-]*://"


def _joined(base: Column, url: Column) -> Column:
    """``url`` below ``base``, unless it is whole or there is no base."""
    below = (F.coalesce(base, F.lit("")) != "") & ~url.rlike(_WHOLE_URL)
    return F.when(below, F.concat(F.regexp_replace(base, r"/+\z", ""), F.lit("/"), F.regexp_replace(url, "^/+", ""))).otherwise(url)


def _base_clients(stems: DataFrame) -> DataFrame:
    """Clients made from a settled client of another file take its kind and stand below its base."""
    at = (F.regexp_extract("x_client", r"^import:/?([^#]*)#", 1), F.regexp_extract("x_client", r"#(.*)\z", 1))
    keyed = stems.withColumns({"_stem": F.when(F.col("x_client").startswith("import:"), at[0]), "_name": at[1]})
    clients = stems.filter("x_kind = 'client' and not x_client like 'import:%'").dropDuplicates(["x_stem", "x_name"]).select(F.col("x_stem").alias("_stem"), F.col("x_name").alias("_name"), F.col("x_url").alias("_base"), F.col("x_client").alias("_client"))
    met = keyed.join(clients.hint("merge"), ["_stem", "_name"], "left")
    url = F.when(F.coalesce("x_url", F.lit("")) == "", F.col("_base")).otherwise(_joined(F.col("_base"), F.col("x_url")))
    return met.withColumns({"x_client": F.coalesce("_client", "x_client"), "x_url": F.when(F.col("_client").isNotNull(), url).otherwise(F.col("x_url"))}).select(*stems.columns)


def module_stem(path: Column) -> Column:
    """A path without its script ending."""
    return F.regexp_replace(path, r"(?:\.d)?\.[cm]?[jt]sx?\z|\.pyi?\z", "")


def _target(path: Column, module: Column, aliases: dict[str, str]) -> Column:
    """The stem that a module named in a file leads to: relative ones by the file's folder; others as they are, or as an alias has it."""
    for prefix, folder in aliases.items():
        module = F.when(module.startswith(prefix), F.concat(F.lit(folder), F.substring(module, len(prefix) + 1, F.length(module)))).otherwise(module)
    folder = F.regexp_replace(path, r"[^/]*\z", "")
    joined = F.concat(folder, module_stem(module))
    parts = F.filter(F.split(joined, "/"), lambda x: ~x.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.when(module.startswith("."), F.array_join(up, "/")).otherwise(module_stem(module))


def _link_clients(calls: DataFrame, stems: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Calls on an imported client get the client and base that the other file exports under the name."""
    module, name = F.regexp_replace(F.regexp_extract("client", r"^import:([^#]*)#", 1), "^/", ""), F.regexp_extract("client", r"#(.*)\z", 1)
    open_ = F.col("client").startswith("import:")
    keyed = calls.withColumns({"_stem": F.when(open_, _target(F.col("path"), module, aliases)), "_name": F.when(open_, name)})
    kinds = stems.filter("x_kind = 'client'").dropDuplicates(["x_stem", "x_name"]).select(F.col("x_stem").alias("_stem"), F.col("x_name").alias("_name"), F.col("x_url").alias("_base"), F.col("x_client").alias("_client"))
    met = keyed.join(kinds.hint("merge"), ["_stem", "_name"], "left")
    return met.withColumns({"client": F.coalesce("_client", "client"), "url": _joined(F.col("_base"), F.col("url"))}).select(*calls.columns)


def _fill(calls: DataFrame, column: str, path: Column, stems: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """The first open text of a URL is filled with what the other file exports, or named where it exports none."""
    module, name = F.regexp_extract(column, r"\{import:([^#}]*)#", 1), F.regexp_extract(column, r"\{import:[^#}]*#([^}]*)\}", 1)
    open_ = F.col(column).contains("{import:")
    keyed = calls.withColumns({"_module": module, "_stem": F.when(open_, _target(path, F.regexp_replace(module, "^/", ""), aliases)), "_name": name})
    texts = stems.filter("x_kind = 'text'").dropDuplicates(["x_stem", "x_name"]).select(F.col("x_stem").alias("_stem"), F.col("x_name").alias("_name"), F.col("x_url").alias("_text"))
    met = keyed.join(texts.hint("merge"), ["_stem", "_name"], "left")
    hole = F.concat(F.lit("{import:"), F.col("_module"), F.lit("#"), F.col("_name"), F.lit("}"))
    told = F.coalesce("_text", F.concat(F.lit("{"), F.regexp_extract("_name", r"([^.]*)\z", 1), F.lit("}")))
    filled = F.replace(F.col(column), hole, told)
    # A hole of another form is no name.
    filled = F.when(filled == F.col(column), F.regexp_replace(column, r"\{import:", "{")).otherwise(filled)
    return met.withColumn(column, F.when(open_, filled).otherwise(F.col(column))).select(*calls.columns)
