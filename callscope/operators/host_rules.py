"""Which hosts named in a text are APIs: a table of rules that facts about hosts and paths are joined to.

A fact is a kind and a value, ``under`` and ``w3.org``, say. A rule states what a fact says for a
question, and how much it counts; the rule of least rank decides. All knowledge is rows, so the order
of rules is data and the table can grow; only the facts are worked out by expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import fixed, hosts

#: Questions that rules answer.
API, BARE, NO_CALL = "api", "bare", "no-call"
#: A rule with this rank settles nothing; it lifts the rules marked ``unless_known`` for its host.
KNOWN = 0

#: Patterns behind the facts of kind ``shape``: name, what they are matched against, the pattern.
_SHAPES = [
    ("asset", "route", fixed.ASSET_PATH),
    ("authorize", "route", fixed.OAUTH_AUTHORIZE),
    ("authorize", "path", r"(?i)[?&]response_type="),
    ("versioned", "path", fixed.API_PATH),
]


def rules(spark: SparkSession) -> DataFrame:
    """The fixed rules: (question, kind, value, rank, verdict, unless_known)."""
    rows: list[tuple[str, str, str, int, bool, bool]] = []

    def say(question: str, rank: int, verdict: bool, kind: str, values: list[str], unless_known: bool = False) -> None:
        rows.extend((question, kind, v, rank, verdict, unless_known) for v in values)

    exact = [h for h, _ in fixed.PROVIDER_HOSTS if not h.startswith(".")] + [g for g in fixed.GATEWAYS if not g.startswith(".")]
    below = [h for h, _ in fixed.PROVIDER_HOSTS if h.startswith(".")] + [g for g in fixed.GATEWAYS if g.startswith(".")]
    no_call = [("shape", ["authorize", "scope", "fill-in"]), ("opens", fixed.DOC_FIRST)]
    say(API, KNOWN, True, "host", [h for h, _ in fixed.PROVIDER_HOSTS if not h.startswith(".")])
    say(API, 10, False, "shape", ["private", "asset"])
    for kind, values in no_call:
        say(API, 10, False, kind, values)
        say(NO_CALL, 10, True, kind, values)
    say(API, 20, False, "shape", ["placeholder"], unless_known=True)
    say(API, 20, False, "under", fixed.NOISE_DOMAINS, unless_known=True)
    say(API, 20, False, "first", fixed.NOISE_LABELS, unless_known=True)
    say(API, 20, False, "word", fixed.DOC_WORDS, unless_known=True)
    say(API, 30, True, "code-api", fixed.CODE_HOSTS)
    say(API, 31, False, "site", fixed.CODE_HOSTS)
    say(API, 40, True, "shape", ["versioned"])
    say(API, 50, False, "shape", ["front page"])
    say(API, 60, True, "host", exact)
    say(API, 60, True, "below", below)
    say(API, 60, True, "shape", ["api label"])
    # Without a scheme only known hosts count, and API labels under common top-level domains.
    say(BARE, 10, True, "host", exact)
    say(BARE, 10, True, "below", below)
    say(BARE, 10, True, "api tld", fixed.BARE_TLDS)
    return spark.createDataFrame(rows, "question string, kind string, value string, rank int, verdict boolean, unless_known boolean")


def facts(host: Column, path: Column) -> Column:
    """Array of (kind, value): what holds of a host, lower-cased and without port, and the path behind it."""
    route = F.regexp_replace(path, r"(?s)[?#].*\z", "")
    labels = hosts.labels(host)
    first, last = labels[0], F.element_at(labels, -1)
    site = hosts.registrable_domain(host)
    at_site = host.isin(site) | (host == F.concat(F.lit("www."), site))
    api_label = first.rlike(r"^api(?:-.*)?\z|-api\z")
    public = host.rlike(r"\.") & (F.length(host) <= 253) & ~F.exists(labels, lambda x: ~x.rlike(fixed.HOST_LABEL)) & last.rlike(fixed.TLD) & ~last.isin(fixed.INTERNAL_TLDS) & ~hosts.is_localhost(host)
    parts = F.transform(F.filter(F.split(route, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, r"^[{<\[]+|[}>\]]+\z", ""))
    opening = F.lower(F.get(parts, F.when(F.get(parts, F.lit(0)).rlike(fixed.LOCALE) & (F.size(parts) > 1), 1).otherwise(0)))
    scope = (host.endswith(".googleapis.com") & route.rlike(fixed.GOOGLE_SCOPE)) | ((host == "graph.microsoft.com") & route.rlike(fixed.GRAPH_SCOPE))
    shapes = [
        ("private", ~public),
        ("scope", scope),
        ("fill-in", host.rlike(fixed.GENERIC_CLOUD) & F.exists(parts, lambda x: x.rlike(fixed.FILL_IN))),
        ("placeholder", F.exists(labels, lambda x: x.rlike(fixed.PLACEHOLDER_LABEL))),
        ("front page", at_site & ~api_label),
        ("api label", api_label),
        *((name, (route if of == "route" else path).rlike(pattern)) for name, of, pattern in _SHAPES),
    ]

    def fact(kind: str, value: Column, holds: Column | None = None) -> Column:
        row = F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        return row if holds is None else F.when(holds, row)

    def many(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    one = F.array(
        fact("host", host),
        fact("first", first),
        fact("opens", opening, opening.isNotNull()),
        fact("site", site, at_site),
        fact("code-api", site, at_site & path.rlike(fixed.CODE_HOST_API)),
        fact("api tld", last, api_label),
        *[fact("shape", F.lit(name), holds) for name, holds in shapes],
    )
    under = hosts.suffixes(host)
    above = F.transform(F.slice(under, F.lit(2), F.size(under)), lambda d: F.concat(F.lit("."), d))
    return F.array_compact(F.concat(one, many("under", under), many("below", above), many("word", F.split(first, "-"))))


def judge(rows: DataFrame, table: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """``rows`` with ``api`` (the host and path look like an API's), ``bare_api`` (also without a scheme) and ``no_call``.

    Distinct pairs of host and path are judged once: their facts meet the rules in one equi-join, and
    minima by rank are taken before rows move. Pairs without a matching rule get false; null hosts get
    null.
    """
    pairs = rows.select(F.col(host).alias("_h"), F.coalesce(F.col(path), F.lit("")).alias("_p")).filter("_h is not null").distinct()
    met = pairs.select("_h", "_p", F.explode(facts(F.col("_h"), F.col("_p"))).alias("f")).join(table.select(F.struct("kind", "value").alias("f"), "question", "rank", "verdict", "unless_known"), "f")
    rule = F.struct("rank", "verdict")
    of = lambda question, extra=F.lit(True): F.min(F.when((F.col("question") == question) & (F.col("rank") > KNOWN) & extra, rule))["verdict"]
    best = met.groupBy("_h", "_p").agg(
        F.bool_or((F.col("question") == API) & (F.col("rank") == KNOWN)).alias("known"),
        of(API).alias("plain"),
        of(API, ~F.col("unless_known")).alias("lifted"),
        of(BARE).alias("bare"),
        of(NO_CALL).alias("none"),
    )
    api = F.coalesce(F.when(F.col("known"), F.col("lifted")).otherwise(F.col("plain")), F.lit(False))
    judged = pairs.join(best, ["_h", "_p"], "left").select("_h", "_p", api.alias("api"), (api & F.coalesce("bare", F.lit(False))).alias("bare_api"), F.coalesce("none", F.lit(False)).alias("no_call"))
    return rows.join(judged, (rows[host] == judged["_h"]) & (F.coalesce(rows[path], F.lit("")) == judged["_p"]), "left").drop("_h", "_p")
