"""Small facts of a call, each from a few alternatives: method, branch, template, injected value, model, detector, protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def method(implied: Column, said: Column) -> Column:
    """The method that a function's name implies, else the one that is said, upper-cased; ``DYNAMIC`` where that is computed or missing."""
    return F.coalesce(implied, F.when(~said.contains("{"), F.upper(said)), F.lit("DYNAMIC"))


def pick_branch(a: Column, b: Column) -> Column:
    """Of two texts that a condition chooses from: both static, the first; else the one with a written host; else the one led by a base; else none."""
    host = lambda c: c.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^{/]+")
    base = lambda c: c.rlike(r"^\{env:")
    return F.when(~a.contains("{") & ~b.contains("{"), a).when(host(a), a).when(host(b), b).when(base(a), a).when(base(b), b)


def form_keys(body: Column) -> Column:
    """Distinct names of a form text, in order; pairs without a name are none."""
    return F.array_distinct(F.transform(_pairs(body), lambda p: F.split_part(p, F.lit("="), F.lit(1))))


def form_static(body: Column) -> Column:
    """The pairs of a form text whose value is written out."""
    return F.filter(_pairs(body), lambda p: p.contains("=") & ~p.contains("{"))


def _pairs(body: Column) -> Column:
    return F.filter(F.split(body, "&"), lambda p: (p != "") & ~p.startswith("="))


def fill_template(path: Column, names: Column, values: Column) -> Column:
    """``{name}`` of a template replaced by the value at the name's place; others stay."""
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    return F.aggregate(pairs, path, lambda p, e: F.replace(p, F.concat(F.lit("{"), e["k"], F.lit("}")), e["v"]))


def table_reads(reads: DataFrame, entries: DataFrame) -> DataFrame:
    """(call, host): a read with a known key takes its entry, one with an unknown key all of its table's.

    ``reads``: (call, table, key), key null where it is not known; ``entries``: (table, name, host).
    Both kinds are equi-joins, so that one with a wide table can be split.
    """
    known = reads.filter("key is not null").join(entries.withColumnRenamed("name", "key"), ["table", "key"]).select("call", "host")
    return known.union(reads.filter("key is null").join(entries, "table").select("call", "host"))


def injected(points: DataFrame, provided: DataFrame) -> DataFrame:
    """(id, value): what exactly one provider gives for a type, or for a type under a qualifier.

    ``points``: (id, type, qualifier), ids distinct; ``provided``: (type, qualifier, value). Providers
    are counted by type and by qualifier before they meet points, so a type that many provide is one row.
    """
    one = lambda *by: provided.groupBy(*by).agg(F.min("value").alias("value"), F.count("*").alias("n")).filter("n = 1").drop("n")
    plain = points.filter("qualifier is null").join(one("type"), "type").select("id", "value")
    return plain.union(points.filter("qualifier is not null").join(one("type", "qualifier"), ["type", "qualifier"]).select("id", "value"))


def model_facts(models: DataFrame) -> DataFrame:
    """(call, values, source, dynamic): distinct model names of a call in first-seen order; a literal source beats others, then the first.

    ``models``: (call, ord, value, origin, dynamic). Repeats are gone before names are listed.
    """
    first = models.filter("value is not null").groupBy("call", "value").agg(F.min("ord").alias("ord"))
    names = first.groupBy("call").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("values"))  # of one call
    rest = models.groupBy("call").agg(F.min_by("origin", F.struct(F.col("origin") != "literal", "ord")).alias("source"), F.bool_or("dynamic").alias("dynamic"))
    return rest.join(names, "call", "left").select("call", F.coalesce("values", F.array().cast("array<string>")).alias("values"), "source", "dynamic")


def first_detector(found: DataFrame) -> DataFrame:
    """(call, client): what the detector that comes first says of a call. ``found``: (call, detector, client)."""
    return found.groupBy("call").agg(F.min_by("client", "detector").alias("client"))


def dispatch(operations: DataFrame) -> DataFrame:
    """(call, name, protocol): the first protocol that names an operation; SDK calls have their own. ``operations``: (call, rpc, graphql, soap, action, sdk)."""
    said = {"json-rpc": "rpc", "graphql": "graphql", "soap": "soap", "action": "action"}
    protocol = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(p)) for p, c in said.items()])
    return operations.filter("not sdk").select("call", F.coalesce(*said.values()).alias("name"), protocol.alias("protocol")).filter("name is not null")


def xml_root(body: Column) -> Column:
    """Name of the root element of an XML text; null for HTML, SVG and anything else."""
    root = F.regexp_extract(body, r"^\s*(?:<\?xml[^>]*\?>\s*)?<([A-Za-z_][\w.:-]*)", 1)
    return F.when(~F.lower(root).isin("", "html", "svg"), root)


# Methods that a SOAP client has itself, whatever its service declares.
CLIENT_METHODS = [
    "addBodyAttribute", "addHttpHeader", "addListener", "addSoapHeader", "changeSoapHeader", "clearBodyAttributes", "clearHttpHeaders", "clearSoapHeaders", "describe", "emit",
    "getBodyAttributes", "getHttpHeaders", "getSoapHeaders", "off", "on", "once", "removeAllListeners", "removeListener", "setEndpoint", "setSOAPAction", "setSecurity",
]


def soap_client_calls(calls: DataFrame, clients: DataFrame, services: DataFrame) -> DataFrame:
    """(call, operation, declared, url): calls on SOAP clients, joined to what their service's description declares.

    ``calls``: (call, client, chain), the members called through; ``clients``: (client, path, endpoint),
    the description a client was made from and the address it was given, if any; ``services``: (path,
    operation, address) as ``config.wsdl`` gives them. An operation is called as ``client.Op``,
    ``client.OpAsync`` or ``client.Service.Port.Op``; a client's own methods are none. The given address
    counts before the declared one; without a readable description nothing is declared.
    """
    members = F.split("chain", r"\.")
    last, n = F.element_at(members, -1), F.size(members)
    op = F.regexp_replace(last, r"(?<=.)Async\z", "")
    named = ((n == 3) | ((n == 1) & ~last.isin(CLIENT_METHODS))) & op.rlike(r"^[A-Za-z_][\w.-]*\z")
    made = calls.filter(named).select("call", "client", op.alias("operation")).join(clients, "client")
    addresses = services.groupBy("path").agg(F.min("address").alias("address"))
    declared = services.select("path", "operation").distinct().withColumn("declared", F.lit(True))
    met = made.join(declared, ["path", "operation"], "left").join(addresses, "path", "left")
    return met.select("call", "operation", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("endpoint", "address").alias("url"))


def model_calls(calls: DataFrame, models: DataFrame, entries: DataFrame) -> DataFrame:
    """(call, ord, provider, host, path, model): one request for each model that a call of an AI toolkit may pick.

    ``calls``: (call, agent); ``models``: (call, ord, package, member, model), the candidates in order,
    the package null for a plain string; ``entries``: (package, member, provider, host, path), member ''
    for all others of a package. A string of an agent goes through a router that picks the provider, any
    other through the gateway (the entry of package ''); a call whose model cannot be traced is one
    request to an unknown provider.
    """
    keyed = calls.join(models, "call", "left").withColumns({"ord": F.coalesce("ord", F.lit(0)), "traced": F.col("model").isNotNull() | F.col("package").isNotNull()})
    keyed = keyed.withColumn("key", F.when(F.col("traced"), F.coalesce("package", F.lit(""))))
    exact = entries.filter("member <> ''").withColumnsRenamed({"package": "key", "provider": "p1", "host": "h1", "path": "u1"})
    rest = entries.filter("member = ''").select(F.col("package").alias("key"), F.col("provider").alias("p0"), F.col("host").alias("h0"), F.col("path").alias("u0"))
    met = keyed.join(exact, ["key", "member"], "left").join(rest, "key", "left")
    router = F.col("agent") & (F.col("key") == "")
    provider = F.when(router, "llm-router").otherwise(F.coalesce("p1", "p0", F.lit("unknown")))
    return met.select("call", "ord", provider.alias("provider"), F.when(~F.coalesce(router, F.lit(False)), F.coalesce("h1", "h0")).alias("host"), F.coalesce("u1", "u0", F.lit("/")).alias("path"), "model")


def component_calls(elements: DataFrame, components: DataFrame) -> DataFrame:
    """(element, provider, method, path): requests that components of SDKs send when they are shown.

    ``elements``: (element, package, name, props), where the name was imported from and the literal
    properties as a map; ``components``: (package, name, provider, method, path). Placeholders of a path
    are filled by the properties of their name; others stay.
    """
    met = elements.join(components, ["package", "name"])
    names = F.map_keys("props")
    filled = fill_template(F.col("path"), names, F.map_values("props"))
    return met.select("element", "provider", "method", filled.alias("path"))
