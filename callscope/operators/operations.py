"""Protocol operations and request parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions import fixed, text

_VERB = r"(?i)^(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\z"


def json_rpc(bodies: DataFrame) -> DataFrame:
    """(id, name, batch, target) of JSON-RPC requests in JSON bodies; a method repeated in a batch is one operation."""
    shape = "struct<jsonrpc:string,method:string,params:string,id:string>"
    batch = F.ltrim("body").startswith("[")
    one = F.when(~batch, F.array(F.from_json("body", shape)))
    many = F.when(batch, F.from_json("body", f"array<{shape}>"))
    each = bodies.select("id", batch.alias("batch"), F.posexplode(F.coalesce(one, many)).alias("i", "r"))
    old = F.col("r.params").isNotNull() & F.col("r.id").isNotNull() & ~F.col("r.method").rlike(_VERB)
    found = each.filter(F.col("r.method").isNotNull() & (F.col("r.jsonrpc").isNotNull() | old))
    keys = F.create_map(*[F.lit(x) for pair in fixed.MCP_TARGETS.items() for x in pair])
    target = F.expr("get_json_object(r.params, concat('$.', _key))")
    first = found.groupBy("id", "batch", F.col("r.method").alias("name")).agg(F.min_by("r", "i").alias("r"))
    return first.withColumn("_key", F.try_element_at(keys, F.col("name"))).select("id", "name", "batch", target.alias("target"))


def soap(requests: DataFrame) -> DataFrame:
    """(id, name, origin) of SOAP requests: the action's header, the content type's action, else the body's first element."""
    header = text.soap_action_name(F.col("action"))
    typed = text.soap_action_name(F.nullif(F.regexp_extract("content_type", r'(?i);\s*action\s*=\s*"?([^";]*)"?', 1), F.lit("")))
    inner = F.nullif(F.regexp_extract("body", r"(?s)<(?:\w+:)?Envelope\b.*?<(?:\w+:)?Body\b[^>]*>\s*<(?:\w+:)?(\w+)", 1), F.lit(""))
    named = F.coalesce(header, typed)
    return requests.select("id", F.coalesce(named, inner).alias("name"), F.when(named.isNotNull(), "header").otherwise("body").alias("origin")).filter("name is not null")


def action(requests: DataFrame, params: DataFrame) -> DataFrame:
    """(id, name, origin): the operation of action-style providers, named by a query or form parameter."""
    met = requests.join(params, "provider")
    value = lambda c: F.nullif(F.expr(f"regexp_extract({c}, concat('(?:^|&)', param, '=([^&]*)'), 1)"), F.lit(""))
    return met.select("id", F.coalesce(value("query"), value("form")).alias("name"), F.when(value("query").isNotNull(), "query").otherwise("body").alias("origin")).filter("name is not null")


def headers(rows: DataFrame) -> DataFrame:
    """(call, names, shown, auth) of (call, ord, name, value): names in first-seen order, the last literal value of each that is no credential, the auth scheme."""
    low = F.lower("name")
    each = rows.groupBy("call", low.alias("h")).agg(F.min("ord").alias("first"), F.max_by("value", "ord").alias("value"))
    plain = ~text.is_credential_header(F.col("h")) & ~F.col("value").contains("{") & ~text.looks_secret(F.col("value"))
    listed = F.array_sort(F.collect_list(F.struct("first", "h", F.when(plain, F.concat_ws("=", "h", "value")).alias("shown"))))
    auth = F.max(F.when(F.col("h") == "authorization", text.auth_scheme(F.col("value"))))
    keyed = F.max(F.when(F.col("h").isin(fixed.APIKEY_HEADERS), "apikey"))
    out = each.groupBy("call").agg(listed.alias("l"), F.coalesce(keyed, auth, F.lit("none")).alias("auth"))
    return out.select("call", F.transform("l", lambda x: x["h"]).alias("names"), F.filter(F.transform("l", lambda x: x["shown"]), lambda x: x.isNotNull()).alias("shown"), "auth")


def templates(parts: DataFrame) -> DataFrame:
    """(id, template, static) of (id, ord, kind, text): parts in order; ``static`` only if nothing else is in it."""
    text_ = F.when(F.col("kind") == "static", F.col("text")).when(F.col("kind") == "env", F.concat(F.lit("{env:"), "text", F.lit("}"))).otherwise(F.concat(F.lit("{"), "text", F.lit("}")))
    rows = parts.withColumn("_t", text_).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "_t", "text"))).alias("p"), F.bool_and(F.col("kind") == "static").alias("s"))
    whole = F.array_join(F.transform("p", lambda x: x["_t"]), "")
    return rows.select("id", whole.alias("template"), F.when(F.col("s"), whole).alias("static"))
