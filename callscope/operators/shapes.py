"""Shapes of bodies as rows: (id, path, kind, value), a tree in a table.

``$`` is the body, ``$.a.b`` a property, ``$.a[]`` the items of a list. Kinds are object, array,
string, number, integer, boolean, null and xml. Trees of any depth so meet in plain joins and groups.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a tree: how deep, properties of an object; characters, elements and depth of XML.
DEPTH, PROPERTIES = 6, 80
XML_CHARS, XML_ELEMENTS, XML_DEPTH = 64 * 1024, 500, 32

Node = tuple[str, str, str | None]


def json_nodes(value: object, path: str = "$", depth: int = 0) -> Iterator[Node]:
    """Nodes of a JSON value; a scalar's value is its one possible text. What lies deeper than the bound is unknown."""
    if depth > DEPTH:
        yield path, "unknown", None
    elif isinstance(value, dict):
        yield path, "object", None
        for k, v in list(value.items())[:PROPERTIES]:
            yield from json_nodes(v, f"{path}.{k}", depth + 1)
    elif isinstance(value, list):
        yield path, "array", None
        for v in value:
            yield from json_nodes(v, f"{path}[]", depth + 1)
    elif value is None:
        yield path, "null", None
    elif isinstance(value, bool):
        yield path, "boolean", str(value).lower()
    else:
        yield path, "integer" if isinstance(value, int) else "number" if isinstance(value, float) else "string", str(value)


def form_nodes(body: str) -> Iterator[Node]:
    """Nodes of a form-encoded text: a string for each name; names without a value have none, computed values are no text."""
    yield "$", "object", None
    for pair in body.split("&"):
        name, eq, value = pair.partition("=")
        if name and "{" not in name:
            yield f"$.{unquote_plus(name)}", "string", unquote_plus(value) if eq and "{" not in value else None


def xml_nodes(body: str) -> list[Node]:
    """Nodes of an XML document: elements by their local names, texts as values, attributes as ``@name``; none for HTML, SVG, DTDs and broken texts."""
    if len(body) > XML_CHARS or "<!DOCTYPE" in body or "<!ENTITY" in body or not re.match(r"\s*<", body):
        return []
    out: list[list] = []
    open_: list[int] = []
    plain = re.sub(r"\{[^{}<>]*\}", "", body)  # what the code computes is no text
    parser = expat.ParserCreate()

    def start(name: str, attributes: dict[str, str]) -> None:
        if len(out) > XML_ELEMENTS or len(open_) > XML_DEPTH:
            raise ValueError("bound")
        local = name.rpartition(":")[2]
        path = f"{out[open_[-1]][0]}.{local}" if open_ else f"$.{local}"
        out.append([path, "xml", ""])
        open_.append(len(out) - 1)
        for k, v in attributes.items():
            if not k.startswith("xmlns"):
                out.append([f"{path}.@{k.rpartition(':')[2]}", "string", v])

    def text(data: str) -> None:
        out[open_[-1]][2] += data

    parser.StartElementHandler, parser.CharacterDataHandler = start, text
    parser.EndElementHandler = lambda name: open_.pop()
    try:
        parser.Parse(plain, True)
    except (expat.ExpatError, ValueError):
        return []
    if not out or out[0][0].lower() in ("$.html", "$.svg"):
        return []
    return [(p, k, v.strip() or None if k == "xml" else v) for p, k, v in out]


def nodes_of(encoding: str | None, body: str | None) -> list[Node]:
    """Nodes of a body by its encoding: json, form or xml; without one, what it reads as."""
    if body is None:
        return []
    if encoding in (None, "json"):
        try:
            return list(json_nodes(json.loads(body)))
        except (ValueError, RecursionError):
            if encoding:
                return [("$", "unknown", None)]
    if encoding in (None, "xml") and (found := xml_nodes(body)):
        return found
    if encoding == "form" or encoding is None and re.fullmatch(r"[^=&\s<]+=[^&\s]*(?:&[^=&\s]+=[^&\s]*)*", body):
        return list(form_nodes(body))
    return [("$", "string", body)] if encoding in (None, "text") else [("$", "unknown", None)]


def body_nodes(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, path, kind, value): the nodes of every body, equal ones of a list once. ``rows``: key, encoding, body."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found = [], []
            for i, (encoding, body) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                nodes = list(dict.fromkeys(nodes_of(encoding, body)))
                own += [i] * len(nodes)
                found += nodes
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], names=[key, "path", "kind", "value"])

    return rows.select(key, "encoding", "body").mapInArrow(run, f"{key} {kind}, path string, kind string, value string")


def union(nodes: DataFrame, key: str = "id", alternative: str = "alt") -> DataFrame:
    """(key, path, kinds, nullable, enum, required): several shapes of a key as one.

    ``nodes``: key, alternative, path, kind, value. ``kinds`` sorted, without null; ``enum`` the values
    where every alternative that has the path tells one; a path is required if all alternatives have it.
    """
    count = nodes.groupBy(key).agg(F.count_distinct(alternative).alias("_all"))
    each = nodes.groupBy(key, "path").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))).alias("kinds"),
        F.bool_or(F.col("kind") == "null").alias("nullable"),
        F.bool_and(F.col("value").isNotNull() | (F.col("kind") == "null")).alias("_told"),
        F.array_sort(F.collect_set("value")).alias("_enum"),  # of one path
        F.count_distinct(alternative).alias("_n"),
    )
    enum = F.when(F.col("_told") & (F.size("_enum") > 0), F.col("_enum"))
    return each.join(count, key).select(key, "path", "kinds", "nullable", enum.alias("enum"), (F.col("_n") == F.col("_all")).alias("required"))


def wrap(nodes: DataFrame, name: Column, key: str = "id") -> DataFrame:
    """The same shapes as a property ``name`` of an object. ``name``: a column of ``nodes`` or a literal."""
    columns = nodes.columns
    inner = nodes.withColumn("path", F.concat(F.lit("$."), name, F.expr("substring(path, 2, length(path))")))
    roots = nodes.filter("path = '$'").withColumns({"kind": F.lit("object"), "value": F.lit(None).cast("string")})
    return inner.select(columns).union(roots.select(columns))


def omit(nodes: DataFrame, names: DataFrame, key: str = "id") -> DataFrame:
    """Nodes without those at or below the named top properties. ``names``: (key, name)."""
    top = F.regexp_extract("path", r"^\$\.([^.\[]+)", 1)
    return nodes.withColumn("_top", top).join(names.select(key, F.col("name").alias("_top")).distinct(), [key, "_top"], "left_anti").select(nodes.columns)


def is_xml_type(content_type: Column) -> Column:
    return F.lower(content_type).rlike(r"^\s*(?:text/xml|application/xml|[\w.-]+/[\w.+-]+\+xml)\s*(?:;|\z)") & ~F.lower(content_type).rlike(r"svg|xhtml")
