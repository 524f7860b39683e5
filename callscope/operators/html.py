"""Forms and scripts of HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions import text


def forms(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each form that sends a request: ``line``, ``method``, ``action``, ``encoding``, ``fields``, ``required``.

    Comments are blanked first, with their line ends kept. Forms without an action, with a fragment
    or a ``mailto:`` or ``javascript:`` action send none; buttons are no fields. Null pages have none.
    """
    # A comment's text goes, its line ends stay, so lines hold.
    plain = F.col(html)
    pieces = F.split(plain, "<!--", -1)
    kept = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.regexp_replace(F.regexp_extract(p, r"(?s)^(.*?)(?:-->|\z)", 1), r"[^\r\n]", ""), F.regexp_replace(p, r"(?s)^.*?(?:-->|\z)", ""))))
    blanked = pages.withColumn("_html", F.array_join(kept, ""))
    chunks = F.split(F.col("_html"), r"(?i)(?=<form\b)", -1)
    # Line ends before each chunk, counted once: a form's row carries its own chunk and number only.
    ends = F.transform(chunks, lambda c: F.regexp_count(c, F.lit("\n")))
    before = F.aggregate(ends, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    each = blanked.select(*pages.columns, F.explode(F.arrays_zip(chunks.alias("chunk"), before.alias("before"))).alias("_c")).select(*pages.columns, F.col("_c.chunk").alias("_chunk"), F.col("_c.before").alias("_before"))
    each = each.filter(F.lower("_chunk").startswith("<form"))
    tag = F.regexp_extract("_chunk", r"(?is)^<form\b([^>]*)>", 1)
    inner = F.regexp_replace(F.col("_chunk"), r"(?is)</form\s*>.*\z", "")
    attr = text.attributes(F.col("_tag"))
    found = each.select(*pages.columns, (F.col("_before") + 1).alias("line"), tag.alias("_tag"), inner.alias("_inner"))
    found = found.withColumns({"action": F.try_element_at(attr, F.lit("action")), "_method": F.upper(F.try_element_at(attr, F.lit("method"))), "_enc": F.lower(F.try_element_at(attr, F.lit("enctype")))})
    fields = F.transform(F.regexp_extract_all("_inner", F.lit(r"(?is)<(?:input|select|textarea)\b([^>]*)>"), F.lit(1)), text.attributes)
    fields = F.filter(fields, lambda a: F.try_element_at(a, F.lit("name")).isNotNull() & ~F.coalesce(F.lower(F.try_element_at(a, F.lit("type"))).isin("submit", "button", "reset", "image"), F.lit(False)))
    sends = found.filter("action is not null and action <> ''").filter(~F.col("action").rlike(r"(?i)^(?:#|mailto:|javascript:|tel:)"))
    method = F.when(F.col("_method") == "POST", "POST").otherwise("GET")
    encoding = F.when(method == "GET", "none").when(F.col("_enc") == "multipart/form-data", "multipart").when(F.col("_enc") == "text/plain", "raw").otherwise("form")
    return sends.withColumn("_fields", fields).select(
        *[c for c in pages.columns if c != html],
        F.col("line").cast("long").alias("line"),
        method.alias("method"),
        "action",
        encoding.alias("encoding"),
        F.array_distinct(F.transform("_fields", lambda a: F.element_at(a, F.lit("name")))).alias("fields"),
        F.array_distinct(F.transform(F.filter("_fields", lambda a: F.try_element_at(a, F.lit("required")).isNotNull()), lambda a: F.element_at(a, F.lit("name")))).alias("required"),
    )
