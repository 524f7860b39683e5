"""Checks of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reason(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that a row fails (null counts as failing), or null."""
    out = F.lit(None).cast("string")
    for name, good in reversed(checks):
        out = F.when(~F.coalesce(good, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def valid(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    return rows.filter(reason(checks).isNull())


def dropped(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    return rows.withColumn("reason", reason(checks)).filter("reason is not null")
