"""Small relations that a query and its SQL share."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]"
    return repr(x)


@dataclass(frozen=True)
class Fixture:
    name: str
    ddl: str
    rows: list[tuple]

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.ddl.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.ddl)

    @property
    def sql(self) -> str:
        """For a WITH list."""
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"{self.name}({', '.join(self.columns)}) AS (VALUES {values})"


def golden(columns: str, rows: list[tuple]) -> str:
    """SQL that states the expected rows."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({columns})"


_TABLES = re.compile(r"\b(?:FROM|JOIN) (customer|orders|lineitem|nation|region|supplier|part|events|pages|documents)\b")


@dataclass(frozen=True)
class Made:
    """A relation made of whole tables, by a select that both engines read alike; operators and their SQL start from it."""

    name: str
    select: str

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        used = sorted(set(_TABLES.findall(self.select)))
        text = _TABLES.sub(lambda m: m[0].replace(m[1], "{" + m[1] + "}"), self.select.replace("{", "{{").replace("}", "}}"))
        return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

    @property
    def sql(self) -> str:
        """For a WITH list."""
        return f"{self.name} AS ({self.select})"
