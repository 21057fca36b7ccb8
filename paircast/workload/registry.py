"""Register of queries: a Spark callable and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its reference SQL if there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tidy(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Chosen columns in report types: doubles rounded, counts as long."""
    out = []
    for field in df.select(*columns).schema if columns else df.schema:
        column = F.col(field.name)
        kind = field.dataType.typeName()
        if kind in ("double", "float") or kind.startswith("decimal"):
            # Plain arithmetic gives every engine the same digits; the nudge
            # above one half settles ties upwards.
            scale = float(10**digits)
            column = F.floor(column.cast("double") * scale + 0.5001) / scale
        elif kind in ("integer", "short", "byte"):
            column = column.cast("long")
        out.append(column.alias(field.name))
    return df.select(*out)


def r6(expr: str, name: str | None = None) -> str:
    """SQL twin of `tidy` for one double."""
    return f"floor(CAST({expr} AS DOUBLE) * CAST(1000000 AS DOUBLE) + CAST(0.5001 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS {name or expr}"


def i8(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"
