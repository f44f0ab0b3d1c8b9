"""Named queries over the given tables, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("sources", "rows", "joins", "aggregates", "windows", "shaping", "scalars", "results", "fitting", "rolling", "whole")


def half_up(x: Column | str, digits: int) -> Column:
    """Round through decimal. Values here are cents over counts, where exact halves are common, and
    engines that round binary doubles disagree on those."""
    c = F.col(f"`{x}`") if isinstance(x, str) else x
    return F.round(c.cast(f"decimal(38,{digits + 4})"), digits).cast("double")


def half_up_sql(expr: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,{digits + 4})), {digits}) AS DOUBLE)"


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in _MODULES:
        import_module(f"tidemill.plans.queries.{module}")
    return dict(QUERIES), dict(ORACLES)
