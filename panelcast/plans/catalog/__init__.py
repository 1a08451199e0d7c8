"""Registered queries: one Spark builder and (where SQL can say it) one DuckDB oracle each.

Every query reads the driver's tables (``sf_dir``) or data Spark derives from
them, so its work grows with the tables.  Doubles are compared as they are,
counts are BIGINT, flags INTEGER, days DATE.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_MODULES = ("panels", "cleaning", "features", "joins", "aggregates", "imputation", "spatial",
            "schema", "ingest", "layouts", "modelling", "flows")


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, note: str = ""):
    """Decorator: add a builder under ``name`` with its oracle SQL (None = rows-only check)."""

    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        REGISTRY[name] = Query(name, fn, sql, note)
        return fn

    return deco


def as_double(expr: str) -> str:
    """An oracle expression as DOUBLE, the type of the Spark column it is held against."""
    return f"CAST(({expr}) AS DOUBLE)"


def load_all() -> dict[str, Query]:
    for m in _MODULES:
        try:
            importlib.import_module(f"{__name__}.{m}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"{__name__}.{m}":
                raise
    return REGISTRY


def doubles(*cols: str) -> str:
    """``* REPLACE (CAST(c AS DOUBLE) AS c, ...)`` select list for the oracle side."""
    return "* REPLACE (" + ", ".join(f"{as_double(c)} AS {c}" for c in cols) + ")"
