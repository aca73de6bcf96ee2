"""Queries by name and the SQL that checks them.

A query names the tables or views it takes; a view is one SELECT that Spark and DuckDB both run (plans/views.py), so a
check repeats it as a common table expression.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS, load, with_views

_MODULES = ("dedup", "library", "money", "scalars", "quality", "grid", "sheets", "images", "history", "streams")
_QUERIES: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame], str | None]] = {}


def query(name: str, *inputs: str, sql: str | None = None):
    """Registers a function of DataFrames under name. sql: a SELECT, or further CTEs and a SELECT, over the inputs."""

    def add(f: Callable[..., DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is there already")
        _QUERIES[name] = (inputs, f, sql)
        return f

    return add


def _all() -> dict:
    for m in _MODULES:
        importlib.import_module(f"{__package__}.q_{m}")
    return _QUERIES


def _run(inputs: tuple[str, ...], f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*(load(spark, sf_dir, n) for n in inputs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(inputs, f) for name, (inputs, f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views([n for n in inputs if n in VIEWS], sql) for name, (inputs, _, sql) in _all().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-duplicated products with their category, counted by category and status."""
    from . import q_dedup

    return q_dedup.categorised_counts(load(spark, sf_dir, "products_raw"))
