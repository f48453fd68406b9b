"""All registered queries of the engine's own operators, with SQL that gives the same rows.

A query gets ``Fixtures`` and returns a DataFrame. Its SQL names derived views as fx_<view>; the
common table expressions that these need are put before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixtures, common_tables

Query = Callable[[Fixtures], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str = "") -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL if it has any."""

    def add(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"{f.__name__} is there already")
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from . import queries_boxes, queries_detector, queries_graphs, queries_metrics, queries_store, queries_texts  # noqa: F401


def _full(sql: str) -> str:
    tables = common_tables(list(dict.fromkeys(re.findall(r"\bfx_(\w+)", sql))))
    body = sql.strip()
    if m := re.match(r"WITH (RECURSIVE )?", body):
        # DuckDB takes RECURSIVE for all expressions of a WITH.
        return f"WITH {m[1] or ''}{', '.join(tables + [body[m.end():]])}"
    return f"WITH {', '.join(tables)} {body}" if tables else body


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["xref_discrepancies"](Fixtures(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Fixtures(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: _full(sql) for name, sql in _SQL.items()}
