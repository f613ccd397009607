"""Registry of named queries over the driver tables.

Each query is a callable ``(spark, sf_dir) -> DataFrame``; ``sql`` is the
equivalent DuckDB statement over the same tables (None when the operator
is not expressible in SQL, e.g. iterative fits).
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the plan modules fills the registry
    from cadenza.plans import catalog, evaluation, features, ideation, io, manifold, similarity, text, training  # noqa: F401
    return REGISTRY
