"""Key → (Spark query, DuckDB oracle SQL) for every operator of the inventory."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from dealerlens.fixtures import Fixtures
from dealerlens.plans import derived_views  # noqa: F401  (registers derived oracle views)
from dealerlens.plans.oracle_views import with_views


@dataclass(frozen=True)
class Entry:
    key: str
    build: Callable[[Fixtures], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, oracle: str | None = None):
    """Decorator: ``build(fx) -> DataFrame`` plus its oracle SQL (or None)."""

    def deco(fn: Callable[[Fixtures], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"duplicate key {key}")
        REGISTRY[key] = Entry(key, fn, with_views(oracle) if oracle else None)
        return fn

    return deco


def _load_all() -> None:
    # Importing the query modules fills REGISTRY.
    from dealerlens.plans import (  # noqa: F401
        q_sources, q_projection, q_joins, q_aggregates, q_windows,
        q_ordering, q_functions, q_text, q_checks, q_streaming,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {k: (lambda spark, sf_dir, _e=e: _e.build(Fixtures.of(spark, sf_dir)))
            for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: e.oracle for k, e in REGISTRY.items() if e.oracle}
