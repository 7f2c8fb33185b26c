"""Registry of checkable queries: name -> (Spark builder, DuckDB oracle SQL).

Each Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame
over the *whole* driver tables. The oracle is the same computation written
in DuckDB SQL over the pre-registered driver views (prelude CTEs repeat the
adapter / Silver / Gold). Entries without SQL get a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from martflow.oracle.prelude import with_prelude
from martflow.plans.pipeline import Pipeline

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None, raw_sql: bool = False):
    """Register ``fn(pipeline) -> DataFrame`` under ``name``.

    ``sql`` is a SELECT over the prelude CTEs (or complete SQL with raw_sql).
    """
    def deco(fn: Callable[[Pipeline], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Pipeline.fixture(spark, sf_dir))
        build.__name__ = name
        build.__doc__ = fn.__doc__
        oracle = None if sql is None else (sql if raw_sql else with_prelude(sql))
        REGISTRY[name] = (build, oracle)
        return fn
    return deco


def queries() -> dict[str, Builder]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


_loaded = False


def _load() -> None:
    global _loaded
    if not _loaded:
        from martflow.plans import catalog  # noqa: F401  (registers everything)
        _loaded = True
