"""Query registry."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
BATCH_BYTES = str(8 << 20)  # of texts that a Python worker gets at a time, however long they are
_MODULES = ("links", "content", "intel", "reporting", "learning", "response", "storage_queries", "streams", "feed_queries", "table_lookups")
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a few places, so that two engines can be compared by value; ``+ 0.0`` clears a minus zero."""
    doubles = {f.name: F.round(F.col(f"`{f.name}`"), places) + F.lit(0.0) for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(doubles) if doubles else df


def query(name: str, sql: str | None = None, places: int = 6) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its equivalent SQL."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
            return rounded(build(spark, sf_dir), places)

        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = run
        if sql:
            _oracles[name] = sql
        return build

    return register


def registered_sql(name: str) -> str:
    """SQL of a query registered before, for queries that are made of others."""
    return _oracles[name]


def _load() -> None:
    for module in _MODULES:
        import_module(f"palisade.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
