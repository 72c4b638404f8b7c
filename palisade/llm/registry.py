"""Queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from palisade.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = ("warc", "quality", "vectors", "bpe", "simhash", "blocks", "packing", "ppm", "weaklabels", "chat", "merkle", "piecemodel", "negatives")
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


BATCH_ROWS = 2000  # rows of whole texts that a Python worker gets at a time


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and keep Arrow batches of texts small."""
    ship_package(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; the package reaches the workers before it runs."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return build(spark, sf_dir)

        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = run
        if sql:
            _oracles[name] = sql
        return build

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"palisade.llm.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
