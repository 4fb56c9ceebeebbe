"""Query registry: every query key maps to a Spark builder and (when the
operator is SQL-expressible) a DuckDB oracle string.

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame.  Modules in
``runledger.plans`` register themselves with ``@query``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


MODULES = ["catalog_queries", "run_queries", "lifecycle_queries", "card_queries", "header_queries",
           "graph_queries", "file_queries", "stream_queries", "function_queries"]


def load_all() -> None:
    """Import every plan module (registration happens at import)."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")
