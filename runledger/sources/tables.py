"""Driver tables (S-9 style scans).

Each table is one Parquet dataset.  We always go through ``spark.read.parquet``
so Catalyst can prune columns and push filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


_PLANS: dict = {}


def memo_plan(fn):
    """Reuse the lazy DataFrame (the plan, not its data) built by ``fn`` for
    the same session and arguments.  The driver tables are immutable inputs,
    so their file listing and footer schema are read once per session."""
    def wrapper(spark: SparkSession, *args):
        key = (fn.__module__, fn.__qualname__, id(spark), args)
        df = _PLANS.get(key)
        if df is None or df.sparkSession is not spark:
            df = fn(spark, *args)
            _PLANS[key] = df
        return df
    wrapper.__name__ = fn.__name__
    wrapper.__qualname__ = fn.__qualname__
    wrapper.__doc__ = fn.__doc__
    wrapper.__wrapped__ = fn
    return wrapper


@memo_plan
def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def read_catalog_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read a stored catalog table with its fixed schema (no inference)."""
    return spark.read.schema(schema).parquet(path)
