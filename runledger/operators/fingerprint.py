"""Run fingerprints (A-2, A-3, A-4) and content hashes (N-1).

SHA-256 does not merge, so a flat digest of a run's sorted lines needs all of
them in one place.  Every digest here is a two-level one instead, at every
size: equal lines are counted first (repeats of one file are one line), the
distinct lines are dealt to leaves by the first digits of their own hash, each
leaf digests its sorted lines with their counts, and the root digests the leaf
digests in leaf order.  A leaf of a run with 10^8 lines holds some 24,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF_DIGITS = 3
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def content_hash(col) -> Column:
    """N-1: lower-case hex SHA-256 of a string or binary column."""
    return F.sha2(col if isinstance(col, Column) else F.col(col), 256)


def tree_digest(lines: DataFrame, keys: list[str], line_col: str = "line") -> DataFrame:
    """Per group of ``keys``: the two-level digest of the multiset of lines.

    Returns ``keys + [digest]``.  A null line counts as an empty one."""
    line = F.coalesce(F.col(line_col), F.lit(""))
    counted = lines.groupBy(*keys, line.alias("_line")).agg(F.count(F.lit(1)).alias("_n"))
    leaves = counted.groupBy(*keys, F.substring(F.sha2("_line", 256), 1, LEAF_DIGITS).alias("_leaf")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("_line", F.lit("*"), F.col("_n").cast("string")))), "\n"), 256)
        .alias("_d"))
    ordered = F.array_sort(F.collect_list(F.struct("_leaf", "_d")))
    return leaves.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["_d"]), ""), 256).alias("digest"))


def tree_digest_sql(lines: str, keys: str) -> str:
    """The same digest in DuckDB SQL, as a subquery over ``lines`` (keys, line)."""
    return f"""(SELECT {keys}, sha256(string_agg(d, '' ORDER BY leaf)) AS digest FROM (
        SELECT {keys}, left(sha256(line), {LEAF_DIGITS}) AS leaf,
               sha256(string_agg(line || '*' || n, chr(10) ORDER BY line || '*' || n)) AS d
        FROM (SELECT {keys}, coalesce(line, '') AS line, CAST(count(*) AS VARCHAR) AS n FROM {lines} GROUP BY ALL) GROUP BY ALL)
      GROUP BY ALL)"""


# A-2 -----------------------------------------------------------------------
def artifact_lines(artifacts: DataFrame) -> DataFrame:
    """The hashes of the artifacts each run touched: ``run_id`` is the run and
    the state is past ``new`` (using, used, produced, unused)."""
    return artifacts.where(F.col("run_id").isNotNull() & (F.col("state") != "new")).select(
        "run_id", F.col("hash").alias("line"))


def artifact_fingerprint(artifacts: DataFrame) -> DataFrame:
    """Per run: the digest of its artifacts' hashes, in any order."""
    return tree_digest(artifact_lines(artifacts), ["run_id"]).withColumnRenamed("digest", "artifact_hash")


# A-3 -----------------------------------------------------------------------
def _decimal_text(c) -> Column:
    return F.col(c).cast("decimal(18,6)").cast("string")


def _lines(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.where(F.col("run_id").isNotNull()).select("run_id", F.concat_ws(
        "|", F.col("id").cast("string"), F.coalesce(name, F.lit("")), F.coalesce(value, F.lit(""))).alias("line"))


def metric_lines(metrics: DataFrame) -> DataFrame:
    return _lines(metrics, "metric_name", _decimal_text("metric_value"))


def param_lines(params: DataFrame) -> DataFrame:
    return _lines(params, "param_name", F.col("param_value"))


def tag_lines(tags: DataFrame) -> DataFrame:
    return _lines(tags, "tag_name", F.col("tag_value"))


PARTS = ("metrics", "params", "tags")


def _metadata_lines(metrics: DataFrame, params: DataFrame, tags: DataFrame) -> DataFrame:
    m, p, t = (df.withColumn("part", F.lit(name)) for name, df in
               zip(PARTS, (metric_lines(metrics), param_lines(params), tag_lines(tags))))
    return m.unionByName(p).unionByName(t)


def _run_digests(digests: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per run: each part's digest (the empty text's where the run has
    no such lines) and the metadata hash over the three parts."""
    per_run = digests.groupBy("run_id").agg(*[
        F.max(F.when(F.col("part") == p, F.col("digest"))).alias(f"{p}_hash") for p in (*PARTS, "artifacts")])
    e = F.lit(EMPTY_SHA256)
    j = runs.select("run_id").join(per_run, "run_id", "left")
    j = j.select("run_id", *[F.coalesce(f"{p}_hash", e).alias(f"{p}_hash") for p in (*PARTS, "artifacts")])
    return j.withColumn("metadata_hash", F.sha2(F.concat(*[f"{p}_hash" for p in PARTS]), 256))


def run_metadata_hash(runs: DataFrame, metrics: DataFrame, params: DataFrame, tags: DataFrame) -> DataFrame:
    """Per run: SHA-256(metrics digest + params digest + tags digest).

    One canonical line per record (``id|name|value``, metric values as
    DECIMAL(18,6) text); a run with no records of a kind uses the SHA-256 of
    the empty string.  The three parts are one union and one digest keyed by
    (part, run)."""
    d = tree_digest(_metadata_lines(metrics, params, tags), ["part", "run_id"])
    return _run_digests(d, runs).drop("artifacts_hash")


# A-4 -----------------------------------------------------------------------
def run_hash(runs: DataFrame, artifacts: DataFrame, metrics: DataFrame, params: DataFrame,
             tags: DataFrame) -> DataFrame:
    """Per run: SHA-256(artifact digest + metadata hash).  Artifact hashes and
    metadata lines go through one digest keyed by (part, run)."""
    lines = _metadata_lines(metrics, params, tags).unionByName(
        artifact_lines(artifacts).withColumn("part", F.lit("artifacts")))
    return _run_digests(tree_digest(lines, ["part", "run_id"]), runs).select(
        "run_id", "metadata_hash", F.sha2(F.concat("artifacts_hash", "metadata_hash"), 256).alias("run_hash"))
