"""Catalog writes as frame -> frame functions, plus thin Parquet writers.

Plain Parquet has no row UPDATE, so the catalog is append-only: every write
function returns every input row, accepted or refused with a reason (where the
reference raises), ``rows_to_append`` takes the accepted ones in a table's
shape, and updates are folds over event rows (``lifecycle.py``).  Duplicate
checks are joins on the catalog key, never per-row lookups.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from .docstore import predicate
from .ids import assign_ids


# K-1 -----------------------------------------------------------------------
def create_catalog(spark: SparkSession, root: str) -> dict[str, str]:
    """Create the eight empty catalog tables under ``root`` (no clobber)."""
    paths = {}
    for name, schema in S.CATALOG.items():
        path = f"{root.rstrip('/')}/{name}"
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(path)
        paths[name] = path
    return paths


def append(df: DataFrame, path: str) -> None:
    """Append rows to a catalog table (one write per batch)."""
    df.write.mode("append").parquet(path)


def _admit(rows: DataFrame, keys: list[str], existing: DataFrame) -> DataFrame:
    """Every row of ``rows`` once, with ``accepted`` and ``reason``.

    Refused are rows with a null in a key, rows whose key ``existing`` has,
    and all rows of one key but the first in column order (of equal rows, all
    copies but one).  Equal rows are counted before anything else, so a key
    that fills the batch is a handful of rows."""
    cols = rows.columns
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    first = counted.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("_first"))
    have = existing.select(*keys).distinct().withColumn("_have", F.lit(True))
    j = counted.join(first, keys, "left").join(have, keys, "left")
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    j = j.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    reason = (F.when(~whole, F.lit("incomplete key")).when(F.col("_have"), F.lit("already recorded"))
              .when(~F.struct(*cols).eqNullSafe(F.col("_first")) | (F.col("_copy") > 1), F.lit("repeated in batch")))
    return j.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).select(*cols, "accepted", "reason")


def _numbered(admitted: DataFrame, table: DataFrame, order: list[str]) -> DataFrame:
    """Accepted rows take the ids after the table's last; refused ones none."""
    start = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    ids = assign_ids(admitted.where("accepted"), order, start)
    return ids.unionByName(admitted.where("NOT accepted").withColumn("id", F.lit(None).cast("long")))


def rows_to_append(result: DataFrame, table: str) -> DataFrame:
    """The accepted rows of a write, in the shape of catalog table ``table``;
    fields the write does not know are null."""
    have = set(result.columns)
    kept = result.where("accepted") if "accepted" in have else result
    return kept.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in S.CATALOG[table]])


# K-2 / U-3 -----------------------------------------------------------------
def register_nodes(nodes: DataFrame, new: DataFrame, init_time=None) -> DataFrame:
    """Node registrations (node_name, node_type, base_type), every one with an
    id after the current max or with the reason why it is refused (names that
    are known, or that an earlier row of the batch has: the reference raises
    on them)."""
    cand = new.select("node_name", "node_type", "base_type")
    out = _numbered(_admit(cand, ["node_name"], nodes), nodes, ["node_name"])
    return out.withColumn("init_time", F.lit(init_time).cast("timestamp_ntz"))


# K-3 / K-4 -------------------------------------------------------------------
def insert_artifacts(artifacts: DataFrame, nodes: DataFrame, new: DataFrame,
                     current_run_id: int | None = None, created_at=None) -> DataFrame:
    """Insert artifact records keyed by (node, location).

    ``new`` has ``node_name, location, hash, hash_algorithm, state, run_id,
    size, content_type``.  Every input row comes back, in the columns of the
    catalog table and with ``node_name``, ``accepted`` and ``reason``: unknown
    node or no location, key already recorded, or repeated in the batch (the
    first by hash, then the other columns, is accepted).  A ``using`` row
    takes the current run id (as ``create_entry`` does)."""
    cand = new.join(nodes.select(F.col("id").alias("node_id"), "node_name"), "node_name", "left").select(
        "node_id", "location", "hash", "node_name", "state", "run_id", "hash_algorithm", "size", "content_type")
    if current_run_id is not None:
        cand = cand.withColumn("run_id", F.when(F.col("state") == "using", F.lit(current_run_id).cast("long"))
                               .otherwise(F.col("run_id")))
    out = _numbered(_admit(cand, ["node_id", "location"], artifacts), artifacts, ["node_name", "location"])
    return (out.withColumn("reason", F.when(F.col("node_id").isNull(), F.lit("unknown node")).otherwise(F.col("reason")))
            .withColumn("created_at", F.lit(created_at).cast("timestamp_ntz")))


# K-6 -----------------------------------------------------------------------
def merge_catalog(artifacts: DataFrame, nodes: DataFrame, entries: DataFrame, node_name: str,
                  created_at=None) -> DataFrame:
    """Merge another catalog's artifacts under ``node_name``: state resets to
    ``new``; the rest is ``insert_artifacts``, so locations recorded for that
    node, repeated ones and an unknown node are refused with the reason."""
    new = entries.select(F.lit(node_name).alias("node_name"), "location", "hash", "hash_algorithm",
                         F.lit("new").alias("state"), "run_id", "size", "content_type")
    return insert_artifacts(artifacts, nodes, new, created_at=created_at)


# K-7 / K-8 / K-9 ---------------------------------------------------------------
def wide_to_long(calls: DataFrame, id_cols: list[str], value_cols: list[str], name_col: str,
                 value_col: str, as_string: bool = False) -> DataFrame:
    """One logging call per row with keyword columns -> one row per keyword.
    NULL values are kept, as the reference stores them."""
    c = calls
    if as_string:
        c = c.select(*id_cols, *[F.col(v).cast("string").alias(v) for v in value_cols])
    else:
        c = c.select(*id_cols, *[F.col(v).cast("double").alias(v) for v in value_cols])
    return c.unpivot(id_cols, value_cols, name_col, value_col)


def log_metrics(calls, id_cols, value_cols):
    return wide_to_long(calls, id_cols, value_cols, "metric_name", "metric_value")


def log_params(calls, id_cols, value_cols):
    return wide_to_long(calls, id_cols, value_cols, "param_name", "param_value", as_string=True)


def log_tags(calls, id_cols, value_cols):
    return wide_to_long(calls, id_cols, value_cols, "tag_name", "tag_value", as_string=True)


def json_kwargs_to_long(calls: DataFrame, id_cols: list[str], json_col: str, name_col: str,
                        value_col: str) -> DataFrame:
    """N-17: a JSON object body ``{"k": v, ...}`` -> one row per key."""
    return calls.select(*id_cols, F.explode(F.from_json(json_col, "map<string,string>")).alias(name_col, value_col))


# K-10 ----------------------------------------------------------------------
def tag_artifacts(artifacts: DataFrame, nodes: DataFrame, requests: DataFrame,
                  tag_cols: list[str]) -> DataFrame:
    """Tag requests (node_name, location, one column per tag) -> link rows
    (artifact_id, tag_name, tag_value); requests with no artifact come back
    with ``artifact_id`` NULL and ``accepted`` false."""
    keys = requests.select("node_name", "location").distinct()
    a = (artifacts.join(nodes.select(F.col("id").alias("node_id"), "node_name"), "node_id")
         .join(keys, ["node_name", "location"], "left_semi")       # only requested keys
         .groupBy("node_name", "location").agg(F.min("id").alias("artifact_id")))
    long = wide_to_long(requests, ["node_name", "location"], tag_cols, "tag_name", "tag_value", as_string=True)
    j = long.join(a, ["node_name", "location"], "left")
    return j.select("node_name", "location", "artifact_id", "tag_name", "tag_value",
                    F.col("artifact_id").isNotNull().alias("accepted"))


# K-11 ----------------------------------------------------------------------
def card_links(links: DataFrame, subject_tag: str, card_tag: str) -> DataFrame:
    """Mutual link tags: the subject is tagged with its card's location and
    the card with its subject's location (one frame and its swapped copy)."""
    node = [c for c in links.columns if c not in ("subject", "card")]      # whose locations they are
    to_card = links.select(*node, F.col("subject").alias("location"), F.lit(card_tag).alias("tag_name"),
                           F.col("card").alias("tag_value"))
    to_subject = links.select(*node, F.col("card").alias("location"), F.lit(subject_tag).alias("tag_name"),
                              F.col("subject").alias("tag_value"))
    return to_card.unionByName(to_subject)


# S-10 / A-10 / K-16 -----------------------------------------------------------
def doc_filter(doc_type: str | None = None, doc_id: int | None = None, **filters):
    """The condition of a document store call: type, id and payload fields, by
    value, ``None`` (missing or null) or ``(operator, value)``; see
    ``docstore.predicate``."""
    own = {k: v for k, v in (("type", doc_type), ("id", doc_id)) if v is not None}
    return predicate({**own, **filters})


def doc_query(docs: DataFrame, doc_type: str | None = None, doc_id: int | None = None, **filters) -> DataFrame:
    """Document store query: filter by ``type``, id and payload fields.

    ``docs`` has ``id, type, payload`` with ``payload`` a VARIANT (from
    ``parse_json``); the ``type`` filter is a plain column predicate and is
    pushed into the scan."""
    return docs.where(doc_filter(doc_type, doc_id, **filters))


def doc_update(docs: DataFrame, updates: dict, doc_type: str | None = None, doc_id: int | None = None,
               **filters) -> DataFrame:
    """Update by filter or id: the documents that ``doc_filter`` finds get every
    field of ``updates`` (JSON values); their other fields stay.  Returns all
    documents with ``updated`` (``sum`` of it is the reference's count).  A
    payload that is no object is left as it is."""
    fields = F.from_json(F.to_json("payload"), "map<string,variant>")
    put = F.map_from_arrays(F.array(*[F.lit(k) for k in updates]),
                            F.array(*[F.parse_json(F.lit(json.dumps(v))) for v in updates.values()]))
    kept = F.map_filter(fields, lambda k, _: ~k.isin(list(updates)))
    hit = doc_filter(doc_type, doc_id, **filters) & F.schema_of_variant("payload").startswith("OBJECT")
    return docs.select("id", "type", F.when(hit, F.parse_json(F.to_json(F.map_concat(kept, put)))).otherwise(
        F.col("payload")).alias("payload"), F.coalesce(hit, F.lit(False)).alias("updated"))


# K-5 -----------------------------------------------------------------------
def save_artifact(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False,
                  node_name: str | None = None, run_id: int | None = None) -> DataFrame:
    """Save a DataFrame as an artifact and return the produced records.

    No clobber unless ``overwrite`` (``errorifexists`` raises on an existing
    path); Spark's file committer writes to a temporary location and commits
    atomically per job.  The committed files are then hashed (S-1) and come
    back as ``produced`` rows for K-4."""
    from ..sources.files import scan_artifacts
    df.write.format(fmt).mode("overwrite" if overwrite else "errorifexists").save(path)
    spark = df.sparkSession
    # the committer's own marks (_SUCCESS, checksums) are no artifacts
    files = scan_artifacts(spark, path, node_level=False).where("NOT location RLIKE '(^|/)[._]'")
    return files.select(F.lit(node_name).cast("string").alias("node_name"), "location", "hash",
                        F.lit(S.HASH_ALGORITHM).alias("hash_algorithm"), F.lit("produced").alias("state"),
                        F.lit(run_id).cast("long").alias("run_id"), "size",
                        F.lit(f"application/x-{fmt}").alias("content_type"))
