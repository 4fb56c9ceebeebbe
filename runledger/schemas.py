"""Catalog schemas and value domains.

The StructTypes mirror the eight catalog tables of the run/artifact store.
Timestamps are ``timestamp_ntz`` end to end (the store writes naive local
times, the test Parquet reads as NTZ).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (state names, status names,
# base types, outcome names, placeholder text, card section titles).
# ---------------------------------------------------------------------------

# Artifact lifecycle states of the SQL store; "all" means "no filter".
ARTIFACT_STATES = ["new", "using", "used", "produced", "unused"]
STATE_ALL = "all"

# Older document-store lifecycle: new -> current -> old.
DOC_STORE_STATES = ["new", "current", "old"]

# Node status names.
STATUS_NAMES = [
    "WAITING_RESOURCE", "WAITING_METRICS", "QUEUED", "PREPARATION", "EXECUTING",
    "CLEANUP", "COMPLETE", "FAILURE", "ERROR", "TRIGGERED", "INITIALIZING",
    "SKIPPED", "PAUSED",
]

# Job outcome names.
RESULT_NAMES = ["FAILURE", "SUCCESS", "ERROR"]

# Log levels accepted by node loggers.
LOG_LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]

# Node base types.
BASE_METADATA = "BaseMetadataStoreNode"
BASE_RESOURCE = "BaseResourceNode"
BASE_ACTION = "BaseActionNode"

HASH_ALGORITHM = "sha256"

# Placeholder written into card sections that have no value.
MORE_INFO_NEEDED = "[More Information Needed]"

# ---------------------------------------------------------------------------
# Catalog tables
# ---------------------------------------------------------------------------

RUNS = T.StructType([
    T.StructField("run_id", T.LongType(), False),
    T.StructField("start_time", T.TimestampNTZType(), True),
    T.StructField("end_time", T.TimestampNTZType(), True),
    T.StructField("hash", T.StringType(), True),
])

NODES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("node_name", T.StringType(), False),
    T.StructField("node_type", T.StringType(), True),
    T.StructField("base_type", T.StringType(), True),
    T.StructField("init_time", T.TimestampNTZType(), True),
])

METRICS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("run_id", T.LongType(), True),
    T.StructField("node_id", T.LongType(), True),
    T.StructField("metric_name", T.StringType(), True),
    T.StructField("metric_value", T.DoubleType(), True),
])

PARAMS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("run_id", T.LongType(), True),
    T.StructField("node_id", T.LongType(), True),
    T.StructField("param_name", T.StringType(), True),
    T.StructField("param_value", T.StringType(), True),
])

TAGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("run_id", T.LongType(), True),
    T.StructField("node_id", T.LongType(), True),
    T.StructField("tag_name", T.StringType(), True),
    T.StructField("tag_value", T.StringType(), True),
])

ARTIFACT_TAGS = T.StructType([
    T.StructField("artifact_id", T.LongType(), False),
    T.StructField("tag_id", T.LongType(), False),
])

ARTIFACTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("run_id", T.LongType(), True),
    T.StructField("node_id", T.LongType(), True),
    T.StructField("location", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("hash", T.StringType(), False),
    T.StructField("hash_algorithm", T.StringType(), False),
    T.StructField("size", T.LongType(), True),
    T.StructField("content_type", T.StringType(), True),
    T.StructField("used", T.BooleanType(), True),
])

TRIGGERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("run_triggered", T.LongType(), True),
    T.StructField("node_id", T.LongType(), True),
    T.StructField("trigger_time", T.TimestampNTZType(), True),
    T.StructField("message", T.StringType(), True),
])

CATALOG = {
    "runs": RUNS, "nodes": NODES, "metrics": METRICS, "params": PARAMS,
    "tags": TAGS, "artifact_tags": ARTIFACT_TAGS, "artifacts": ARTIFACTS,
    "triggers": TRIGGERS,
}
