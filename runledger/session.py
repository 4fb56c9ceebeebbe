"""Session construction and shared-scratch handling.

On a cluster the session is created by the platform; ``get_session`` only
fills in settings that are unset.  Scratch data (checkpoints, materialised
stand-in inputs, stream checkpoints) always goes under ``spark.checkpoint.dir``
because that is the folder every executor can reach.  Only when the setting is
missing (tests, local runs) do we create one ourselves.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings we want on every session; each is applied only if the caller left
# it unset, so a cluster's own tuning wins.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # artifact trees hold many small files: pack more of them per task
    "spark.sql.files.openCostInBytes": str(1 << 20),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "runledger", extra: dict | None = None) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        # a platform-made session: only fill in what is unset
        for k, v in {**_DEFAULTS, **(extra or {})}.items():
            if active.conf.get(k, None) is None:
                try:
                    active.conf.set(k, v)
                except Exception:  # noqa: BLE001 - static confs cannot change at runtime
                    pass
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext          # classic sessions
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset."""
    sc = _context(spark)
    current = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get(CHECKPOINT_CONF, None)
    if not current and sc is not None:
        current = sc.getConf().get(CHECKPOINT_CONF, None)
    if current:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return (sc.getCheckpointDir() if sc is not None else None) or current
    # Unset: fine for a test or a laptop run, which gets a folder under /tmp.
    # Executors of a cluster would each write to a disk of their own.
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="runledger-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(local)
    spark.conf.set(CHECKPOINT_CONF, local)
    return (sc.getCheckpointDir() if sc is not None else None) or local


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path inside the shared checkpoint folder (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "runledger", *parts])


def fresh_scratch(spark: SparkSession, name: str) -> str:
    """A new, unique scratch folder for one job (stream checkpoints, outputs)."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
