"""File sources: bulk and incremental artifact discovery, hashing, text and
card readers.

A tree is listed level by level in the executors: each round's folders are
rows, and a task lists the folders it got (``pyarrow.fs``), so the listing is
a table and never a list on the driver.  All files count: empty ones, and
names that start with ``.`` or ``_`` (Spark's own file sources skip both).
Files that are read or hashed are dealt out by their sizes, and read in 1 MiB
chunks, so no file has to fit in one row.  Locations are plain names in every
reader (no URL encoding), relative to the root.
"""

from __future__ import annotations

import hashlib
import re
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_scratch

HASH_CHUNK = 1 << 20            # 1 MiB reads, as the store's server-side hasher
TASK_BYTES = 128 << 20          # files of about so many bytes make a task
BATCH_BYTES = 1 << 20           # texts of about so many bytes are in memory together, or one text
BATCH_ROWS = 256                # rows of texts that a Python worker gets at a time
# Hadoop's names of file systems that pyarrow calls otherwise
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def _strip_scheme(root: str) -> str:
    r = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", root)
    r = re.sub(r"^//+", "/", r)
    return r.rstrip("/")


def relative_location(path_col: str, root: str):
    """N-2: path relative to ``root`` (scheme and leading separators removed)."""
    r = _strip_scheme(root)
    return F.regexp_replace(F.col(path_col), "^.*?" + re.escape(r) + "/+", "")


def _qualified(spark: SparkSession, root: str) -> str:
    """``root`` with the scheme of the session's default file system if it has none."""
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", root):
        return root
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(jsc.hadoopConfiguration()).makeQualified(path).toString()


def _fs_and_path(uri: str):
    """File system and path of a URI; a bare path or ``file:`` is a local one, names taken as they are."""
    from pyarrow import fs as pafs
    m = re.match(r"^([a-zA-Z][a-zA-Z0-9+.-]*):(.*)$", uri)
    if not m:
        return pafs.LocalFileSystem(), uri
    scheme, rest = m[1].lower(), m[2]
    if scheme == "file":
        return pafs.LocalFileSystem(), re.sub(r"^/+", "/", rest)
    bucket, _, path = rest.lstrip("/").partition("/")
    filesystem, base = pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{bucket}")
    return filesystem, f"{base.rstrip('/')}/{path}" if path else base


def _sha256_file(uri: str, chunk: int = HASH_CHUNK) -> str | None:
    filesystem, p = _fs_and_path(uri)
    h = hashlib.sha256()
    try:
        with filesystem.open_input_stream(p) as f:
            while True:
                b = f.read(chunk)
                if not b:
                    break
                h.update(b)
    except FileNotFoundError:
        return None
    return h.hexdigest()


_LISTED = "rel string, folder boolean, size long, modified timestamp"


def _list_level(root: str):
    """Entries of the folders in ``rel`` (below ``root``), one level down."""
    def run(batches):
        from pyarrow import fs as pafs
        filesystem, base = _fs_and_path(root)
        base = base.rstrip("/")
        for pdf in batches:
            out = []
            for rel in pdf["rel"]:
                for e in filesystem.get_file_info(pafs.FileSelector(f"{base}/{rel}" if rel else base)):
                    if e.type in (pafs.FileType.File, pafs.FileType.Directory):
                        folder = e.type == pafs.FileType.Directory
                        out.append((f"{rel}/{e.base_name}" if rel else e.base_name, folder, None if folder else e.size, e.mtime))
            yield pd.DataFrame(out, columns=["rel", "folder", "size", "modified"]).astype(
                {"folder": bool, "size": "Int64", "modified": "datetime64[us, UTC]"})
    return run


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``: rel, size, modified.  One job per folder
    level; the table is written once to the shared folder."""
    out = fresh_scratch(spark, "listing")
    level, depth = spark.createDataFrame([("",)], "rel string"), 0
    while True:
        found = level.mapInPandas(_list_level(root), _LISTED)
        found.write.parquet(f"{out}/depth={depth}")
        folders = spark.read.schema(_LISTED).parquet(f"{out}/depth={depth}").where("folder").select("rel")
        n = folders.count()
        if not n:
            break
        level, depth = folders.repartition(min(n, 16 * spark.sparkContext.defaultParallelism)), depth + 1
    return spark.read.schema(_LISTED).parquet(*[f"{out}/depth={d}" for d in range(depth + 1)]).where("NOT folder").drop("folder")


def list_files(spark: SparkSession, root: str, node_level: bool = True) -> DataFrame:
    """S-1/S-4 listing: ``path, node_name, location, size, modified``; no bytes read.

    ``node_name`` is the first folder level (null for a file at the root) and
    ``location`` the rest, unless ``node_level`` is false."""
    root = _qualified(spark, root)
    rel = F.col("rel")
    inner = rel.contains("/") if node_level else F.lit(False)
    return _listing(spark, root).select(
        F.concat(F.lit(root.rstrip("/") + "/"), rel).alias("path"),
        F.when(inner, F.substring_index(rel, "/", 1)).alias("node_name"),
        F.when(inner, F.expr("substr(rel, instr(rel, '/') + 1)")).otherwise(rel).alias("location"), "size", "modified")


def _by_bytes(listing: DataFrame) -> DataFrame:
    """Files dealt to tasks of some ``TASK_BYTES`` each, at least one task per core."""
    n, size = listing.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    cores = listing.sparkSession.sparkContext.defaultParallelism
    return listing.repartition(max(1, min(n, max(cores, -(-size // TASK_BYTES)))), F.xxhash64("path"))


def hash_listed(listing: DataFrame) -> DataFrame:
    """Chunked SHA-256 of every listed ``path`` (runs in the executors)."""
    out_schema = T.StructType(listing.schema.fields + [T.StructField("hash", T.StringType())])

    def run(batches):
        for pdf in batches:
            pdf = pdf.copy()
            pdf["hash"] = [_sha256_file(p) for p in pdf["path"]]
            yield pdf

    return _by_bytes(listing).mapInPandas(run, out_schema)


def scan_artifacts(spark: SparkSession, root: str, node_level: bool = True) -> DataFrame:
    """S-1: every file under ``root`` with its SHA-256, keyed as ``list_files`` does."""
    return hash_listed(list_files(spark, root, node_level))


def new_artifacts(spark: SparkSession, root: str, catalog_keys: DataFrame) -> DataFrame:
    """S-2: files not yet in the catalog, hashed after the existence check.

    The listing (no bytes) is anti-joined with the catalog's
    ``(node_name, location)`` keys first; only the survivors are read."""
    known = catalog_keys.select(F.col("node_name").alias("_node"), F.col("location").alias("_location"))
    fresh = list_files(spark, root).join(
        known, F.col("node_name").eqNullSafe(F.col("_node")) & (F.col("location") == F.col("_location")), "left_anti")
    return hash_listed(fresh)


def verify_artifacts(actual: DataFrame, catalog: DataFrame) -> DataFrame:
    """S-5 / J-8: stored vs actual hash per (node, location).

    ``ok`` equal, ``mismatch`` different (a warning in the reference),
    ``missing`` catalogued but not on disk, ``untracked`` on disk only."""
    a = actual.select("node_name", "location", F.col("hash").alias("actual_hash"), F.lit(True).alias("_there"))
    c = catalog.select("node_name", "location", F.col("hash").alias("expected_hash"), F.lit(True).alias("_known"))
    j = c.join(a, ["node_name", "location"], "full_outer")
    status = (F.when(F.col("_known").isNull(), F.lit("untracked"))
              .when(F.col("_there").isNull(), F.lit("missing"))
              .when(F.col("actual_hash") == F.col("expected_hash"), F.lit("ok"))
              .otherwise(F.lit("mismatch")))
    return j.select("node_name", "location", "expected_hash", "actual_hash", status.alias("status"))


def transfer_audit(source: DataFrame, target: DataFrame) -> DataFrame:
    """K-17 re-aimed as a bulk copy audit of two scanned trees:
    ``copied`` (same hash), ``mismatch``, ``missing`` (not at the target),
    ``extra`` (only at the target)."""
    s = source.select("location", F.col("hash").alias("source_hash"))
    t = target.select("location", F.col("hash").alias("target_hash"))
    j = s.join(t, "location", "full_outer")
    status = (F.when(F.col("source_hash").isNull(), F.lit("extra"))
              .when(F.col("target_hash").isNull(), F.lit("missing"))
              .when(F.col("source_hash") == F.col("target_hash"), F.lit("copied"))
              .otherwise(F.lit("mismatch")))
    return j.select("location", "source_hash", "target_hash", status.alias("status"))


def object_listing(spark: SparkSession, root: str, page: int | None = None,
                   start_after: str | None = None) -> DataFrame:
    """S-4: the keys and sizes of an object store (content pruned).

    All keys; with ``page``, the first that many in key order after
    ``start_after`` (a per-partition top-k and a merge), so that pages follow
    one another until one comes back short."""
    keys = list_files(spark, root, node_level=False).select(F.col("location").alias("key"), "size")
    if start_after is not None:
        keys = keys.where(F.col("key") > F.lit(start_after))
    return keys if page is None else keys.orderBy("key").limit(page)


def _read_all(listing: DataFrame) -> DataFrame:
    """``listing`` with ``content``, the whole file as UTF-8 text."""
    schema = T.StructType(listing.schema.fields + [T.StructField("content", T.StringType())])

    def run(batches):
        for pdf in batches:
            texts, held = [], 0
            for k, path in enumerate(pdf["path"]):
                texts.append(_bytes_of(path).decode("utf-8", "replace"))
                held += len(texts[-1])
                if held >= BATCH_BYTES or k + 1 == len(pdf):
                    yield pdf.iloc[k + 1 - len(texts):k + 1].assign(content=texts)
                    texts, held = [], 0

    return _by_bytes(listing).mapInPandas(run, schema)


def artifact_text(spark: SparkSession, root: str) -> DataFrame:
    """S-6 / C-8: one record per file: node, location and content."""
    return _read_all(list_files(spark, root)).select("node_name", "location", "content")


def read_dataset_cards(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """S-7: JSON-LD dataset cards, one document per file."""
    r = spark.read.option("multiLine", "true")
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_card_texts(spark: SparkSession, path: str) -> DataFrame:
    """S-8: card files as whole texts (``card_id`` = path below the root without .md)."""
    return _read_all(list_files(spark, path, node_level=False)).select(
        F.regexp_replace("location", r"\.md$", "").alias("card_id"), F.col("content").alias("text"))


def write_text_files(rows: DataFrame, root: str, overwrite: bool = True) -> int:
    """Write ``(rel, text)`` rows as one UTF-8 file each under ``root``.

    Runs in the executors (``pyarrow.fs``, so any URI the cluster reaches);
    a retried task rewrites the same paths.  With ``overwrite`` false an
    existing file is an error.  Returns the number of files written."""
    def run(batches):
        from pyarrow import fs as pafs
        filesystem, base = _fs_and_path(root)
        for pdf in batches:
            n = 0
            for rel, text in zip(pdf["rel"], pdf["text"]):
                p = f"{base.rstrip('/')}/{rel}"
                if not overwrite and filesystem.get_file_info(p).type != pafs.FileType.NotFound:
                    raise FileExistsError(p)
                filesystem.create_dir(p.rsplit("/", 1)[0], recursive=True)
                with filesystem.open_output_stream(p) as f:
                    f.write((text or "").encode("utf-8"))
                n += 1
            yield pd.DataFrame({"n": [n]})

    with _small_batches(rows.sparkSession):
        return rows.select("rel", "text").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


@contextmanager
def _small_batches(spark: SparkSession):
    """Jobs run here hand ``BATCH_ROWS`` rows to Python at a time, so that a
    worker's memory does not grow with its partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _bytes_of(uri: str) -> bytes:
    filesystem, p = _fs_and_path(uri)
    with filesystem.open_input_stream(p) as f:
        return f.read()


def custom_load(files: DataFrame, load_fn, schema) -> DataFrame:
    """X-7: apply a user loader ``load_fn(path, content: bytes) -> dict`` to
    every file of a listing (or of rows that hold their ``content``); runs in
    ``mapInPandas``, one file's bytes in memory at a time."""
    held = "content" in files.columns

    def run(batches):
        for pdf in batches:
            rows = [load_fn(p, c if held else _bytes_of(p)) for p, c in zip(pdf["path"], pdf["content"] if held else pdf["path"])]
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return (files.select("path", "content") if held else _by_bytes(files.select("path", "size"))).mapInPandas(run, schema)
