"""Stand-in file trees built from the driver tables.

The file-discovery queries need a directory of files.  These helpers write
one file per ``documents`` row into the shared checkpoint folder, laid out as
``<root>/<source>/<lang>/<doc_id><ext>`` - the same node / location keys the
derived ``artifacts`` catalog uses.  They only produce input; scanning,
hashing and comparing is the job of ``sources.files``.

Writes run in the executors (``mapInPandas`` + ``pyarrow.fs``), are
idempotent (a retried task rewrites the same paths), and a ``_COMPLETE``
marker lets later queries reuse a finished tree.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .files import _fs_and_path, write_text_files
from .tables import load

MARKER = "_COMPLETE"          # beside the tree, not in it: every file of a tree is input


def _ext():
    return (F.when(F.col("doc_id") % 4 == 0, ".json")
            .when(F.col("doc_id") % 4 == 1, ".md").otherwise(".txt"))


def _write_rows(rows: DataFrame, root: str) -> int:
    return write_text_files(rows, root)


def _done(root: str) -> bool:
    filesystem, base = _fs_and_path(root)
    from pyarrow import fs as pafs
    return filesystem.get_file_info(f"{base.rstrip('/')}{MARKER}").type == pafs.FileType.File


def _mark(root: str, info: dict) -> None:
    filesystem, base = _fs_and_path(root)
    with filesystem.open_output_stream(f"{base.rstrip('/')}{MARKER}") as f:
        f.write(json.dumps(info).encode())


def _key(sf_dir: str, variant: str) -> str:
    return variant + "-" + hashlib.sha1(sf_dir.encode()).hexdigest()[:10]


def document_tree(spark: SparkSession, sf_dir: str) -> str:
    """Every document as ``<source>/<lang>/<doc_id><ext>``."""
    root = scratch_path(spark, "standin", _key(sf_dir, "docs"))
    if not _done(root):
        d = load(spark, sf_dir, "documents")
        rows = d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), _ext()))
                        .alias("rel"), "text")
        n = _write_rows(rows, root)
        _mark(root, {"files": n})
    return root


#: DuckDB twin of ``odd_tree``'s names and texts
ODD_SQL = """SELECT source AS node_name, lang || '/' || CASE doc_id % 5 WHEN 0 THEN '.' || doc_id WHEN 1 THEN '_' || doc_id WHEN 2 THEN 'a file ' || doc_id || ' %20+é.txt'
             WHEN 3 THEN doc_id || '.txt' ELSE '_hidden/.deep/' || doc_id END AS location,
             CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text FROM documents"""


def odd_tree(spark: SparkSession, sf_dir: str) -> str:
    """Every document as a file of an awkward name: hidden, with blanks and
    signs, in hidden folders; every third is empty."""
    root = scratch_path(spark, "standin", _key(sf_dir, "odd"))
    if not _done(root):
        d, i = load(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
        k = F.col("doc_id") % 5
        name = (F.when(k == 0, F.concat(F.lit("."), i)).when(k == 1, F.concat(F.lit("_"), i))
                .when(k == 2, F.concat(F.lit("a file "), i, F.lit(" %20+é.txt"))).when(k == 3, F.concat(i, F.lit(".txt")))
                .otherwise(F.concat(F.lit("_hidden/.deep/"), i)))
        rows = d.select(F.concat_ws("/", "source", "lang", name).alias("rel"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("text"))
        _mark(root, {"files": _write_rows(rows, root)})
    return root


def copied_tree(spark: SparkSession, sf_dir: str) -> str:
    """A copy of ``document_tree`` as a transfer left it: documents whose id
    ends in 0 were not copied (a ``.bak`` file sits there instead), and
    documents with id divisible by 7 arrived altered."""
    root = scratch_path(spark, "standin", _key(sf_dir, "copy"))
    if not _done(root):
        d = load(spark, sf_dir, "documents")
        base = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
        rows = d.select(
            F.when(F.col("doc_id") % 10 == 0, F.concat(base, F.lit(".bak")))
             .otherwise(F.concat(base, _ext())).alias("rel"),
            F.when((F.col("doc_id") % 7 == 0) & (F.col("doc_id") % 10 != 0), F.concat("text", F.lit(" [edited]")))
             .otherwise(F.col("text")).alias("text"))
        n = _write_rows(rows, root)
        _mark(root, {"files": n})
    return root
