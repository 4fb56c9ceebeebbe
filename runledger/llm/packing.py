"""Best-fit packing by hierarchical residual merging.

Every partition tokenises its documents, cuts those longer than a sequence and
packs the pieces best-fit, longest first, into bins.  Nearly full bins are
final.  The underfull bins of all partitions become items of a merge tree:
each round deals them to tasks of bounded size, which pack them best-fit
again, until one task has seen all that is left or a round merges next to
nothing.  Piece rows never move during the rounds; a bin keeps the id of its
first member, so a round only records (absorbed bin, absorbing bin, offset).
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, store, text_of
from .tokens import vocabulary_path, word_ids

CAPACITY = 1024
END_ID = 2
SLACK = 32              # a bin with less room than this is final ("nearly full")
MERGE_TASK_BINS = 16_000
LEAST_GAIN = 0.01       # a round that absorbs a smaller share of its bins ends the tree

PIECES = ("doc_id {id}, piece int, start long, length long, ids_crc32 long, "
          "bin long, offset long, fill long, ids array<int>")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit, longest first.  Returns each item's bin (numbered by its first
    item's index), its offset there, and the bin's final fill."""
    n = len(lengths)
    home, offset, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]     # open bins by residual
    some = 0                                                     # bit r: room[r] is not empty
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            b, r = i, capacity
        home[i], offset[i] = b, capacity - r
        fill[b] = capacity - r + size
        r -= size
        if r:
            room[r].append(b)
            some |= 1 << r
    return home, offset, fill[home]


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pack_partition(path: str, capacity: int, end_id: int, with_ids: bool):
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, rows, kept = word_ids(path), [], []
        for pdf in batches:
            for doc, ids in zip(pdf["doc_id"].tolist(), words.encode(pdf["text"].tolist()), strict=True):
                ids += end
                for k, (s, n) in enumerate(_cut(len(ids) // 4, capacity)):
                    cut = ids[4 * s:4 * (s + n)]
                    rows.append((doc, k, s, n, zlib.crc32(cut)))
                    kept.append(np.frombuffer(cut, "<i4") if with_ids else None)
        if not rows:
            return
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        home, offset, fill = best_fit(out["length"].to_numpy(), capacity)
        out["bin"] = home + (TaskContext.get().partitionId() << 36)
        out["offset"], out["fill"], out["ids"] = offset, fill, kept
        for s in range(0, len(out), 20_000):
            yield out.iloc[s:s + 20_000]
    return run


def _merge_task(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        if not got:
            return
        bins = pd.concat(got).sort_values("bin", ignore_index=True)
        home, offset, fill = best_fit(bins["fill"].to_numpy(), capacity)
        ids = bins["bin"].to_numpy()
        yield pd.DataFrame({"bin": ids, "into": ids[home], "shift": offset, "fill": fill})
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK,
         path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and ``ids`` if ``with_ids``.  A null text is an empty one (its one
    piece is the end id).  Rows are packed one by one: repeated rows and null
    ids each get their own pieces.  An empty table gives no rows.  Other
    columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text")).mapInPandas(
        _pack_partition(path or vocabulary_path(), capacity, end_id, with_ids), PIECES.format(id=id_type))
    pieces = store(rows if with_ids else rows.drop("ids"), "pieces")
    bins = pieces.filter((F.col("offset") == 0) & (F.col("fill") <= capacity - slack)).select("bin", "fill")
    rounds: list[DataFrame] = []
    left, before = bins.count(), None
    while left > 1:
        tasks = -(-left // MERGE_TASK_BINS)
        dealt = bins.repartition(tasks, F.xxhash64("bin", F.lit(len(rounds))))
        merged = store(dealt.mapInPandas(_merge_task(capacity), "bin long, into long, shift long, fill long"), "merge")
        rounds.append(merged.filter("bin != into").select("bin", "into", "shift"))
        bins = merged.filter((F.col("bin") == F.col("into")) & (F.col("fill") <= capacity - slack)).select("bin", "fill")
        before, left = left, merged.filter("bin = into").count()
        if tasks == 1 or before - left < LEAST_GAIN * before:
            break
        left = bins.count()
    if not rounds:
        return pieces.withColumnRenamed("bin", "sequence_id").drop("fill")

    def follow(later: DataFrame, now: DataFrame) -> DataFrame:
        """Absorbed bins of an earlier round, sent on where their new bin was absorbed later."""
        on = later.select(F.col("bin").alias("into"), F.col("into").alias("onto"), F.col("shift").alias("more"))
        sent = now.join(on, "into", "left").select(
            "bin", F.coalesce("onto", "into").alias("into"),
            (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        return later.unionByName(sent)

    moves = reduce(follow, reversed(rounds))
    return (pieces.join(moves, "bin", "left")
            .withColumn("sequence_id", F.coalesce("into", "bin"))
            .withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                    *(["ids"] if with_ids else [])))
