"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments; for every segment the small Hamming ball
around its value is enumerated with the other segments as they are, and each
such point is a key of the match table.  Two fingerprints within two bits
meet: if their bits differ in one segment, at a point of that segment's
balls; if they differ in one bit of two segments, where one ball's point in
the first segment is the other's in the second.  A key holds at most 65
different fingerprints however many rows are alike, so no key is hot, and the
complete distance is checked for each match.  Links go to the connected
components of distinct fingerprints; rows join their fingerprint at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, store, text_of
from .components import components

SHINGLE = 3
MAX_DISTANCE = 2
SEGMENTS = 4
BITS = 64
SUM_BLOCK = 1 << 16       # shingles whose bits are summed at once


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, as a signed integer."""
    import xxhash
    words = text.encode().lower().split()       # ASCII only, as the words are defined
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)]
    h = np.array(hashes, "<u8")
    ones = np.zeros(BITS, np.int64)
    for s in range(0, len(h), SUM_BLOCK):
        bits = np.unpackbits(h[s:s + SUM_BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": pdf["digest"],
                                "bits": [fingerprint(t, shingle) for t in pdf["text"]]})
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, digest of the text, bits) of whole texts; a null or blank text
    has fingerprint zero."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text"), _digest("text").alias("digest")).mapInPandas(
        _fingerprints(shingle), f"doc_id {id_type}, digest long, bits long")


def _digest(text: str) -> Column:
    return F.xxhash64(text_of(text))


def _ball(bits: str, first: int, n: int) -> str:
    """SQL for the points one bit away within a segment."""
    return f"transform(sequence({first}, {first + n - 1}), i -> {bits} ^ shiftleft(1L, i))"


def links(marks: DataFrame, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(a, b) links that join all distinct ``bits`` within ``max_distance``:
    from each key's least fingerprint to its others, complete distance checked."""
    if max_distance != 2:
        raise ValueError("balls of one bit in each segment find distances of up to two bits")
    width = BITS // segments
    balls = ", ".join(_ball("bits", k * width, width) for k in range(segments))
    # a small table grows 65-fold here: dealt to all tasks before it does
    keyed = marks.repartition(shuffle_width(marks.sparkSession), "bits").select("bits", F.explode(F.expr(f"concat(array(bits), {balls})")).alias("key"))
    matched = keyed.groupBy("key").agg(F.collect_set("bits").alias("near")).filter("size(near) > 1")
    return (matched.select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
            .filter(f"a != b AND bit_count(a ^ b) <= {max_distance}").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text).

    One row per row of ``docs``: doc_id, digest (of the text), bits,
    component_id (the smallest doc_id reachable over links of at most
    ``max_distance`` bits).  Null and
    blank texts have fingerprint zero and are linked like any other; repeated
    rows fall together; a null id is never the smallest unless a group has no
    other.  An empty table gives no rows.  Other columns are not read.
    """
    marks = store(fingerprints(docs, shingle), "fingerprints")
    distinct = marks.groupBy("bits").agg(F.min("doc_id").alias("first_id"))
    groups = components(links(distinct.select("bits"), max_distance))
    named = distinct.join(groups, distinct["bits"] == groups["node"], "left").select(
        "bits", "first_id", F.coalesce("component", "bits").alias("component"))
    named = store(named, "named")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return (marks.join(named.join(least, "component").select("bits", "component_id"), "bits")
            .select("doc_id", "digest", "bits", "component_id"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of each near-duplicate group, the first by (doc_id, digest),
    with all its columns as they are.  Rows alike in both count as one."""
    groups = near_duplicates(docs, shingle, max_distance)
    first = F.min(F.struct("doc_id", "digest", "n")).alias("first")
    alike = groups.groupBy("component_id", "doc_id", "digest").agg(F.count("*").alias("n"))
    kept = store(alike.groupBy("component_id").agg(first).select(
        F.col("first.doc_id").alias("kept_id"), F.col("first.digest").alias("kept_digest"), F.col("first.n").alias("kept_n")), "kept")
    rows = docs.select(F.struct("*").alias("row"), _digest("text").alias("digest"))
    # the same join at every size: a broadcast of what is small today would hide its cost
    rows = rows.join(kept.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")))
    once = rows.filter("kept_n = 1").select("row")
    again = rows.filter("kept_n > 1").dropDuplicates(["kept_id", "kept_digest"]).select("row")
    return once.unionByName(again).select("row.*")
