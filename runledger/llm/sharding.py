"""Two-pass external shuffle into shards of equal row counts.

Pass one reads only sizes and fixes how many buckets of bounded size the rows
need.  Pass two scatters every row to a bucket by a seeded hash of the whole
row, shuffles each bucket in memory with Spark's ``shuffle`` (Fisher-Yates)
and writes it.  A bucket's place in the global order is the sum of the bucket
counts before it, so the order is a shuffle of all rows; shard ``k`` of ``n``
is the k-th of n ranges of that order whose lengths differ by one at most.
Buckets are dealt row by row, so copies, a hot source or a hot key spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, store

SHARDS = 24
BUCKET_BYTES = 32 << 20
ROW_BYTES = 8
COUNT_GROUPS = 1024


def row_bytes(text: str = "text"):
    """UTF-8 bytes of the text (null: none) plus a fixed cost per row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _before(counts: DataFrame) -> DataFrame:
    """(bucket, before): rows in earlier buckets.  Two levels, so that no task
    sorts more than one group of buckets, however many there are."""
    group = F.floor(F.col("bucket") / COUNT_GROUPS)
    inner = counts.withColumn("g", group).withColumn(
        "inside", F.sum("n").over(Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    tops = counts.groupBy(group.alias("g")).agg(F.sum("n").alias("m"))
    tops = tops.select("g", F.sum("m").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)).alias("outside"))
    return inner.join(tops, "g").select(
        "bucket", (F.coalesce("inside", F.lit(0)) + F.coalesce("outside", F.lit(0))).alias("before"))


def shuffle_rows(docs: DataFrame, seed: int = 1, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """All rows of ``docs`` in a seeded random order, stored as (position, row),
    and their number.  ``docs`` should be a stored table: a row's place in the
    scan parts it from equal rows, and a task that runs again must find it there."""
    n, size = docs.agg(F.count("*"), F.sum(row_bytes())).first()
    if not n:
        empty = docs.select(F.lit(0).cast("long").alias("position"), F.struct("*").alias("row"))
        return empty, 0
    buckets = max(shuffle_width(docs.sparkSession), -(-size // bucket_bytes))
    # equal rows would share a hash: their place in the scan parts them
    scattered = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))
    scattered = scattered.select("row", F.xxhash64(F.lit(seed), "at").alias("h"))
    scattered = scattered.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
    dealt = scattered.repartitionById(buckets, "bucket")
    mixed = dealt.groupBy("bucket").agg(
        F.shuffle(F.sort_array(F.collect_list(F.struct("h", "row"))), seed).alias("rows"))
    placed = store(mixed.select("bucket", F.posexplode("rows").alias("at", "it")).select("bucket", "at", "it.row"),
                   "shuffled")
    before = _before(placed.groupBy("bucket").agg(F.count("*").alias("n")))
    return placed.join(F.broadcast(before) if buckets <= 100_000 else before, "bucket").select(
        (F.col("before") + F.col("at")).alias("position"), "row"), n


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 1, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` (with a ``text`` column) under the law ``rows``: shard sizes at
    most one row apart.  Returns every row's columns as ``row``, with ``shard``
    and ``slot`` (gapless from 0 in each shard, in shuffled order).

    Null texts and ids are rows like any other; equal rows get slots of their
    own; an empty table gives no rows; columns of any name are carried inside
    ``row``, so none clashes.
    """
    placed, n = shuffle_rows(docs, seed, bucket_bytes)
    share, more = divmod(n, shards)
    cut = more * (share + 1)                        # the first shards have a row more
    p = F.col("position")
    k = F.when(p < cut, F.floor(p / (share + 1))).otherwise(
        more + (F.floor((p - cut) / share) if share else F.lit(0))).cast("int")
    start = F.when(k < more, k.cast("long") * (share + 1)).otherwise(cut + (k.cast("long") - more) * share)
    return placed.select("row", k.alias("shard"), (p - start).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One Parquet folder per shard, rows in slot order within each file."""
    (sharded.select("shard", "slot", "row").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
