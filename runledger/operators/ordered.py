"""Order-dependent operators that must not collapse into one task.

A window with no PARTITION BY (or partitioned by a hot key) pulls a whole
table - or a third of it - into one task.  ``first_after`` and
``next_in_group`` split the time axis into ``n_buckets`` ranges whose
boundaries are approximate quantiles of the data, so every bucket holds about
the same number of rows no matter how keys or days are skewed.  Each bucket
is solved with a partitioned window, and what crosses a bucket edge is
carried by a small per-bucket table whose size is bounded by ``n_buckets``
(times the number of keys for the keyed form).  ``top_k_per_group`` salts a
group before ranking and ranks the survivors once more.

``next_in_group`` also gives an instant holding many rows its own bucket
and splits it by the tie column, so one key at one instant is not one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import epoch_micros

DEFAULT_BUCKETS = 64


def _micros(c):
    """Epoch microseconds as double (exact below 2^53) for an NTZ column."""
    return epoch_micros(c).cast("double")


def quantile_bounds(frames: list[DataFrame], n_buckets: int) -> list[float]:
    """Approximate quantile boundaries of the ``_x`` column across frames.

    Returns at most ``n_buckets - 1`` sorted, distinct values (one small
    driver action; the size is fixed by ``n_buckets``)."""
    if n_buckets <= 1:
        return []
    allx = reduce(lambda a, b: a.unionByName(b), [f.select("_x") for f in frames])
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = allx.approxQuantile("_x", probs, 1.0 / (4 * n_buckets))
    return sorted(set(q for q in qs if q is not None))


def bucket_of(x, bounds: list[float]):
    """Number of boundaries <= x: a monotone bucket id in [0, len(bounds)]."""
    if not bounds:
        return F.lit(0)
    expr = None
    for i, b in enumerate(bounds):
        cond = x < F.lit(b)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(len(bounds)))


def first_after(events: DataFrame, event_time: str, marks: DataFrame, mark_time: str,
                mark_value: str, out: str, n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Forward as-of join, strict: for every event row, the ``mark_value`` of
    the earliest mark whose ``mark_time`` is strictly later than the event's
    time (ties between marks: lowest value).  NULL when no later mark exists.

    With at most ``n_buckets`` distinct mark times the join is a bucket
    lookup against a broadcast table of those marks.  Otherwise work is done
    once per distinct event time, so a hot timestamp costs one row, and the
    result is joined back to ``events`` on the time column."""
    mk = marks.select(F.col(mark_time).alias("_t"), F.col(mark_value).alias("_v")) \
        .where(F.col("_t").isNotNull() & F.col("_v").isNotNull())

    # Few distinct mark times (the usual case: runs are rare): every mark
    # time is a bucket boundary, so an event in bucket b is answered by the
    # mark at boundary b - a map-side lookup, no window and no shuffle of
    # the events.  At most n_buckets + 1 times come to the driver.
    few = [r["_x"] for r in mk.select(_micros("_t").alias("_x")).distinct().limit(n_buckets + 1).collect()]
    if len(few) <= n_buckets:
        bounds = sorted(few)
        at_bound = (mk.groupBy("_t").agg(F.min("_v").alias(out))
                    .select((bucket_of(_micros("_t"), bounds) - 1).alias("_b"), out))
        ev = events.withColumn("_b", bucket_of(_micros(event_time), bounds))
        return ev.join(F.broadcast(at_bound), "_b", "left").drop("_b")   # <= n_buckets rows

    times = events.select(F.col(event_time).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    tx = times.select(_micros("_t").alias("_x"))
    mx = mk.select(_micros("_t").alias("_x"))
    bounds = quantile_bounds([tx, mx], n_buckets)
    nb = len(bounds) + 1

    t_b = times.withColumn("_b", bucket_of(_micros("_t"), bounds))
    m_b = mk.withColumn("_b", bucket_of(_micros("_t"), bounds))

    # within a bucket: marks sort before events at equal time, so the frame
    # "current row .. end" sees only strictly later marks
    u = (m_b.select("_b", "_t", F.lit(0).alias("_k"), "_v")
         .unionByName(t_b.select("_b", "_t", F.lit(1).alias("_k"), F.lit(None).cast(mk.schema["_v"].dataType).alias("_v"))))
    w = (Window.partitionBy("_b").orderBy("_t", "_k", "_v")
         .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    inside = (u.withColumn("_in", F.first("_v", ignorenulls=True).over(w))
              .where(F.col("_k") == 1).select("_b", "_t", "_in"))

    # across buckets: first mark of the nearest later bucket (table of nb rows)
    spark = events.sparkSession
    per_bucket = m_b.groupBy("_b").agg(F.min_by("_v", F.struct("_t", "_v")).alias("_fv"))
    grid = spark.range(nb).select(F.col("id").cast("int").alias("_b"))
    wc = Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    carry = (grid.join(per_bucket, "_b", "left")
             .select("_b", F.first("_fv", ignorenulls=True).over(wc).alias("_carry")))

    solved = (inside.join(F.broadcast(carry), "_b", "left")   # nb rows: bounded by n_buckets
              .select(F.col("_t"), F.coalesce("_in", "_carry").alias(out)))
    return events.join(solved, events[event_time] == solved["_t"], "left").drop("_t")


def _hot_instant_buckets(b: DataFrame, x: str, tie_col: str, n_buckets: int):
    """Time buckets, plus sub-buckets by ``tie_col`` for hot instants.

    An instant that fills at least one quantile gap (about 1/n_buckets of the
    rows) gets a bucket of its own, and its rows are split by approximate
    quantiles of the tie column, so (time, tie) order is kept and no instant
    lands whole in one partition.  Returns a bucket-id column."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = [q for q in b.approxQuantile(x, probs, 1.0 / (4 * n_buckets)) if q is not None]
    hot = sorted({q for q in qs if qs.count(q) >= 2})
    bounds = sorted(set(qs) | {h + 1.0 for h in hot})
    tb = bucket_of(F.col(x), bounds)
    if not hot:
        return tb
    # tie quantiles inside each hot instant: one small aggregation, at most
    # len(hot) x n_buckets values come to the driver
    pct = (b.where(F.col(x).isin(hot)).groupBy(x)
           .agg(F.percentile_approx(F.col(tie_col).cast("double"), probs, 4 * n_buckets).alias("_p"))
           .collect())
    sub = F.lit(0)
    for r in pct:
        tie_bounds = sorted(set(v for v in r["_p"] if v is not None))
        sub = F.when(F.col(x) == F.lit(r[x]), bucket_of(F.col(tie_col).cast("double"), tie_bounds)).otherwise(sub)
    return tb * F.lit(n_buckets + 1) + sub


def next_in_group(df: DataFrame, keys: list[str], time_col: str, tie_col: str,
                  carry_cols: list[str], n_buckets: int = DEFAULT_BUCKETS,
                  prefix: str = "next_") -> DataFrame:
    """``lead`` of ``carry_cols`` within each key, ordered by (time, tie).

    Rows are split into (key, time-bucket) partitions so a hot key is spread
    over ``n_buckets`` tasks, and a hot instant is split again by the tie
    column (numeric); the last row of a partition takes its successor from
    the first row of the next non-empty bucket of the same key."""
    base = df.withColumn("_x", _micros(time_col))
    b = base.withColumn("_b", _hot_instant_buckets(base.where(F.col("_x").isNotNull()), "_x", tie_col,
                                                   n_buckets)).drop("_x")
    order = [time_col, tie_col]
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    lead_cols = [F.lead(c).over(w).alias(prefix + c) for c in carry_cols]
    inside = b.select("*", *lead_cols, F.lead(F.lit(1)).over(w).isNull().alias("_last"))

    # first row of every (key, bucket); the carry for bucket b is the first
    # row of the nearest later non-empty bucket of the same key.  This table
    # has at most n_buckets (plus hot-instant sub-buckets) rows per key.
    first_row = (b.groupBy(*keys, "_b")
                 .agg(F.min_by(F.struct(*carry_cols), F.struct(*order)).alias("_first")))
    wk = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    carry = first_row.select(*keys, "_b", F.first("_first", ignorenulls=True).over(wk).alias("_carry"))
    out = inside.join(carry, [*keys, "_b"], "left")
    fills = [F.when(F.col("_last"), F.col("_carry")[c]).otherwise(F.col(prefix + c)).alias(prefix + c)
             for c in carry_cols]
    keep = [c for c in inside.columns
            if c not in {prefix + c2 for c2 in carry_cols} and c not in ("_b", "_last")]
    return out.select(*keep, *fills)


def top_k_per_group(df: DataFrame, keys: list[str], order: list, k: int, rank_col: str = "rank",
                    salts: int = 32, salt_col: str | None = None) -> DataFrame:
    """The first ``k`` rows per group in ``order`` (row_number semantics).

    Two phases, so a group holding a third of all rows is never ranked in
    one task: the top ``k`` within (group, salt) first - the salt spreads a
    hot group over ``salts`` tasks - then the top ``k`` of those at most
    ``salts * k`` candidates per group.  ``order`` must be a total order
    (end it with a unique column) for the result to be deterministic."""
    salt = F.pmod(F.xxhash64(*([F.col(salt_col)] if salt_col else [F.struct(*df.columns)])), F.lit(salts))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cand = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
            .where(F.col("_r1") <= k).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return cand.withColumn(rank_col, F.row_number().over(w2).cast("long")).where(F.col(rank_col) <= k)
