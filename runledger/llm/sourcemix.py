"""Mixing sources to target weights by systematic sampling.

A source's target is its share of all words by weight, but at most a number of
times what it holds; what it cannot take is shared out again.  Every document
of a source is expected in target / size copies.  The expected copies are
summed up along the source's documents, ordered by size, one random offset is
added, and a document is emitted once per whole number that the running sum
crosses.  So copies differ by at most one, and because neighbours in the order
are of like size, the words taken stay within the largest document of the
target.  All sums are whole numbers of 2^-31 copies: no rounding, any order of
tasks gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store
from .ranks import ranked

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)        # of the sources in order of their names, repeating
MOST_COPIES = 3
SEED = 11
ONE = 1 << 31              # one copy, in units of the running sums


def words(text: str = "text") -> Column:
    """Words of the text (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _key(source: str = "source") -> Column:
    """The source without a null: ``s`` and its name, or ``~``, which comes
    after every ``s`` as null sources come last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("~"))


def _hash(seed: int, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), value), 256)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` (key, source_size; one row per source) with ``target``.

    The level is the words per unit of weight.  Sources that hold less than
    their part of it stop at ``most`` times their size, the level of the others
    rises, until no further source stops; each round is one sum over the
    sources, and only the level comes to the driver."""
    listed = ranked(sizes, [F.col("key")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    listed = store(listed.withColumn("weight", weight.cast("long")), "weights")
    level, stopped = 0.0, -1
    while True:
        full = F.col("source_size") * most < F.lit(level) * F.col("weight")
        total, capped, left, n = listed.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("source_size") * most).otherwise(0)),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if n == stopped or not left:
            break
        level, stopped = (total - capped) / left, n
    target = F.least(F.col("source_size") * F.lit(float(most)), F.lit(level) * F.col("weight"))
    return listed.select("key", "source_size", target.alias("target"))


def plan(docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS,
         most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """How often the mix takes each row of ``docs`` (doc_id, text, source).

    One row per row of ``docs``: ``row`` (its columns, or those of ``keep``),
    size, source_size, target (of its source), copies (at most ``most``), taken
    (words, copies counted).  ``weights`` are dealt to the sources in order of
    code point, null last, and repeat.  Null and blank texts have size 0 and
    are taken at the rate of their source; a source of such texts only has
    target 0 and no copies.  Rows of equal size are ordered by a seeded hash of
    their id, then by text, so reruns agree; rows equal in id, text and source
    are told apart by their place in the scan only.  An empty table gives no
    rows.  Columns of any name are carried in ``row``, so none clashes."""
    sized = docs.select(
        F.struct(*(keep or docs.columns)).alias("row"), _key().alias("key"), words().alias("size"),
        F.substring(_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 16).alias("lot"),
        F.xxhash64("text").alias("digest"))
    if keep:
        sized = store(sized, "sizes")            # small: the texts are read once
    sizes = store(sized.groupBy("key").agg(F.sum("size").alias("source_size")), "sources")
    placed = ranked(sized, [F.col("size"), F.col("lot"), F.col("digest")], within="key").drop("lot", "digest")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = F.floor(rate * ONE)                  # expected copies of one document
    part = F.pmod(units, F.lit(ONE))
    start = F.shiftright(F.conv(F.substring(_hash(seed, F.col("key")), 1, 8), 16, 10).cast("long"), 1)
    rates = store(targets(sizes, weights, most).select(
        "key", "source_size", "target", F.shiftright(units, 31).cast("int").alias("whole"), part.alias("part"),
        start.alias("start")), "rates")
    # the running sum at row k, start + k * part, passed a whole number in its last step
    crossed = F.pmod(F.pmod("rank", F.lit(ONE)) * F.col("part") + F.col("start"), F.lit(ONE)) < F.col("part")
    copies = F.col("whole") + crossed.cast("int")
    return placed.join(rates, "key").select(
        "row", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as ``row``, once per copy taken,
    with ``copy`` (from 1).  Cases as in ``plan``."""
    return plan(docs, None, weights, most, seed).filter("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, '~') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    substr(sha256('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS lot
  FROM documents),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY key) - 1) % 3 AS weight FROM s),
-- sources that stop first have the least size for their weight
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER first, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER first, 0) AS DOUBLE) AS level
  FROM w WINDOW first AS (ORDER BY source_size / CAST(weight AS DOUBLE), key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT key, source_size, least(3.0::DOUBLE * source_size, (SELECT arg_min(level, source_size / CAST(weight AS DOUBLE)) FROM l WHERE 3 * source_size >= level * weight) * weight) AS target FROM w),
r AS (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END * 2147483648) AS BIGINT) AS units,
    CAST('0x' || substr(sha256('11:' || key), 1, 8) AS BIGINT) // 2 AS start FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY size, lot) AS rank FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * ((CAST(rank AS HUGEINT) * units + start) // 2147483648 - (CAST(rank - 1 AS HUGEINT) * units + start) // 2147483648) AS BIGINT) AS taken
FROM k JOIN r USING (key)
"""
