"""Benchmark decontamination over canonical templates, DataFrame functions only.

Words keep their place but lose what a re-parameterised question changes:
numbers, names (capitalised inside a sentence, not all in capitals) and units (after a number, or a
sign) become typed placeholders wherever a plain word stands next to them.
Windows of template words are hash-joined with the benchmark's.  Along one
alignment of an item in a document the values must map slot by slot without
contradiction; the windows of alignments that do count for the item's
coverage.  A first pass keeps only the ids of documents that share a window,
so the texts themselves are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

WINDOW = 6
COVERAGE = 0.3
BROADCAST_ROWS = 1_000_000     # windows or ids of some 24 bytes each; beyond it joins shuffle

# fixed values: units that may follow a number, and signs that stand for one
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
         "mg", "g", "kg", "gram", "grams", "ton", "tons", "ounce", "ounces", "pound", "pounds", "lb", "lbs",
         "ml", "l", "litre", "litres", "liter", "liters", "gallon", "gallons", "cup", "cups",
         "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
         "month", "months", "year", "years", "percent", "degree", "degrees", "dollar", "dollars",
         "euro", "euros", "cent", "cents", "mph", "kmh", "watt", "watts", "volt", "volts")
SIGNS = ("%", "$", "€", "£", "°")
STOPS = (".", "!", "?", "\n")

# possessive: a plain repeat of a group recurses, and a long list of numbers ends the JVM
TOKEN = r"[\p{L}\p{M}]++(?:['’][\p{L}\p{M}]++)*+|[0-9]++(?:[.,:/][0-9]++)*+|[%$€£°.!?\n]"


def _listed(values) -> str:
    return ", ".join("'" + v.replace("\n", "\\n") + "'" for v in values)


def with_template(rows: DataFrame) -> DataFrame:
    """``rows`` (…, text) with ``kinds_``: array of (value, kind), kind 0 for a
    plain word, 1 a number, 2 a unit, 3 a name."""
    digit = "BETWEEN '0' AND '9'"
    made = rows.withColumn("tokens_", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0)))
    return made.withColumn("kinds_", F.expr(f"""
        filter(transform(tokens_, (t, i) -> struct(lower(t) AS value, CASE
          WHEN t IN ({_listed(STOPS)}) THEN 9
          WHEN substr(t, 1, 1) {digit} THEN 1
          WHEN t IN ({_listed(SIGNS)}) OR (substr(get(tokens_, i - 1), 1, 1) {digit} AND lower(t) IN ({_listed(UNITS)})) THEN 2
          WHEN substr(t, 1, 1) <> lower(substr(t, 1, 1)) AND t <> upper(t) AND i > 0 AND get(tokens_, i - 1) NOT IN ({_listed(STOPS)}) THEN 3
          ELSE 0 END AS kind)), k -> k.kind <> 9)""")).drop("tokens_")


#: SQL: whether word ``k`` at ``i`` is a slot, that is a value next to a plain word
SLOT = ("k.kind <> 0 AND (coalesce(get(kinds_, i - 1).kind = 0, false) OR coalesce(get(kinds_, i + 1).kind = 0, false))")


def with_hashes(rows: DataFrame) -> DataFrame:
    """``kinds_`` reduced to ``words_``: one hash per template word."""
    return rows.withColumn("words_", F.expr(
        f"transform(kinds_, (k, i) -> if({SLOT}, xxhash64('<', k.kind), xxhash64(k.value)))"))


def _windows(size: str, made: str = "struct(xxhash64(slice(words_, i + 1, {size})) AS hash, i AS at, {size} AS n)") -> str:
    return (f"transform(if(size(words_) >= {size}, sequence(0, size(words_) - {size}), array()), "
            f"i -> {made.format(size=size)})")


def _hashes(size: int) -> str:
    return _windows(str(size), "xxhash64(slice(words_, i + 1, {size}))")


def _slots(rows: DataFrame) -> DataFrame:
    """The values in a window ``w``'s slots, in order, with their kinds."""
    return rows.withColumn("slots", F.expr(
        "transform(filter(slice(marks_, w.at + 1, w.n), m -> m.slot), m -> concat(m.kind, ':', m.value))"))


def _with_marks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("marks_", F.expr(
        f"transform(kinds_, (k, i) -> struct(k.value AS value, k.kind AS kind, {SLOT} AS slot))"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """hash, n, item_id, at, slots, windows (of the item); an item shorter than
    a window is one window, an item without words none."""
    rows = _with_marks(with_hashes(with_template(benchmark.select("item_id", "text").distinct())))
    rows = rows.withColumn("n_", F.least(F.lit(window), F.size("words_"))).filter("n_ > 0")
    rows = rows.withColumn("all_", F.expr(_windows("n_"))).select(
        "item_id", "marks_", F.size("all_").alias("windows"), F.explode_outer("all_").alias("w"))
    return _slots(rows).select("w.hash", "w.n", "item_id", "w.at", "slots", "windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """Documents that hold a benchmark item, as it is or re-parameterised.

    One row per document and item: doc_id, digest (of the text), item_id,
    matched and windows (distinct windows found, and the item's), slots and
    changed_slots (values compared, and those that differ).  Null and empty
    texts match nothing; rows alike in doc_id and text are one document; an
    empty table on either side gives no rows; other columns are not read.
    """
    items = store(benchmark_windows(benchmark, window), "windows")
    keys = items.select("hash").distinct()
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())     # `window` values at most
    few = keys.count() <= BROADCAST_ROWS
    base = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    every = F.expr("concat(" + ", ".join(_windows(str(n)) for n in sizes or [window]) + ")")
    bare = F.expr("concat(" + ", ".join(_hashes(n) for n in sizes or [window]) + ")")
    seen = with_hashes(with_template(base)).select("doc_id", "digest", F.explode_outer(bare).alias("hash"))
    hit = store(seen.join(F.broadcast(keys) if few else keys, "hash", "left_semi")
                .select("doc_id", "digest").distinct(), "hit")
    some = hit.count() <= BROADCAST_ROWS
    hit = hit.select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest"))
    mine = base.join(F.broadcast(hit) if some else hit, same, "left_semi")
    mine = _with_marks(with_hashes(with_template(mine))).select("doc_id", "digest", "marks_", F.explode_outer(every).alias("w"))
    mine = _slots(mine).select("doc_id", "digest", "w.hash", "w.n", F.col("w.at").alias("place"), F.col("slots").alias("own"))
    pairs = mine.join(F.broadcast(items) if few else items, ["hash", "n"])
    # one alignment of one item: at most as many rows as the item has windows
    lined = pairs.groupBy("doc_id", "digest", "item_id", "windows", (F.col("place") - F.col("at")).alias("shift")).agg(
        F.collect_set("at").alias("ats"), F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("slots", "own")))).alias("map"))
    # a name stands for one name throughout; equal numbers are slots of their own
    fits = lined.filter("size(array_distinct(filter(map, m -> m.slots LIKE '3:%').slots)) = size(filter(map, m -> m.slots LIKE '3:%'))")
    found = fits.select("doc_id", "digest", "item_id", "windows", F.explode("ats").alias("at"),
                        F.size("map").alias("s"), F.expr("size(filter(map, m -> m.slots <> m.own))").alias("c"))
    found = found.groupBy("doc_id", "digest", "item_id", "windows").agg(
        F.countDistinct("at").alias("matched"), F.max("s").alias("slots"), F.max("c").alias("changed_slots"))
    return found.filter(F.col("matched") >= coverage * F.col("windows")).select(
        "doc_id", "digest", "item_id", "matched", F.col("windows").cast("long").alias("windows"), "slots", "changed_slots")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    bad = store(contaminated(docs, benchmark, window, coverage).select(
        F.col("doc_id").alias("bad_id"), F.col("digest").alias("bad_digest")).distinct(), "bad")
    few = bad.count() <= BROADCAST_ROWS
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & (
        F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("bad_digest"))
    return rows.join(F.broadcast(bad) if few else bad, same, "left_anti").select("row.*")


def _sql() -> str:
    quoted = lambda vs: ", ".join("chr(10)" if v == "\n" else f"'{v}'" for v in vs)
    return rf"""
WITH src AS (SELECT DISTINCT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
             UNION ALL SELECT DISTINCT 'b', item_id, coalesce(text, '') FROM benchmark),
tok AS (SELECT side, id, text, unnest(ts) AS t, generate_subscripts(ts, 1) AS i
        FROM (SELECT *, regexp_extract_all(text, '{TOKEN.replace("++", "+").replace("*+", "*").replace("'", "''")}') AS ts FROM src)),
lagged AS (SELECT *, lag(t) OVER (PARTITION BY side, id, text ORDER BY i) AS b FROM tok),
kinds AS (SELECT side, id, text, i, lower(t) AS value, CASE
    WHEN t IN ({quoted(STOPS)}) THEN 'end'
    WHEN substr(t, 1, 1) BETWEEN '0' AND '9' THEN 'num'
    WHEN t IN ({quoted(SIGNS)}) OR (lower(t) IN ({quoted(UNITS)}) AND substr(b, 1, 1) BETWEEN '0' AND '9') THEN 'unit'
    WHEN substr(t, 1, 1) <> lower(substr(t, 1, 1)) AND t <> upper(t) AND i > 1 AND b NOT IN ({quoted(STOPS)}) THEN 'name'
    ELSE 'word' END AS kind FROM lagged),
marks AS (SELECT *, kind <> 'word' AND (coalesce(lag(kind) OVER w = 'word', false) OR coalesce(lead(kind) OVER w = 'word', false)) AS slot
    FROM kinds WHERE kind <> 'end' WINDOW w AS (PARTITION BY side, id, text ORDER BY i)),
lists AS (SELECT side, id, text, list(CASE WHEN slot THEN '<' || kind || '>' ELSE value END ORDER BY i) AS ws,
    list(CASE WHEN slot THEN kind || ':' || value END ORDER BY i) AS vs FROM marks GROUP BY ALL),
sizes AS (SELECT DISTINCT least({WINDOW}, len(ws)) AS n FROM lists WHERE side = 'b'),
wins AS (SELECT side, id, text, n, unnest(range(len(ws) - n + 1)) AS pos, ws, vs, len(ws) - n + 1 AS windows
    FROM lists, sizes WHERE len(ws) >= n AND (side = 'd' OR n = least({WINDOW}, len(ws)))),
keyed AS (SELECT side, id, text, n, pos, windows, array_to_string(ws[pos + 1:pos + n], ' ') AS k,
    list_filter(vs[pos + 1:pos + n], lambda v: v IS NOT NULL) AS slots FROM wins),
pairs AS (SELECT d.id AS doc_id, d.text, b.id AS item_id, b.text AS item, b.windows, b.pos, d.pos - b.pos AS shift, b.slots, d.slots AS own
    FROM keyed d JOIN keyed b ON d.side = 'd' AND b.side = 'b' AND d.k = b.k AND d.n = b.n),
maps AS (SELECT DISTINCT doc_id, text, item_id, shift, unnest(slots) AS s, unnest(own) AS o FROM pairs),
fits AS (SELECT doc_id, text, item_id, shift, count(DISTINCT s) FILTER (s LIKE 'name:%') AS vals, count(*) FILTER (s LIKE 'name:%') AS names,
    count(*) AS slots, count(*) FILTER (s <> o) AS changed FROM maps GROUP BY ALL),
good AS (SELECT p.doc_id, p.text, p.item_id, p.windows, p.pos, coalesce(f.slots, 0) AS slots, coalesce(f.changed, 0) AS changed
    FROM pairs p LEFT JOIN fits f USING (doc_id, text, item_id, shift) WHERE f.vals IS NULL OR f.vals = f.names)
SELECT doc_id, item_id, count(DISTINCT pos) AS matched, CAST(windows AS BIGINT) AS windows,
  CAST(max(slots) AS INTEGER) AS slots, CAST(max(changed) AS INTEGER) AS changed_slots
FROM good GROUP BY doc_id, text, item_id, windows HAVING count(DISTINCT pos) >= {COVERAGE} * windows
"""


DECONTAM_SQL = _sql()
