"""Line dedup over content-defined chunks, with DataFrame functions only.

Lines are cut further at the ends of clauses, so that a passage of some fifty
words holds several units whatever its line breaks.  A rolling hash covers each
unit and the one before it; a chunk ends where that hash is a local minimum, so
the same passage is cut at the same places whatever stands before it.  Minima
are never neighbours, so all chunks but a text's last have two units or more.

Chunks whose last two units are equal meet by the hash of these; each is compared
byte by byte with the first such chunk by (doc_id, text digest, place), to the
left through the chunk and to the right through the next one as far as the units
are equal, which finds a passage's margins, where a chunk mixes with the text's
own units.  A whole chunk that stands earlier goes also where the first chunk of
its last two units is another.  Every match points to an earlier place, so one copy of
all that is removed stays.  Adjoining matches are one run; runs of fewer than
``LEAST_WORDS`` words stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, store

LEAST_WORDS = 25
BROADCAST_HASHES = 1_000_000      # 8 bytes each; beyond it the join shuffles
CUT = r"(?<=[.,;:!?] )|(?<=[\n。，；！？])"
ENDS = [". ", ", ", "; ", ": ", "! ", "? ", "\n", "。", "，", "；", "！", "？"]      # the same places
MARK = "\u0001"
AT = ["doc_id", "digest", "pos"]


def _with_units(docs: DataFrame, wanted: Column | None = None) -> DataFrame:
    """``docs`` with a column ``units_``: strings whose concatenation is the text
    (null in rows that are not ``wanted``)."""
    text = F.coalesce("text", F.lit(""))
    marked = text
    for end in ENDS:
        # a search costs a fifth of a replacement; nothing is replaced where the searched text is empty
        marked = F.replace(marked, F.when(F.contains(text, F.lit(end)), F.lit(end)).otherwise(F.lit("")), F.lit(end + MARK))
    # plain replacements cost a tenth of the pattern, which serves texts that hold the mark
    units = F.when(F.contains(text, F.lit(MARK)), F.split(text, CUT, -1)).otherwise(F.split(marked, MARK, -1))
    units = F.array_remove(units, "")
    return docs.withColumn("units_", units if wanted is None else F.when(wanted, units))


def _between(units: str, first: str, last: str) -> str:
    """SQL: the units from place ``first`` to ``last``; a ``slice`` would copy the whole array for each chunk."""
    return f"if({last} < {first}, cast(array() AS array<string>), transform(sequence({first}, {last}), x -> get({units}, x)))"


START = "if(k = 0, 0, get(ends_, k - 1) + 1)"
# trimming blanks alone is cheap and all that most units need
PLAIN = r"""transform(transform(units_, u -> rtrim(u)), u -> if(endswith(u, '\n') OR endswith(u, '\r') OR endswith(u, '\t'),
  trim(TRAILING ' \t\r\n' FROM u), u))"""
TAIL = "concat(get(plain_, e - 1), '\n', get(plain_, e))"       # null in a text's first unit


def with_ends(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``plain_`` (the units without the white space at
    their ends) and ``ends_`` (the places of the chunks' last units)."""
    made = _with_units(docs).withColumn("plain_", F.expr(PLAIN))
    made = made.withColumn("hashes_", F.expr("transform(plain_, s -> md5(s))"))
    made = made.withColumn("rolled_", F.expr(
        "transform(hashes_, (h, i) -> md5(concat(if(i = 0, '', left(get(hashes_, i - 1), 8)), h)))"))
    return made.withColumn("ends_", F.expr("""
        if(size(plain_) = 0, cast(array() AS array<int>),
          filter(sequence(0, size(plain_) - 1), i -> i = size(plain_) - 1 OR (i > 0
            AND get(rolled_, i) < get(rolled_, i - 1) AND get(rolled_, i) <= get(rolled_, i + 1))))
        """)).drop("units_", "hashes_", "rolled_")


def _alike(a: str, b: str, back: bool) -> str:
    """SQL: how many units ``a`` and ``b`` share from their start, or from their end."""
    one, two = (f"get({x}, {f'size({x}) - 1 - i' if back else 'i'})" for x in (a, b))
    return f"aggregate(sequence(0, least(size({a}), size({b}))), 0, (n, i) -> if(n = i AND {one} = {two}, n + 1, n))"


def repeated_units(docs: DataFrame) -> DataFrame:
    """Runs to remove from ``docs`` (doc_id, text): doc_id, digest (of the whole
    text), from and to (places of units, from 0), none overlapping or adjoining."""
    # read twice, and dropped once the candidates stand
    cut = store(with_ends(docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))).drop("text"), "units")
    # the outer form only keeps Spark from deriving a filter that repeats the whole expression
    hashes = cut.select(F.explode_outer(F.expr(f"transform(ends_, (e, k) -> xxhash64({TAIL}))")).alias("hash"))
    often = store(hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1 AND hash IS NOT NULL").select("hash"), "hashes")
    found = cut.select("doc_id", "digest", F.posexplode_outer(F.expr(f"""
        transform(ends_, (e, k) -> struct(
          {START} AS start, e AS end, {TAIL} AS tail, {_between("plain_", START, "e - 2")} AS head,
          {_between("plain_", "e + 1", "coalesce(get(ends_, k + 1), e)")} AS next))""")).alias("pos", "c"))
    found = found.filter((F.col("c.end") > F.col("c.start")) & F.col("c.tail").rlike(r"\S")).select(
        *AT, "c.*", F.xxhash64("c.tail").alias("hash"))
    few = often.count() <= BROADCAST_HASHES
    # the rows that share a hash, with their bytes; a hot hash's rows are split by the skew join
    same = store(found.join(F.broadcast(often) if few else often, "hash", "left_semi").drop("hash"), "candidates")
    drop_stored(cut)
    # stored, so that the join deals both sides anew and can split a hot passage
    first = store(same.groupBy("tail").agg(
        F.min(F.struct(*AT, "head", "next")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    later = ~F.struct(*AT).eqNullSafe(F.struct(*[F.col("first")[c].alias(c) for c in AT]))
    back = F.expr(_alike("head", "first.head", True))
    matched = store(same.join(first, "tail").filter(later).select(
        *AT, "start", "end", back.alias("back"), F.expr(_alike("next", "first.next", False)).alias("on"),
        # chunks unlike the first one of their tail may be alike among themselves
        F.when((back < F.size("head")) | (F.size("head") != F.size("first.head")),
               F.concat(F.array_join("head", "\n"), F.lit("\n"), F.col("tail"))).alias("whole")), "matched")
    chunks = matched.filter("whole IS NOT NULL").select(*AT, "start", "end", "whole")
    whole = store(chunks.groupBy("whole").agg(
        F.min(F.struct(*AT)).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "whole")
    ranges = matched.select("doc_id", "digest", F.expr("end - 1 - back").alias("from"), F.expr("end + on").alias("to")).union(
        chunks.join(whole, "whole").filter(later).select("doc_id", "digest", "start", "end")).distinct()
    # a window over one document's own matches
    w = Window.partitionBy("doc_id", "digest").orderBy("from", "to")
    before = F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = ranges.withColumn("new", F.when(before.isNull() | (F.col("from") > before + 1), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "digest", "run").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("run")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the passages taken out of ``text`` that occur earlier.

    Every row stays, with all its columns (inside ``row``), plus ``text`` (the
    new one), ``removed_passages`` and ``removed_words``.  A null text stays
    null and an empty one empty; blank chunks match nothing; rows alike in doc_id
    and text are one document and keep the same passages; null ids come first;
    an empty table gives no rows.
    """
    gone = repeated_units(docs).groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("gone"))
    gone = store(gone, "removed").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    # the same join at every size: a broadcast of what is small today would hide its cost
    rows = rows.join(gone.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("gone_id"))
                     & (F.col("digest") == F.col("gone_digest")), "left")
    rows = _with_units(rows.select("row", F.col("row.text").alias("text"), F.coalesce(
        "gone", F.array().cast("array<struct<`from`:int,`to`:int>>")).alias("gone")), F.size("gone") > 0)
    rows = rows.withColumn("cut_", F.expr(rf"""
        filter(transform(gone, r -> struct(r.`from`, r.`to`, regexp_count(
          array_join({_between("units_", "r.`from`", "r.`to`")}, ''), '\\S+') AS words)), r -> r.words >= {LEAST_WORDS})"""))
    kept = F.expr(f"""
        concat(array_join(transform(cut_, (r, j) -> array_join(
          {_between("units_", "if(j = 0, 0, get(cut_, j - 1).`to` + 1)", "r.`from` - 1")}, '')), ''),
          array_join({_between("units_", "element_at(cut_, -1).`to` + 1", "size(units_) - 1")}, ''))""")
    return rows.select(
        "row", F.when(F.size("cut_") == 0, F.col("text")).otherwise(kept).alias("text"),
        F.size("cut_").alias("removed_passages"),
        F.expr("aggregate(cut_, 0L, (a, r) -> a + r.words)").alias("removed_words"))


LINES_SQL = r"""
WITH d AS (SELECT doc_id, text, md5(coalesce(text, '')) AS digest,
        list_filter(string_split(regexp_replace(coalesce(text, ''), '([.,;:!?] |[\n。，；！？])', '\1' || chr(1), 'g'), chr(1)),
                    lambda u: u <> '') AS us FROM documents),
l AS (SELECT doc_id, digest, i, n, raw, u, md5(CASE WHEN i = 0 THEN '' ELSE left(md5(p), 8) END || md5(u)) AS r
      FROM (SELECT *, rtrim(us[i + 1], chr(32) || chr(9) || chr(10) || chr(13)) AS u,
                   rtrim(us[i], chr(32) || chr(9) || chr(10) || chr(13)) AS p, us[i + 1] AS raw
            FROM (SELECT DISTINCT doc_id, digest, us, len(us) AS n, unnest(range(len(us))) AS i FROM d))),
e AS (SELECT *, lag(r) OVER w AS p, lead(r) OVER w AS q FROM l WINDOW w AS (PARTITION BY doc_id, digest ORDER BY i)),
g AS (SELECT *, coalesce(sum(CASE WHEN i > 0 AND i < n - 1 AND r < p AND r <= q THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id, digest ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e),
c AS (SELECT doc_id, digest, pos, min(i) AS s, max(i) AS e, list(u ORDER BY i) AS own FROM g GROUP BY ALL),
c2 AS (SELECT *, coalesce(lead(own) OVER (PARTITION BY doc_id, digest ORDER BY pos), []) AS nxt FROM c),
m AS (SELECT *, 0 AS kind, array_to_string(own, chr(10)) AS k FROM c2 WHERE len(own) >= 2
      UNION ALL SELECT *, 1, array_to_string(own[-2:], chr(10)) FROM c2 WHERE len(own) >= 2),
f AS (SELECT *, row_number() OVER w AS place, first_value(own) OVER w AS fo, first_value(nxt) OVER w AS fn
      FROM m WHERE regexp_matches(array_to_string(own[-2:], chr(10)), '[^\t\n\x0B\f\r ]')
      WINDOW w AS (PARTITION BY kind, k ORDER BY doc_id, digest, pos)),
x AS (SELECT DISTINCT doc_id, digest,
        CASE WHEN kind = 0 THEN s ELSE e + 1 - (list_position(list_append(
          [own[-j] = fo[-j] for j in range(1, least(len(own), len(fo)) + 1)], false), false) - 1) END AS a,
        CASE WHEN kind = 0 THEN e ELSE e + (list_position(list_append(
          [nxt[j] = fn[j] for j in range(1, least(len(nxt), len(fn)) + 1)], false), false) - 1) END AS b
      FROM f WHERE place > 1),
y AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id, digest ORDER BY a, b
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM x),
z AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, digest ORDER BY a, b) AS run FROM y),
runs AS (SELECT doc_id, digest, run, min(a) AS a, max(b) AS b FROM z GROUP BY ALL),
words AS (SELECT r.*, len(regexp_extract_all(string_agg(raw, '' ORDER BY i), '[^\t\n\x0B\f\r ]+')) AS words
          FROM runs r JOIN l ON l.doc_id = r.doc_id AND l.digest = r.digest AND l.i BETWEEN r.a AND r.b GROUP BY ALL),
cut AS (SELECT * FROM words WHERE words >= 25),
left_ AS (SELECT l.doc_id, l.digest, string_agg(raw, '' ORDER BY i) AS text FROM l
          WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.doc_id = l.doc_id AND cut.digest = l.digest AND l.i BETWEEN cut.a AND cut.b)
          GROUP BY ALL),
sums AS (SELECT doc_id, digest, count(*) AS passages, sum(words) AS words FROM cut GROUP BY ALL)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_.text, '') END AS text,
  CAST(coalesce(passages, 0) AS INTEGER) AS removed_passages, CAST(coalesce(sums.words, 0) AS BIGINT) AS removed_words
FROM d LEFT JOIN left_ USING (doc_id, digest) LEFT JOIN sums USING (doc_id, digest)
"""
