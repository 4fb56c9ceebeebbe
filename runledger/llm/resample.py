"""Target-distribution importance resampling over hashed word n-grams.

Each document is scanned once: its words, lower-cased and joined by one space,
go through one running CRC-32 whose value after every word is stored.  The CRC
of any n-gram follows from two of these prefixes: the CRC of the text before
it, shifted over the n-gram's length by GF(2) operators (one per power of
two), cancels out of the CRC at its end.  Counts of the hashed features over
all documents and over the target give each bucket a gain; a document's weight
is the mean gain of its features, and a seeded Gumbel noise on top makes the
highest scores a sample without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .ranks import ranked

LONGEST = 1                # words of the longest feature
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
BLOCK = 1 << 19            # words whose features are derived at once
POLYNOMIAL = 0xEDB88320    # CRC-32, bits reversed

#: ASCII bytes that are no letter or digit become spaces, capitals small; other bytes stay
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _operators() -> np.ndarray:
    """[k, j, b]: what 2**k zero bytes make of a CRC register that holds byte
    ``b`` at place ``j`` and zeros else."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> 1) ^ (POLYNOMIAL * (step & 1)).astype(np.uint32)
    b = np.arange(256, dtype=np.uint32)
    one = np.stack([step, b, b << 8, b << 16])      # one zero byte: the low byte goes through the table
    out = [one]
    for _ in range(31):
        out.append(_apply(out[-1], out[-1]))
    return np.stack(out)


def _apply(op: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return op[0][crc & 255] ^ op[1][(crc >> 8) & 255] ^ op[2][(crc >> 16) & 255] ^ op[3][crc >> 24]


OPERATORS = _operators()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC register after as many zero bytes."""
    out = crc.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        on = ((lengths >> k) & 1).astype(bool)
        out[on] = _apply(OPERATORS[k], out[on])
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running CRC after every word, and the words' lengths in bytes."""
    for batch in batches:
        crcs, lengths = [], []
        for text in batch.column("text"):
            found = (text.as_py() or b"").translate(_FOLD).split()
            # each step takes a word and the space before it
            crcs.append(np.fromiter(accumulate(found[1:], lambda c, w: crc32(b" " + w, c), initial=crc32(found[0])), "<u4", len(found)).tobytes()
                        if found else b"")
            lengths.append(np.fromiter(map(len, found), "<u4", len(found)).tobytes())
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(crcs, pa.binary()), pa.array(lengths, pa.binary())],
            [*batch.schema.names[:-1], "crcs", "lengths"])


def prefixes(docs: DataFrame, ids: list[str]) -> DataFrame:
    """``ids`` of each row, with ``crcs`` and ``lengths``: 32 bits per word."""
    head = docs.select(*ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema)
    return docs.select(*ids, F.col("text").cast("binary").alias("text")).mapInArrow(
        _scan, f"{schema}{', ' if ids else ''}crcs binary, lengths binary")


def features(crcs: np.ndarray, lengths: np.ndarray, doc: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, CRC) of every run of 1 to ``longest`` words; ``doc`` numbers
    the words' documents, in order."""
    first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    before = np.zeros_like(crcs)                    # CRC of what stands before each word, its space included
    if len(crcs):
        inv = np.uint32(0xFFFFFFFF)
        c = crcs[:-1] ^ inv
        before[1:] = OPERATORS[0][0][(c ^ 32) & 255] ^ (c >> 8) ^ inv
        before[first] = 0
    ends = np.cumsum(lengths.astype(np.int64) + 1)
    for n in range(1, longest + 1):
        a = np.arange(len(doc) - n + 1) if len(doc) >= n else np.zeros(0, int)
        a = a[doc[a] == doc[a + n - 1]] if n > 1 else a
        z = a + n - 1
        size = ends[z] - ends[a] + lengths[a]
        yield doc[a], crcs[z] ^ shifted(before[a], size)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents [i, j) with their words' running CRCs, lengths and document
    numbers (from 0); documents are kept whole."""
    crcs, lengths = batch.column("crcs").to_pylist(), batch.column("lengths").to_pylist()
    i, n = 0, 0
    for j, c in enumerate(crcs, 1):
        n += len(c) // 4
        if n >= BLOCK or j == len(crcs):
            sizes = [len(c) // 4 for c in crcs[i:j]]
            yield (i, j, np.frombuffer(b"".join(crcs[i:j]), "<u4"), np.frombuffer(b"".join(lengths[i:j]), "<u4"),
                   np.repeat(np.arange(j - i), sizes))
            i, n = j, 0


def _counts(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, crcs, lengths, doc in _blocks(batch):
                for _, crc in features(crcs, lengths, doc, longest):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])
    return run


def bucket_counts(marks: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of ``prefixes``: each task sums its
    own, and ``buckets`` numbers reach the driver."""
    rows = marks.select("crcs", "lengths").mapInArrow(_counts(longest, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():       # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(seen: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Thousand times the log ratio of a bucket's smoothed shares, floored."""
    s, t = seen.astype(float), wanted.astype(float)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weights(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, many, total = (np.zeros(n, np.int64) for _ in range(3))
            for i, j, crcs, lengths, doc in _blocks(batch):
                words[i:j] = np.bincount(doc, minlength=j - i)
                for of, crc in features(crcs, lengths, doc, longest):
                    many[i:j] += np.bincount(of, minlength=j - i)
                    # exact: the running sums are whole numbers
                    run_sum = np.r_[0, np.cumsum(gain[crc % np.uint32(len(gain))])]
                    stop = np.cumsum(np.bincount(of, minlength=j - i))
                    total[i:j] += run_sum[stop] - run_sum[np.r_[0, stop[:-1]]]
            weight = np.where(many > 0, total // np.maximum(many, 1), 0)
            columns = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (words, many, weight))],
                                             [*batch.schema.names[:-2], "n_words", "n_features", "weight"])
    return run


def draw(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS,
         least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Draw ``percent`` of the ``docs`` (doc_id, text) of at least
    ``least_words`` words, so that their features are spread like those of
    ``target`` (text).

    One row per row of ``docs``: doc_id, digest (of the text), n_words,
    n_features, weight, score, rank (from 1 over the rows drawn, null for
    others).  Null and empty texts have no features and weight 0, as texts
    without any word character.  Equal scores go by the smaller id, a null id
    last; rows equal in id and text score alike and are told apart by their
    place in the scan.  Empty ``docs`` give no rows; with an empty target all
    gains stand against a flat one.  Other columns are not read."""
    marks = store(prefixes(docs.withColumn("digest", F.xxhash64("text")), ["doc_id", "digest"]), "prefixes")
    gain = gains(bucket_counts(marks, longest, buckets), bucket_counts(prefixes(target, []), longest, buckets))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    weighed = marks.mapInArrow(_weights(gain, longest), f"doc_id {id_type}, digest long, n_words long, n_features long, weight long")
    lot = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((lot.cast("double") + 0.5) / 4294967296.0)))
    scored = store(weighed.withColumn("score", F.col("weight") + noise), "scores")
    can = F.col("n_words") >= least_words
    many = percent * scored.filter(can).count() // 100
    placed = ranked(scored.filter(can), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("digest")])
    placed = placed.withColumn("rank", F.when(F.col("rank") <= many, F.col("rank")))
    return placed.unionByName(scored.filter(~can).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that ``draw`` picks, with all their columns as they
    are.  Rows alike in id and text are picked together, so the cut can pass
    the share by the copies of its last row."""
    drawn = draw(docs, target, **how).filter("rank IS NOT NULL").select(
        F.col("doc_id").alias("drawn_id"), F.col("digest").alias("drawn_digest")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("digest"))
    return rows.join(drawn, F.col("row.doc_id").eqNullSafe(F.col("drawn_id")) & (F.col("digest") == F.col("drawn_digest")),
                     "left_semi").select("row.*")


RESAMPLE_SQL = r"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY b) AS of FROM bits WHERE k = 8),
texts AS (
  SELECT doc_id, coalesce(text, '') AS text, true AS is_doc FROM documents
  UNION ALL SELECT item_id, coalesce(text, ''), false FROM benchmark),
split AS (
  SELECT doc_id, is_doc, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
per AS (SELECT doc_id, is_doc, w, count(*) AS n FROM (SELECT doc_id, is_doc, unnest(words) AS w FROM split) GROUP BY ALL),
named AS (
  SELECT w, xor(list_reduce([CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT) FOR i IN range(len(hex(w)) // 2)],
    lambda c, b: xor(c >> 8, of[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM per), steps),
hits AS (SELECT doc_id, is_doc, bucket, sum(n) AS n FROM per JOIN named USING (w) GROUP BY ALL),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (is_doc), 0) AS s, coalesce(sum(n) FILTER (NOT is_doc), 0) AS t FROM hits GROUP BY bucket),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(c.t + 1 AS DOUBLE) * CAST(z.s + 10000 AS DOUBLE)
    / (CAST(c.s + 1 AS DOUBLE) * CAST(z.t + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM counts c, totals z),
weights AS (SELECT doc_id, sum(n * g) AS total, sum(n) AS many FROM hits JOIN gain USING (bucket) WHERE is_doc GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(d.words) AS n_features, coalesce(CAST(floor(total / many) AS BIGINT), 0) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM split d LEFT JOIN weights USING (doc_id) WHERE d.is_doc),
placed AS (
  SELECT doc_id, n_features, weight, weight + noise AS score,
    row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place,
    (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 AS many
  FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, CAST(score AS BIGINT) AS score,
  CASE WHEN n_features >= 20 AND place <= many THEN CAST(place AS BIGINT) END AS rank
FROM placed
"""
