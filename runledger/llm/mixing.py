"""Language-model scores by online logistic context mixing.

A token (a word, or the end of the text) has an eight-bit code, a hash of the
word.  Its bits are predicted one after the other in three contexts: none, the
word before, the two words before.  The last two are hashed, and how often each
code followed each of them is counted over the corpus.  The predictions, as
logits, are combined by weights chosen by how often the two hashed contexts were
seen (the gate); after every block of tokens the weights move along the coding
error, and a table of probabilities by predicted probability refines the result
in the same way.  Both start anew in each text; blocks are short at its start.
The word itself, given its code, is coded by its share of the code's corpus
count, with one share for all unknown words.

Texts are dealt in slices.  A slice sends its distinct cells (context and code)
and words, each with its count in the texts learnt from, as sorted, delta-coded
blocks to the ranges of the hash space.  A range adds the blocks up and answers
each with the state of every cell (the logits along the code's path and how
often its nodes were seen) and the count of every word, in the block's order.
The answers meet their slice again, which codes its texts.  All of it grows with
the corpus: the contexts' hash is longer the longer the corpus is, and no count
is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, free_shuffles, id_crc, shuffle_width, store, text_of, worker_state

SPARE_BITS = 8            # of a context's hash beyond the bits of the corpus' length
BLOCK = 64                 # tokens between two updates of the weights; fewer at a text's start
RATE = 0.6
REFINE_RATE = 0.5
WORDS_KEPT = 250_000       # of a worker's table of word hashes
CODED = 300_000            # tokens or cells worked on at a time; a longer text, or a context, alone
SLICE_CHARS = 8_000_000    # a longer text is a slice of its own
RANGE_CHARS = 12_000_000   # characters of the corpus for each range of the hash space
MOST_TASKS = 20_000

CODES = np.arange(256)
NODES = np.stack([(CODES | 256) >> (8 - b) for b in range(8)], axis=1)
BITS = np.stack([(CODES >> (7 - b)) & 1 for b in range(8)], axis=1)
MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
GATES, LEVELS = 16, 25

SEEN = np.array([1, 4, 20])             # counts from which a node is in the next confidence class
# a node's state: its confidence class and, in steps of STEP around the class's middle, its logit
HALF, STEP = np.array([0, 9, 16, 101]), np.array([1, 0.25, 0.25, 0.125])
MIDDLE = np.cumsum(2 * HALF + 1) - HALF - 1
CLASS = np.repeat(np.arange(4), 2 * HALF + 1)
OTHER = (2 * MIDDLE[CLASS] - np.arange(256)).astype(np.uint8)     # the state as the other bit sees it
LOGIT = ((np.arange(256) - MIDDLE[CLASS]) * STEP[CLASS]).astype(np.float32)


def start_weights() -> np.ndarray:
    """Weights (gate, context) that a text starts with: the longer context
    takes over as it was seen more often."""
    w = np.zeros((4, 4, 3), np.float32)
    for one in range(4):
        for two in range(4):
            long, short = (0, 0.35, 0.5, 0.7)[two], (0, 0.2, 0.4, 0.6)[one]
            short *= 1 - long
            w[one, two] = (max(0.1, 1 - long - short), short, long)
    return w.reshape(GATES, 3)


class Words(dict):
    """word -> its number here; ``hashes`` and ``sizes`` (bytes) are by that number."""

    def __init__(self):
        super().__init__()
        self.hashes, self.sizes = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)

    def __missing__(self, word: bytes) -> int:
        import xxhash
        k = self[word] = len(self)
        if k == len(self.hashes):
            self.hashes, self.sizes = np.concatenate([self.hashes] * 2), np.concatenate([self.sizes] * 2)
        self.hashes[k], self.sizes[k] = xxhash.xxh64_intdigest(word, 42), len(word)
        return k


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words (ASCII rules) and the end, an empty word."""
    out = text.lower().split()
    out.append(b"")
    return out


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers by planes of their bytes, compressed."""
    n = len(numbers)
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(n, 8)[:, :width].T
    return bytes([width]) + n.to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if n else b"")


def unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = pa.decompress(data[9:], decompressed_size=width * n, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _firsts(cells: np.ndarray, d: int) -> np.ndarray:
    """Whether a cell is the first of those that share its node at depth ``d``."""
    node = cells >> np.uint64(8 - d)
    return np.append(True, node[1:] != node[:-1])


def pack_states(found: np.ndarray, cells: np.ndarray) -> bytes:
    """The states (cell, bit) of sorted cells, compressed.  Cells that share a
    node differ in its state by their own bit alone, so a node's state is written
    once, for its first cell; a cell whose states are all alike has but one."""
    if not len(cells):
        return b""
    same = (found == found[:, :1]).all(axis=1)
    out = [pack_bytes(np.packbits(same))]
    for d in range(8):
        out.append(pack_bytes(found[_firsts(cells, d) & ~same if d else _firsts(cells, d), d]))
    return b"".join(out)


def unpack_states(data: bytes, cells: np.ndarray) -> np.ndarray:
    out = np.empty((8, len(cells)), np.uint8)
    if not len(cells):
        return out.T
    flags, at = unpack_bytes(data, 0)
    same, code = np.unpackbits(flags, count=len(cells)).astype(bool), (cells & np.uint64(255)).astype(np.uint8)
    for d in range(8):
        given, at = unpack_bytes(data, at)
        first = _firsts(cells, d)
        there, run = np.flatnonzero(first), np.cumsum(first, dtype=np.int32) - 1
        own = given
        if d:
            own = out[0, there]
            own[~same[there]] = given
        bit = code >> np.uint8(7 - d) & np.uint8(1)
        out[d] = np.where(bit == bit[there][run], own[run], OTHER[own][run])
    return np.ascontiguousarray(out.T)


def pack_bytes(values: np.ndarray) -> bytes:
    body = pa.compress(values.tobytes(), codec="zstd", asbytes=True) if len(values) else b""
    return len(values).to_bytes(6, "little") + len(body).to_bytes(6, "little") + body


def unpack_bytes(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The values written at ``at``, and where the next ones stand."""
    n, size = int.from_bytes(data[at:at + 6], "little"), int.from_bytes(data[at + 6:at + 12], "little")
    at += 12
    body = pa.decompress(data[at:at + size], decompressed_size=n, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(body, np.uint8), at + size


def _gaps(numbers: np.ndarray) -> np.ndarray:
    return np.diff(numbers, prepend=np.uint64(0))


def _contexts(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A mixed hash of the word before and of the two words before; zeros stand before a text."""
    one = np.zeros_like(h)
    one[1:] = h[:-1]
    one[starts] = 0
    two = np.zeros_like(h)
    two[1:] = one[:-1]
    two[starts] = 0
    return one * MIX[0] + MIX[3], one * MIX[1] + (two ^ (two >> np.uint64(29))) * MIX[2]


def _cells(h: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """Each token's cell in the first context, then each one's in the second:
    ``bits`` bits of the context's hash, then the code."""
    mixed = np.concatenate(_contexts(h, starts))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX[0]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX[1]
    return (mixed >> np.uint64(64 - bits)) << np.uint64(8) | np.tile(h & np.uint64(255), 2)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slice of texts."""
    slice_, rows, chars, schema = TaskContext.get().partitionId() << 32, [], 0, None

    def made() -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        texts = t["text"].to_pylist()
        parts = [pa.array([slice_]), t["doc_id"].combine_chunks(), pa.array(list(map(len, texts)), pa.int64()), t["learns"].combine_chunks()]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), p) for p in parts[1:]]
        packed = pa.Codec("zstd", 3).compress(b"".join(texts), asbytes=True) if any(texts) else b""
        return pa.RecordBatch.from_arrays([parts[0], *lists, pa.array([packed], pa.binary())],
                                          ["slice", "doc_id", "sizes", "learns", "texts"])

    for batch in batches:
        at, sizes = 0, batch["text"].cast(pa.binary()).to_pylist()
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(sizes, pa.binary()))
        for k, t in enumerate(sizes):
            chars += len(t)
            if chars >= SLICE_CHARS:
                rows.append(batch.slice(at, k + 1 - at))
                yield made()
                slice_, rows, chars, at = slice_ + 1, [], 0, k + 1
        if at < len(sizes):
            rows.append(batch.slice(at))
    if rows:
        yield made()


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' sizes in bytes and hashes, and each text's start and length in
    tokens.  The words themselves are only held for one text at a time."""
    words = worker_state("mixing_words", Words)
    if len(words) >= WORDS_KEPT:
        words.clear()
    ends = np.cumsum(row["sizes"])
    whole = pa.decompress(row["texts"], decompressed_size=int(ends[-1]), codec="zstd", asbytes=True) if ends[-1] else b""
    docs = []
    for e, size in zip(ends.tolist(), row["sizes"], strict=True):
        own = words_of(whole[e - size:e])
        docs.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
    n, numbers = np.array([len(d) for d in docs]), np.concatenate(docs)
    return words.sizes[numbers], words.hashes[numbers], np.cumsum(n) - n, n


def _places(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, sorted, and where each of ``numbers`` stands among
    them; in half the memory of numpy's ``unique``, whose places are long."""
    order = np.argsort(numbers)
    numbers = numbers[order]
    new = np.append(True, numbers[1:] != numbers[:-1])[:len(numbers)]
    at = np.empty(len(numbers), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return numbers[new], at


def _edges(ranges: int, bits: int) -> np.ndarray:
    return np.array([(r << bits) // ranges for r in range(1, ranges)], np.uint64)


def _blocks(bits: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each slice's distinct cells and words with their counts, by range."""
        for batch in batches:
            for (row,) in (batch.slice(k, 1).to_pylist() for k in range(batch.num_rows)):
                _, h, starts, n = _tokens(row)
                learnt = np.repeat(np.array(row["learns"], np.uint8), n)
                found = []
                for numbers, weight, edges in ((_cells(h, starts, bits), np.tile(learnt, 2), _edges(ranges, bits) << np.uint64(8)),
                                               (h, learnt, _edges(ranges, 64))):
                    own, at = _places(numbers)
                    count = np.bincount(at, weight, len(own)).astype(np.uint64)
                    cuts = np.searchsorted(own, edges)
                    found.append(list(zip(np.split(own, cuts), np.split(count, cuts), strict=True)))
                out = [(r, pack(_gaps(c)), pack(m), pack(_gaps(w)), pack(k))
                       for r, ((c, m), (w, k)) in enumerate(zip(*found, strict=True)) if len(c) or len(w)]
                for s in range(0, len(out), 1000):
                    part = out[s:s + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r for r, *_ in part], pa.int64()), pa.array([row["slice"]] * len(part), pa.int64()),
                         *(pa.array([p[k] for p in part], pa.binary()) for k in range(1, 5))],
                        ["range", "slice", "cells", "cell_n", "words", "word_n"])
    return run


def states(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The states (cell, bit) along each cell's code: how sure the counts of its
    context are of the code's own bit, after the bits before it.  ``cells`` are
    distinct and sorted, and hold all of a context's codes that were counted."""
    # whole contexts, some at a time
    new = np.flatnonzero(_firsts(cells, 0)) if len(cells) else np.zeros(0, np.int64)
    cuts = np.append(new[np.unique(new // CODED, return_index=True)[1]], len(cells)).tolist()
    return np.concatenate([_states(cells[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                          or [np.empty((0, 8), np.uint8)])


def _states(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out, above = np.empty((len(cells), 8), np.uint8), None
    for d in range(9):
        prefix = cells >> np.uint64(8 - d)
        at = np.cumsum(np.append(False, prefix[1:] != prefix[:-1]))
        own = np.bincount(at, counts)[at]
        if d:
            sure = np.searchsorted(SEEN, above, "right")
            logit = np.log((own + 0.4) / (above - own + 0.4)) / STEP[sure]
            out[:, d - 1] = MIDDLE[sure] + np.clip(np.rint(logit), -HALF[sure], HALF[sure])
        above = own
    return out


def _added(blocks: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All distinct numbers of a range, their counts, and the places of each block's own."""
    own = [np.cumsum(unpack(b)) for b in blocks[f"{name}s"].to_pylist()]
    cuts, own = np.cumsum([len(o) for o in own])[:-1], np.concatenate(own)
    numbers, at = _places(own)
    del own
    count = np.concatenate([unpack(b) for b in blocks[f"{name}_n"].to_pylist()])
    return numbers, np.bincount(at, count, len(numbers)), np.split(at, cuts)


ANSWER = "slice long, range long, states binary, counts binary, sizes array<long>"


def _answer(blocks: pa.Table) -> pa.Table:
    """One row per block of a range, and one without a slice: the words' counts
    by code (256 numbers) and how many distinct words there are (256 more)."""
    cells, counts, at = _added(blocks, "cell")
    found = states(cells, counts)
    given = [pack_states(found[a], cells[a]) for a in at]
    words, counts, at = _added(blocks, "word")
    code = (words & np.uint64(255)).astype(np.int64)
    sizes = np.concatenate([np.bincount(code, counts, 256), np.bincount(code, counts > 0, 256)]).astype(np.int64)
    counts, range_ = counts.astype(np.uint64), blocks["range"][0].as_py()
    return pa.table({
        "slice": pa.array(blocks["slice"].to_pylist() + [None], pa.int64()),
        "range": pa.array([range_] * (len(at) + 1), pa.int64()),
        "states": pa.array(given + [None], pa.binary()),
        "counts": pa.array([pack(counts[a]) for a in at] + [None], pa.binary()),
        "sizes": pa.array([None] * len(at) + [sizes.tolist()], pa.list_(pa.int64()))})


def order_nothing(counts: np.ndarray) -> np.ndarray:
    """The logit of a one at each node of the code tree, from the codes' counts."""
    tree = np.zeros(512)
    tree[256:] = counts
    for k in range(255, 0, -1):
        tree[k] = tree[2 * k] + tree[2 * k + 1]
    return np.log((tree[1::2] + 0.4) / (tree[0::2] + 0.4)).astype(np.float32)


def code_texts(code: np.ndarray, starts: np.ndarray, lengths: np.ndarray, none: np.ndarray,
               one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """log10 probability of each text's codes.  ``none``: the order-nothing
    logits; ``one`` and ``two``: each token's states in the two contexts."""
    n = len(starts)
    # longest texts first, so that those still running are always the first ones
    longest = np.argsort(-lengths, kind="stable")
    rank = np.empty(n, np.int64)
    rank[longest] = np.arange(n)
    doc = np.repeat(rank, lengths)
    place = np.arange(len(code)) - np.repeat(starts, lengths)
    # blocks of 1, 1, 2, 4, ... tokens up to BLOCK, then of BLOCK
    first = int(BLOCK).bit_length() - 1
    block = np.where(place < BLOCK, np.ceil(np.log2(np.minimum(place, BLOCK) + 1)).astype(np.int64), first + place // BLOCK)
    order = np.argsort(block * n + doc, kind="stable")
    code, doc, block = code[order], doc[order], block[order]
    cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-2))
    weights = [np.tile(w, n) for w in start_weights().T]
    level = np.tile(1 / (1 + np.exp(-(np.arange(LEVELS) - LEVELS // 2) / 2.0)), n).astype(np.float32)
    seen = np.zeros(n)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        live = int(doc[b - 1]) + 1
        bit = BITS[code[a:b]].ravel()
        sign = (2 * bit - 1).astype(np.float32)
        s1, s2 = one[order[a:b]].ravel(), two[order[a:b]].ravel()
        # all logits are of the coded bit: its probability is p
        x = (none[NODES[code[a:b]].ravel()] * sign, LOGIT[s1], LOGIT[s2])
        own = np.repeat(doc[a:b], 8)
        gate = own * GATES + 4 * CLASS[s1] + CLASS[s2]
        z = np.take(weights[0], gate) * x[0]
        for k in (1, 2):
            z += np.take(weights[k], gate) * x[k]
        np.clip(z, -12, 12, out=z)
        p = 1 / (1 + np.exp(-z))
        at = own * LEVELS + (np.rint(np.clip(2 * z * sign, -12, 12)) + LEVELS // 2).astype(np.int64)
        there = np.take(level, at)
        # between 3e-6 and one less that: p and the levels never reach zero or one
        final = 0.5 * (p + np.where(bit, there, 1 - there))
        cost = np.log10(final.reshape(-1, 8).prod(axis=1, dtype=np.float64))
        seen[:live] += np.bincount(doc[a:b], cost, live)
        if b == len(code):
            break
        err, wide = 1 - p, live * GATES
        many = RATE / (np.bincount(gate, minlength=wide) + 64)
        for k in range(3):
            weights[k][:wide] += (np.bincount(gate, err * x[k], wide) * many).astype(np.float32)
        wide = live * LEVELS
        miss = np.bincount(at, bit - there, wide)
        level[:wide] += (REFINE_RATE * miss / (np.bincount(at, minlength=wide) + 64)).astype(np.float32)
    return seen[rank]


def _runs(starts: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Neighbouring texts of about ``CODED`` tokens: the first one and the one after
    the last, and where the tokens of these start."""
    cuts = np.append(np.unique((starts + n - 1) // CODED, return_index=True)[1], len(n))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield a, b, int(starts[a]), int(starts[b - 1] + n[b - 1])


def _score(sizes: np.ndarray, bits: int, ranges: int):
    tokens, distinct = int(sizes[:256].sum()), int(sizes[256:].sum())
    shares, none = np.log10(sizes[:256] + sizes[256:] + 1.0), order_nothing(sizes[:256])

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids, (row,) = texts["doc_id"].combine_chunks().flatten(), texts.drop_columns(["doc_id"]).to_pylist()
        letters, h, starts, n = _tokens(row)
        given = sorted(answers.select(["range", "states", "counts"]).to_pylist(), key=lambda r: r["range"])
        cells, at = _places(_cells(h, starts, bits))
        parts = np.split(cells, np.searchsorted(cells, _edges(ranges, bits) << np.uint64(8)))
        given = {r["range"]: r for r in given}
        found = np.concatenate([unpack_states(given[r]["states"], c) for r, c in enumerate(parts) if r in given])
        words, word_at = _places(h)
        counts = np.concatenate([unpack(g["counts"]) for g in given.values()])
        if len(found) != len(cells) or len(counts) != len(words):
            raise ValueError("the answers are not this slice's")
        count = counts[word_at].astype(float)
        code = (h & np.uint64(255)).astype(np.int64)
        logs = np.add.reduceat(np.log10(count + 1), starts)
        one, two = at[:len(h)], at[len(h):]
        score = np.concatenate([
            code_texts(code[s:e], starts[a:b] - s, n[a:b], none, found[one[s:e]], found[two[s:e]])
            for a, b, s, e in _runs(starts, n)]) + logs - np.add.reduceat(shares[code], starts)
        # an unknown word's letters and its end, each one of 251 signs
        spelled = np.add.reduceat(np.where(count > 0, 0, letters + 1), starts) * np.log2(251)
        size = np.maximum(np.array(row["sizes"]), 1)
        return pa.table({
            "doc_id": ids, "n_tokens": n.astype(np.int64), "n_known": np.add.reduceat((count > 0).astype(np.int64), starts),
            "train_tokens": np.full(len(n), tokens, np.int64),
            "base_score": logs - n * np.log10(float(tokens + distinct + 1)), "score": score,
            "bits_per_byte": (spelled - score * np.log2(10)) / size})
    return run


def score(docs: DataFrame, learns: Column, spare_bits: int = SPARE_BITS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known,
    train_tokens, base_score (unigrams with one added) and score, both log10
    probabilities, and bits_per_byte (of the text as it is, with the letters of
    unknown words).  The model learns from the rows where ``learns`` is true (null:
    not), and all rows are scored.

    A null text is an empty one, whose only token is the end; repeated rows
    each get a row and each teach; an empty table gives no rows; other columns
    are not read but by ``learns``.  Without training texts all words are unknown.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    sliced = store(rows.mapInArrow(
        _sliced, f"slice long, doc_id array<{id_type}>, sizes array<long>, learns array<boolean>, texts binary"), "slices")
    chars, slices = sliced.agg(F.coalesce(F.sum(F.expr("aggregate(sizes, 0L, (a, n) -> a + n + 1)")), F.lit(0)), F.count("*")).first()
    bits = min(56, int(chars).bit_length() + spare_bits)
    ranges = 1 + chars // RANGE_CHARS
    tasks = min(MOST_TASKS, max(shuffle_width(docs.sparkSession), 2 * ranges, 2 * slices))
    # numbers of partitions of our own: blocks are small for the work they make
    blocks = sliced.mapInArrow(
        _blocks(bits, ranges), "range long, slice long, cells binary, cell_n binary, words binary, word_n binary")
    answers = store(blocks.repartition(tasks, "range").groupBy("range").applyInArrow(_answer, ANSWER), "answers")
    free_shuffles(docs.sparkSession)
    sizes = np.zeros(512, np.int64)
    for r in answers.select(F.posexplode("sizes").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        sizes[r["k"]] = r["n"]
    out = store(sliced.repartition(tasks, "slice").groupBy("slice").cogroup(
        answers.filter("slice IS NOT NULL").drop("sizes").repartition(tasks, "slice").groupBy("slice")).applyInArrow(
        _score(sizes, bits, ranges), f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, "
                             "score double, bits_per_byte double"), "scored")
    drop_stored(sliced)
    drop_stored(answers)
    return out


def held_out(col: str = "doc_id") -> Column:
    """Rows the model does not learn from."""
    return id_crc(col) % 7 == 2
