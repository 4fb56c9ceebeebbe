"""Edit-aware token counts.

Every document keeps a segment tree over runs of its words: per node the
characters and the tokens below it.  Its leaves are stored; the inner sums are
added up when a task reads them.  An edit finds its leaves by descending
the character sums; only those leaves and the context up to the next seam
between words are encoded again, and the sums on the way to the root are
updated.  A seam (a space or newline after a non-space) is a token boundary in
any context, so the counts equal those of the whole edited text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, text_of
from .tokens import vocabulary_path, word_ids

LEAF_WORDS = 32
FULL_LEAF = 4           # a leaf of more than so many times LEAF_WORDS is split


class Tree:
    """Sums of characters and tokens over leaves, node 1 the root, the
    children of i at 2i and 2i+1, as many leaves as a power of two."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.sums = np.array([chars, tokens], np.int64)
        self.leaves = self.sums.shape[1] // 2

    @classmethod
    def over(cls, chars, tokens) -> Tree:
        n = 1 << max(0, len(chars) - 1).bit_length()
        sums = np.zeros((2, 2 * n), np.int64)
        sums[0, n:n + len(chars)], sums[1, n:n + len(tokens)] = chars, tokens
        while n > 1:
            sums[:, n // 2:n] = sums[:, n:2 * n:2] + sums[:, n + 1:2 * n:2]
            n //= 2
        return cls(*sums)

    def stored(self) -> np.ndarray:
        """The leaves without the empty ones at the end: all other sums follow from them."""
        below = self.sums[:, self.leaves:]
        return below[:, :max(1, int(np.flatnonzero(below[0]).max(initial=0)) + 1)]

    def leaf_at(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character ``pos``, and the place where it starts."""
        node, start = 1, 0
        while node < self.leaves:
            left = int(self.sums[0, 2 * node])
            node, start = (2 * node, start) if pos < start + left else (2 * node + 1, start + left)
        return node - self.leaves, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.leaves + leaf
        self.sums[:, node] = chars, tokens
        while node > 1:
            node //= 2
            self.sums[:, node] = self.sums[:, 2 * node] + self.sums[:, 2 * node + 1]


def _runs(chars: list[int], tokens: list[int], count: int) -> list[tuple[int, int]]:
    """Words dealt into ``count`` consecutive runs: (characters, tokens) of each."""
    at = np.arange(count) * len(chars) // count
    if not len(chars):
        return [(0, 0)] * count
    cut = np.append(at, len(chars))
    c, t = np.append(0, np.cumsum(chars)), np.append(0, np.cumsum(tokens))
    return list(zip(np.diff(c[cut]).tolist(), np.diff(t[cut]).tolist(), strict=True))


def plant(chars: list[int], tokens: list[int]) -> Tree:
    runs = _runs(chars, tokens, max(1, -(-len(chars) // LEAF_WORDS)))
    return Tree.over([c for c, _ in runs], [t for _, t in runs])


def accepted(edits, n_chars: int) -> list[tuple[int, int, str]]:
    """(start, end, insert) of the edits that hold, in order: places are cut to
    the text, and of edits that overlap or start together the first by (start,
    length, insert) holds."""
    out, free = [], 0
    for start, length, insert in sorted((e["start"], e["length"], e["insert"]) for e in edits):
        start = min(max(start, 0), n_chars)
        if out and (start < free or start == out[-1][0]):
            continue
        free = min(n_chars, start + max(length, 0))
        out.append((start, free, insert))
    return out


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, insert in edits:
        parts += [text[at:start], insert]
        at = end
    return "".join([*parts, text[at:]])


def apply(words, text: str, tree: Tree, edits: list[tuple[int, int, str]]) -> tuple[Tree, int]:
    """The tree of the edited text, and the characters that were encoded for it."""
    last = len(text) - 1
    groups: list[list] = []                # leaf, last leaf, start and end of the region, its edits
    for e in edits:
        first, begin = tree.leaf_at(min(max(e[0] - 1, 0), max(last, 0)))
        until, start = tree.leaf_at(min(e[1], max(last, 0)))
        end = start + int(tree.sums[0, tree.leaves + until])
        if groups and first <= groups[-1][1]:
            g = groups[-1]
            g[1], g[3] = max(g[1], until), max(g[3], end)
            g[4].append(e)
        else:
            groups.append([first, until, begin, end, [e]])
    regions = [edited(text[b:t], [(s - b, f - b, i) for s, f, i in es]) for _, _, b, t, es in groups]
    found = words.units(regions)
    work = sum(len(r) for r in regions)
    grown = any(len(c) > FULL_LEAF * LEAF_WORDS * (g[1] - g[0] + 1) for g, (c, _) in zip(groups, found, strict=True))
    if not grown:
        for g, (c, t) in zip(groups, found, strict=True):
            for k, run in enumerate(_runs(c, t, g[1] - g[0] + 1)):
                tree.put(g[0] + k, *run)
        return tree, work
    leaves, at = [], 0                     # a leaf got too full: other leaves keep their counts
    old = list(zip(*tree.sums[:, tree.leaves:].tolist(), strict=True))
    for g, (c, t) in zip(groups, found, strict=True):
        leaves += old[at:g[0]] + _runs(c, t, max(1, -(-len(c) // LEAF_WORDS)))
        at = g[1] + 1
    leaves += old[at:]
    return Tree.over([c for c, _ in leaves], [t for _, t in leaves]), work


def _build(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(path)
        for pdf in batches:
            leaves = [plant(*u).stored() for u in words.units(pdf["text"].tolist())]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": pdf["digest"],
                                "chars": [t[0] for t in leaves], "tokens": [t[1] for t in leaves]})
    return run


def build(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The trees of ``docs`` (doc_id, text): doc_id, digest (of the text),
    chars and tokens (of the leaves; the text's counts are their sums).  A null
    text is an empty one and has one empty leaf."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(text_of()).alias("digest"), text_of().alias("text")).mapInPandas(
        _build(path or vocabulary_path()), f"doc_id {id_type}, digest long, chars array<int>, tokens array<int>")


def _apply(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(path)
        for pdf in batches:
            out = []
            for doc, text, chars, tokens, edits, more in zip(
                    *(pdf[c] for c in ("doc_id", "text", "chars", "tokens", "edits", "more")), strict=True):
                hold = accepted(edits, len(text))
                tree = Tree.over(chars, tokens)
                before = int(tree.sums[1, 1])
                tree, work = apply(words, text, tree, hold)
                out.append((doc, before, len(hold), len(edits) - len(hold) + more, int(tree.sums[0, 1]),
                            int(tree.sums[1, 1]), work, *tree.stored()))
            yield pd.DataFrame(out, columns=["doc_id", "tokens_before", "edits", "rejected", "n_chars",
                                             "n_tokens", "encoded_chars", "chars", "tokens"])
    return run


def recount(docs: DataFrame, trees: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """Counts after ``edits`` (doc_id, start, length, insert; places in the
    stored text, in code points) of ``docs``, whose ``trees`` are ``build``'s.

    One row per document row: doc_id, tokens_before, edits (that held),
    rejected, n_chars and n_tokens (of the edited text), encoded_chars, and
    the new chars and tokens of the leaves.  Edits with a null id, start or length are
    dropped, a null insert is empty, equal edits are one, ids that no document
    has change nothing; see ``accepted`` for overlaps.  Documents alike in id
    share their edits.  Empty tables give no rows, or no changes.
    """
    listed = (edits.select("doc_id", "start", "length", F.coalesce("insert", F.lit("")).alias("insert"))
              .filter("doc_id IS NOT NULL AND start IS NOT NULL AND length IS NOT NULL").distinct()
              # distinct places only: a document has no more than its own length of them
              .groupBy("doc_id", "start").agg(F.min(F.struct("length", "insert")).alias("e"), F.count("*").alias("n"))
              .groupBy("doc_id").agg(F.collect_list(F.struct("start", "e.length", "e.insert")).alias("edits"),
                                     F.sum(F.col("n") - 1).alias("more")))
    # the edits find their digest on narrow rows, so that trees and texts are each shuffled once, by one key
    own = trees.select("doc_id", "digest").distinct().join(listed, "doc_id")
    marked = trees.join(own.hint("merge"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    marked = marked.select(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest"), "chars", "tokens", "edits", "more")
    rows = docs.select("doc_id", text_of().alias("text"))
    same = (F.col("doc_id") == F.col("of_id")) & (F.xxhash64("text") == F.col("of_digest"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    changed = rows.join(marked.hint("merge"), same).select("doc_id", "text", "chars", "tokens", "edits", "more").mapInPandas(
        _apply(path or vocabulary_path()),
        f"doc_id {id_type}, tokens_before long, edits long, rejected long, n_chars long, n_tokens long, "
        "encoded_chars long, chars array<int>, tokens array<int>")
    still = trees.join(listed.select("doc_id"), "doc_id", "left_anti")
    zero = F.lit(0).cast("long")
    total = lambda c: F.aggregate(c, zero, lambda a, n: a + n)
    return changed.unionByName(still.select(
        "doc_id", total("tokens").alias("tokens_before"), zero.alias("edits"), zero.alias("rejected"),
        total("chars").alias("n_chars"), total("tokens").alias("n_tokens"),
        zero.alias("encoded_chars"), "chars", "tokens"))
