"""Counterfactual-regularised toxicity classifier.

Logistic regression over the words of a text and their first letters.  The
words of an identity group are swapped for another group's in the labelled
texts; the squared change of the score's logit is part of the loss, so that a
text's score does not hang on which group it mentions.  Features are ranked by
their log odds ratio, shrunken by its variance; none is dropped for too few
labelled texts, but the less a feature's own ratio says, the more the ridge
holds its weight down.  The fit reads a bounded sample of labelled texts; every
text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, id_crc, store, text_of, worker_state

SAMPLE_ROWS = 20_000      # labelled texts that the fit reads at most
FEATURES = 2_000          # features kept at most, the most telling first
LEAST_TEXTS = 3           # labelled texts that hold a feature
ODDS_VARIANCE = 4.0       # of log odds ratios between features; what a ratio is shrunken against
LEVELS = 64               # of the shrunken ratio, a unit
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3
SWAP_WEIGHT = 1.0
RIDGE = 5.0               # of a feature with a shrunken log odds ratio of one, over all texts
LEAST_ODDS = 0.1          # that the ridge counts
STEPS = 600
WORDS_KEPT = 150_000

# fixed values: words of identity groups; the words of a row are swapped for one another
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("old", "young"), ("deaf", "blind", "disabled"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
SWAPS = {w: row[(k + 1) % len(row)] for row in IDENTITY for k, w in enumerate(row)}

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    return [f"={word}", *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]


def _text_features(words) -> set[str]:
    return {f for w in words for f in features_of(w)}


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts that have each feature, by label, summed over the partition."""
    with_, without = Counter(), Counter()
    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            (with_ if toxic else without).update(_text_features(words_of(text)))
    names = list(with_.keys() | without.keys())
    for s in range(0, len(names), 100_000):
        part = names[s:s + 100_000]
        yield pd.DataFrame({"feature": part, "a": [with_[f] for f in part], "b": [without[f] for f in part]})


def _vectors(names: dict[str, int]):
    """Feature numbers of each text, and of its counterfactual where it mentions a group."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                words = words_of(text)
                own = sorted(names[f] for f in _text_features(words) if f in names)
                other = None
                if not words.isdisjoint(SWAPS):
                    swapped = {SWAPS.get(w, w) for w in words}
                    other = sorted(names[f] for f in _text_features(swapped) if f in names)
                out.append((int(toxic), own, other))
            yield pd.DataFrame(out, columns=["toxic", "own", "other"])
    return run


def _fit(rows: list, n: int, odds: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch Adam on cross entropy, the
    counterfactual penalty and a ridge that falls with the features' ``odds``
    (shrunken log odds ratios; one without them)."""
    y = np.array([r["toxic"] for r in rows], float)
    ridge = RIDGE / len(y) / np.maximum(np.ones(n) if odds is None else odds, LEAST_ODDS) ** 4

    def flat(lists):
        at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return at, np.array([f for x in lists for f in x], np.int64)

    at, f = flat([r["own"] for r in rows])
    twins = [(r["own"], r["other"]) for r in rows if r["other"] is not None]
    (pa, pf), (qa, qf) = flat([p for p, _ in twins]), flat([q for _, q in twins])
    w, b = np.zeros(n + 1), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    w[n] = b
    for t in range(1, STEPS + 1):
        z = w[n] + np.bincount(at, w[f], len(y))
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = np.append(np.bincount(f, err[at], n), err.sum()) + np.append(ridge * w[:n], 0)
        if twins:
            gap = np.bincount(pa, w[pf], len(twins)) - np.bincount(qa, w[qf], len(twins))
            push = 2 * SWAP_WEIGHT * gap / len(y)
            g[:n] += np.bincount(pf, push[pa], n) - np.bincount(qf, push[qa], n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Reads at most ``sample_rows`` labelled ids: all, or those whose hash falls
    below a cut.
    Null labels and ids without a text teach nothing; an id labelled twice
    counts as toxic if either says so; a null text is empty.  Without labels
    every score is one half.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    # a cut of the id's hash instead of a top-k, which one task would have to sort; a
    # twentieth below the bound, so that chance stays below it
    cut = 1 << 30 if n <= sample_rows else int((1 << 30) * 0.95 * sample_rows / n)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut)
    texts = docs.select("doc_id", text_of().alias("text"))
    # sample_rows narrow rows at most are broadcast
    sample = store(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "labelled")
    sizes = dict(sample.groupBy((F.col("toxic") > 0).alias("t")).count().collect())
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return {"weights": {}, "bias": 0.0 if not n1 and not n0 else (4.0 if n1 else -4.0)}
    counts = sample.mapInPandas(_count, "feature string, a long, b long").groupBy("feature").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    na, nb = F.lit(n1) - F.col("a") + 0.5, F.lit(n0) - F.col("b") + 0.5
    spread = 1 / a + 1 / na + 1 / b + 1 / nb
    ratio = F.abs(F.log(a / na) - F.log(b / nb)) * ODDS_VARIANCE / (ODDS_VARIANCE + spread)
    swapped = sorted(f"={w}" for w in SWAPS)                      # the swapped words always have a weight
    ranked = store(counts.filter((F.col("a") + F.col("b") >= LEAST_TEXTS) | F.col("feature").isin(swapped))
                   .select("feature", ratio.alias("odds")), "features")
    level, least, many = F.floor(F.col("odds") * LEVELS), 0, 0
    for r in sorted(ranked.groupBy(level.alias("level")).count().collect(), reverse=True):     # some 1,000 levels at most
        least, many = r["level"], many + r["count"]
        if many >= FEATURES:
            break
    # only the last level's rows are more than are kept, so that no task sorts all features
    best = ranked.filter(level >= least).orderBy(F.desc("odds"), "feature").limit(FEATURES).collect()
    odds = {r["feature"]: r["odds"] for r in [*best, *ranked.filter(F.col("feature").isin(swapped)).collect()]}
    kept = [*odds, *(f for f in swapped if f not in odds)]
    drop_stored(ranked)
    names = {f: k for k, f in enumerate(kept)}
    # at most sample_rows short lists; sorted here, so that the sums don't depend on the tasks' order
    rows = sorted(sample.mapInPandas(_vectors(names), "toxic int, own array<int>, other array<int>").collect(),
                  key=lambda r: (r["toxic"], r["own"], r["other"] or []))
    drop_stored(sample)
    weights, bias = _fit(rows, len(kept), np.array([odds.get(f, 0.0) for f in kept]))
    return {"weights": {f: float(weights[k]) for f, k in names.items() if weights[k]}, "bias": bias}


def score(model: dict, text: Column) -> Column:
    """Probability that a text is toxic; a null text is an empty one."""
    weights, bias = model["weights"], model["bias"]
    key = f"toxicity:{hash(frozenset(weights.items()))}"

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        hits = worker_state(key, dict)        # word -> its features that have a weight
        out = []
        for t in texts:
            found: set[str] = set()
            for w in words_of(t or ""):
                h = hits.get(w)
                if h is None:
                    if len(hits) >= WORDS_KEPT:
                        hits.clear()
                    h = hits[w] = tuple(f for f in features_of(w) if f in weights)
                if h:
                    found.update(h)
            out.append(bias + sum(weights[f] for f in sorted(found)))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, float), -40, 40))))

    return scores(text)


def held_out(col: str = "doc_id") -> Column:
    """Rows whose labels the fit never sees."""
    return id_crc(col) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; an empty
    table gives no rows, repeated rows stay, other columns are not read."""
    model = fit(docs, labels.filter(~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, all columns as they are."""
    model = fit(docs, labels.filter(~held_out()))
    return docs.filter(score(model, F.col("text")) < threshold)
