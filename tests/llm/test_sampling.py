"""Source mixing, importance resampling and whitening against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from runledger.llm import ranks, resample, sourcemix, whitening

DOCS = "doc_id long, text string, source string, row string, key string, rank int, size string, digest int, copies int, target string"
EXTRA = ("r", "k", 1, "s", 2, 3, "t")


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "x1", "café", "delta.", "a-b", " wide", "omega\n", "\ttab"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, prose(rng, rng.choice([1, 4, 30, 90])), "hot" if i % 3 else f"s{i % 5}") for i in range(150)]
    out += [(200, None, "hot"), (201, "", "s1"), (202, " \t\n", None), (203, "one two three " * 40, None),
            (None, "no id", "s1"), (None, None, None), (7, out[7][1], out[7][2]), (7, out[7][1], out[7][2]),
            (204, "word " * 40_000, "s2"), (205, "x" * 1_000_000, "s3"), (206, "", "blank"), (207, None, "blank"),
            (208, "a b c", ""), (209, "a b", "S"), (210, "a b", "é")]
    return out


def table_of(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


# -- ranks --------------------------------------------------------------------

def test_ranks_within_hot_groups_and_ties(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else rng.choice("ab"), rng.randint(0, 3)) for _ in range(3000)] + [("one", 5)]
    from pyspark.sql import functions as F
    got = defaultdict(list)
    for r in ranks.ranked(spark.createDataFrame(data, "g string, v int").repartition(9), [F.col("v").desc()], "g").collect():
        got[r.g].append((r["rank"], -r.v))
    for g, found in got.items():
        found.sort()
        assert [k for k, _ in found] == list(range(1, sum(d[0] == g for d in data) + 1))
        assert [v for _, v in found] == sorted(v for _, v in found)
    assert ranks.ranked(spark.createDataFrame([], "v int"), [F.col("v")]).count() == 0


# -- mixing -------------------------------------------------------------------

def mix_by_hand(rows, weights=(1, 2, 3), most=3, seed=11):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    held, of = Counter(), defaultdict(list)
    for i, t, s in rows:
        held[s] += size(t)
        of[s].append((size(t), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:16], i))
    names = sorted((s for s in held if s is not None), key=lambda s: s.encode()) + [None] * (None in held)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, share = {}, set(names), Fraction(sum(held.values()))
    while left:                                         # the excess over a limit goes to the others
        level = share / sum(weight[s] for s in left)
        full = {s for s in left if most * held[s] < level * weight[s]}
        if not full:
            target.update({s: level * weight[s] for s in left})
            break
        for s in full:
            target[s] = Fraction(most * held[s])
            share -= target[s]
        left -= full
    out = []
    for s in names:
        rate = math.floor(float(target[s]) / held[s] * 2**31) if held[s] else 0
        start = int(hashlib.sha256(f"{seed}:{'~' if s is None else 's' + s}".encode()).hexdigest()[:8], 16) >> 1
        for k, (n, _, i) in enumerate(sorted(of[s], key=lambda x: x[:2]), 1):
            copies = ((k * rate + start) >> 31) - (((k - 1) * rate + start) >> 31)
            out.append((i, n, held[s], round(float(target[s]), 6), copies, n * copies))
    return out


def tuples(df):
    return [(r["row"].doc_id, r["size"], r.source_size, round(r.target, 6), r.copies, r.taken) for r in df.collect()]


def test_mix_against_prefix_sums(spark, rows):
    docs = table_of(spark, rows)
    got = tuples(sourcemix.plan(docs, keep=["doc_id"]))
    order = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=order) == sorted(mix_by_hand(rows), key=order)
    again = tuples(sourcemix.plan(docs.repartition(7)))
    assert sorted(again, key=order) == sorted(got, key=order)
    assert tuples(sourcemix.plan(docs.limit(0))) == []


def test_mix_meets_targets_and_limits(spark):
    rng = random.Random(8)
    rows = [(i, "w " * min(int(rng.paretovariate(1.2)) + 1, 3000), f"s{min(int(rng.expovariate(0.7)), 6)}") for i in range(4000)]
    got = sourcemix.plan(table_of(spark, rows), ["doc_id", "source"]).collect()
    taken, largest, target = Counter(), Counter(), {}
    for r in got:
        s = r["row"].source
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
        target[s] = r.target
        assert 0 <= r.copies <= 3 and r.target <= 3 * r.source_size
    assert math.isclose(sum(target.values()), sum(r["size"] for r in got), rel_tol=1e-9)
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s]


def test_mix_emits_the_copies(spark, rows):
    docs = table_of(spark, rows)
    want = Counter()
    for r in sourcemix.plan(docs).collect():
        want[(r["row"].doc_id, r["row"].text, r["row"].rank)] += r.copies
    got = Counter((r["row"].doc_id, r["row"].text, r["row"].rank) for r in sourcemix.mix(docs).collect())
    assert got == +want


# -- resampling ---------------------------------------------------------------

def test_operators_cancel_prefixes():
    rng = random.Random(2)
    for _ in range(200):
        a, b = rng.randbytes(rng.choice([0, 1, 9, 700])), rng.randbytes(rng.choice([0, 1, 5, 70_000]))
        got = zlib.crc32(a + b) ^ int(resample.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0])
        assert got == zlib.crc32(b)


def words_of(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def draw_by_hand(rows, target, longest, buckets, least, percent, seed=2024):
    def feats(t):
        w = words_of(t)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(), Counter()
    for r in rows:
        s.update(feats(r[1]))
    for x in target:
        t.update(feats(x))
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for i, text, *_ in rows:
        f = feats(text)
        g = sum(math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in f)
        weight = g // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least])
    can = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    place = {}
    for k, x in enumerate(can[:percent * len(can) // 100], 1):
        place.setdefault(x[0], []).append(k)
    return [(*x[:4], place.get(x[0], [None]).pop(0) if place.get(x[0]) and x[4] else None) for x in out]


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (3, 512, 40)])
def test_draw_against_whole_strings(spark, rows, longest, buckets, percent, monkeypatch):
    target = ["alpha x1 café", None, "", "delta DELTA omega", "a b"]
    got = resample.draw(table_of(spark, rows), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"),
                        longest=longest, buckets=buckets, percent=percent)
    found = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    order = lambda x: tuple(str(v) for v in x)
    want = draw_by_hand(rows, target, longest, buckets, 20, percent)
    assert sorted(f[:4] for f in found if f[0] is not None) == sorted(w[:4] for w in want if w[0] is not None)
    assert sorted(found, key=order) == sorted(want, key=order)


def test_features_across_blocks(spark, rows, monkeypatch):
    docs = table_of(spark, rows)
    small, large = [], []
    for block, out in ((50, small), (1 << 19, large)):
        monkeypatch.setattr(resample, "BLOCK", block)
        batch = resample.prefixes(docs.filter("doc_id < 204"), ["doc_id"]).toArrow().to_batches()
        for b in batch:
            for i, _, crcs, lengths, doc in resample._blocks(b):
                for of, crc in resample.features(crcs, lengths, doc, 2):
                    out += zip((of + i).tolist(), crc.tolist(), strict=True)
    assert sorted(small) == sorted(large) and small


def test_draw_moves_towards_the_target(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["law", "court"] if i % 10 == 0 else ["ball", "goal"], k=30)), "s") for i in range(600)]
    target = spark.createDataFrame([("the law of the court " * 3000,)], "text string")
    drawn = resample.resample(table_of(spark, rows), target)
    assert drawn.columns == table_of(spark, []).columns and drawn.count() == 60
    assert drawn.filter("text LIKE '%court%'").count() >= 55          # one document in ten holds the target's words


def test_draw_of_empty_tables(spark, rows):
    none = spark.createDataFrame([], "text string")
    assert resample.draw(table_of(spark, []), none).count() == 0
    assert resample.draw(table_of(spark, rows), none).count() == len(rows)


# -- whitening ----------------------------------------------------------------

def vectors(spark, data):
    return spark.createDataFrame([(i, v, 1, 2, "x", 0.5) for i, v in data],
                                 "vec_id long, embedding array<float>, component int, n int, x string, at double")


def whiten_by_hand(data, components):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in data])
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    return c @ q / np.sqrt(e), e / np.trace(c.T @ c / n), [sum(int(n * v - t) ** 2 for v, t in zip(r.tolist(), s.tolist(), strict=True)) for r in x]


def check_whitened(got, data, components, tolerance=1e-9):
    w, share, dev = whiten_by_hand(data, components)
    m = w.shape[1]
    ids = {i: k for k, (i, _) in enumerate(data)}
    out = np.zeros_like(w)
    for r in got:
        out[ids[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(data) and int(r.deviation) == dev[ids[r.vec_id]]
        assert math.isclose(r.explained, share[r.component - 1], rel_tol=1e-9) and r.identity_error <= 1e-9
    assert len(got) == len(data) * m
    sign = np.sign((out * w).sum(axis=0))
    assert np.abs(out * sign - w).max() <= tolerance * np.abs(w).max()


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(6)
    shape = rng.standard_normal((24, 24)) * np.linspace(0.05, 8, 24)
    data = [(i, (rng.standard_normal(24) @ shape + 5).astype("f4").tolist()) for i in range(400)]
    check_whitened(whitening.whiten(vectors(spark, data), components=16).collect(), data, 16, 1e-8)
    check_whitened(whitening.whiten(vectors(spark, data)).collect(), data, 32, 1e-8)      # fewer dimensions than components


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(7)
    good = [(i, rng.standard_normal(6).astype("f4").tolist()) for i in range(40)]
    good += [(None, good[3][1]), (50, [1e3] + [0.0] * 5)]
    bad = [(60, None), (61, [None] + [0.0] * 5), (62, [math.nan] * 6), (63, [math.inf] * 6), (64, []), (65, [1.0, 2.0]), (66, [3e38] * 6)]
    check_whitened(whitening.whiten(vectors(spark, good + bad)).collect(), good, 6, 1e-6)


def test_whitening_of_few_dimensions(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    rng = np.random.default_rng(9)
    line = [(i, [float(a), 2 * float(a), 0.0, 1.0]) for i, a in enumerate(rng.integers(-50, 50, 60))]
    got = whitening.whiten(vectors(spark, line)).collect()
    assert {r.component for r in got} == {1} and math.isclose(got[0].explained, 1.0, rel_tol=1e-12)
    # equal deviations in every direction: one run of steps alone would find one of them
    cube = [(k, [float(4 * (s if j == k // 2 else 0)) for j in range(5)]) for k in range(10) for s in [1 if k % 2 else -1]]
    got = whitening.whiten(vectors(spark, cube)).collect()
    assert len(got) == 50 and max(r.identity_error for r in got) < 1e-12
    assert all(math.isclose(r.explained, 0.2, rel_tol=1e-12) for r in got)
