"""Each operator against a brute-force version on rows with nulls, empty and
long texts, ties, repeated rows and columns whose names clash."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from runledger.llm import chat, decontam, linechunks, mixing, packing, sharding, simhash, toxicity, vectors
from runledger.llm.components import components
from runledger.llm.tokens import WordIds, vocabulary_path

SCHEMA = ("doc_id long, text string, row string, digest string, bits int, score double, "
          "shard int, position int, bin int, gone int, lines_ int")
EXTRA = ("r", "d", 1, 0.5, 2, 3, 4, 5, 6)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta.", "eta,", "x1", "\u00e9t\u00e9", "omega\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.choice([1, 5, 40, 200]))) for i in range(40)]
    out += [(100, None), (101, ""), (102, "  \t\n"), (None, "no id here"), (None, None), (7, out[7][1]), (7, out[7][1]),
            (103, out[3][1]), (104, prose(rng, 9000)), (105, "word " * 3000)]
    return out


def unions(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x
    for a, b in pairs:
        p, q = root(a), root(b)
        if p != q:
            up[max(p, q)] = min(p, q)
    return {n: root(n) for n in nodes}


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(40)]
    edges = chain + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(70)] + [(500, n) for n in range(501, 560)] + [(9, 9), (5, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges_ = [(a, b) for a, b in edges if a != b]
    want = unions(edges_, {n for e in edges_ for n in e})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 ------------------------------------------------------------------------------

def test_best_fit_fills():
    home, offset, fill = packing.best_fit(np.array([6, 4, 5, 5, 3, 7]), 10)
    assert sorted(fill[np.unique(home)].tolist()) == [10, 10, 10]


def test_pack(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "MERGE_TASK_BINS", 7)
    tok = WordIds(vocabulary_path()).tokenizer
    got = packing.pack(docs_of(spark, rows).repartition(6), with_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for k, (s, e) in enumerate([(0, first)] + [(s, s + 1024) for s in range(first, len(ids), 1024)]):
            want[(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 1024 + 1
    assert packing.pack(docs_of(spark, [])).count() == 0


# 2 ------------------------------------------------------------------------------

def test_shards(spark, rows, tmp):
    docs = docs_of(spark, rows).unionByName(docs_of(spark, [(9, "same")] * 60)).repartition(3).cache()
    got = sharding.shard(docs, shards=7, bucket_bytes=500).select("row.*", sharding.F.col("shard").alias("at"), "slot").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in docs.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r["at"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard(docs.limit(0)).count() == 0
    assert sharding.shard(docs.limit(3), shards=7).select("shard").distinct().count() == 3
    sharding.write_shards(sharding.shard(docs, shards=7), f"{tmp}/out")
    assert spark.read.parquet(f"{tmp}/out").count() == docs.count()
    docs.unpersist()


# 3 ------------------------------------------------------------------------------

@pytest.mark.parametrize("chunk", [3, 256])
def test_vectors(spark, chunk):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    rows = []
    for i in range(150):
        v = base[i % 12] + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.1, 0.3])
        rows.append((i, v.astype("float32").tolist(), int(i % 12 // 4)))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] + [1.0] * 15, 1),
             (204, [None] + [1.0] * 15, 1), (205, rows[0][1], None), (206, [], 0), (207, rows[0][1][:8], 0),
             (208, [1e30] * 16, 2), (209, [1e-30] * 16, 2), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2])]
    got = vectors.near_duplicates(spark.createDataFrame(
        [(*r, "x", 1, "z") for r in rows], "vec_id long, embedding array<float>, label int, class string, links int, block string"),
        chunk=chunk).collect()
    good = []
    for k, (i, v, lab) in enumerate(rows):
        a = None if v is None or None in v or not v else np.array(v, "float32").astype(float)
        ok = lab is not None and a is not None and np.isfinite(a).all() and a.any()
        good.append((k, i, lab, a / np.linalg.norm(a)) if ok else None)
    good = [g for g in good if g]
    n, pairs = Counter(), []
    for x in range(len(good)):
        for y in range(x):
            (_, i, la, a), (_, j, lb, b) = good[x], good[y]
            if la == lb and len(a) == len(b) and a @ b >= 0.98:
                n[good[x][0]] += 1
                n[good[y][0]] += 1
                pairs.append((i, j))
    comp = unions(pairs, {r[0] for r in rows})
    want = Counter((r[0], n[k], comp[r[0]], comp[r[0]] == r[0]) for k, r in enumerate(rows))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# 4 ------------------------------------------------------------------------------

def test_decontamination(spark):
    items = [(1, "If Tom buys 12 apples for 30 dollars and Tom eats 4 of the apples how many does he keep today"),
             (2, "short one here"), (3, None), (4, ""), (5, "a train that leaves the town at noon moves with 60 km per hour to the coast by night")]
    same = items[0][1]
    other = same.replace("Tom", "Anna").replace("12", "15").replace("30", "45")
    broken = same.replace("buys 12", "buys 15").replace("Tom eats", "Anna eats").replace("If Tom", "If Bill")
    rows = [(1, f"intro words. {same}. Then more."), (2, f"Some text before this. {other}"), (3, broken), (4, None), (5, ""),
            (6, "nothing of the kind is in this text at all, it is only about the sea and the wind"),
            (7, "we say short one here now"), (8, same.upper()), (9, f"x {same} y"), (9, f"x {same} y"),
            (10, "A train that leaves the town at noon moves with 90 miles per hour to the coast by night."), (None, f"n {same}")]
    docs = docs_of(spark, rows)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, windows int")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench).collect()}
    assert {k for k in got if k[1] != 2} == {(1, 1), (2, 1), (8, 1), (9, 1), (None, 1), (10, 5)}
    assert {k for k in got if k[1] == 2} == {(7, 2)}
    assert got[(1, 1)].changed_slots == 0 and got[(2, 1)].changed_slots >= 2 and got[(10, 5)].changed_slots == 2
    assert sorted(str(r.doc_id) for r in decontam.keep_clean(docs, bench).collect()) == ["3", "4", "5", "6"]
    assert decontam.keep_clean(docs, bench).columns == docs.columns
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_equal_numbers_may_change_apart(spark):
    item = "On the farm there are 2 cats and 2 dogs that chase the birds over the hill every day"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of(spark, [(1, item.replace("2 cats", "3 cats").replace("2 dogs", "5 dogs")), (2, item.replace("2", "3")),
                           (3, "On the farm there were many animals and 2 of them chase birds")])
    got = {r.doc_id: (r.matched, r.windows, r.slots, r.changed_slots) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {1: (14, 14, 2, 2), 2: (14, 14, 1, 1)}


def test_long_degenerate_texts_are_survived(spark):
    hard = ["1," * 500_000, "a'" * 500_000, "1:2/3." * 200_000, "word" * 250_000, "\n" * 1_000_000, ":" * 1_000_000]
    docs = docs_of(spark, list(enumerate(hard)))
    bench = spark.createDataFrame([(1, "a train that leaves the town at noon moves to the coast by night")], "item_id long, text string")
    assert decontam.contaminated(docs, bench).count() == 0
    turns = spark.createDataFrame([(1, k, t, "x") for k, t in enumerate(["r" * 1_000_000, ":" * 300_000, "\\" * 300_000])],
                                  "conv_id long, turn long, role string, text string")
    back = chat.read_segments(chat.format_segments(turns)).first()
    assert [t.role for t in back.turns] == ["r" * 1_000_000, ":" * 300_000, "\\" * 300_000]


# 5 ------------------------------------------------------------------------------

def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1200):
        bad = i % 5 == 0
        words = [rng.choice("the of women men wind sea stone river green table muslim christian".split()) for _ in range(20)]
        if bad:
            words[rng.randint(0, 9)] = rng.choice(["scumbag", "nastyfool", "nastyfools", "idiot"])
            words += ["women"] * rng.choice([0, 1])           # the group is mentioned more often in toxic texts
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), 9))
    rows += [(2900, None), (2901, ""), (2902, "women women women and men"), (2903, "an idiot " * 5000), (2903, "an idiot " * 5000), (None, "idiot")]
    labels += [(5, None, 9), (None, 1, 9), (5, 1, 9), (9999, 1, 9)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    got = [r for r in toxicity.classify(docs_of(spark, rows), lab).collect()]
    assert len(got) == len(rows)
    truth = {i: t for i, t, _ in labels if t is not None}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 1200:
            assert r.predicted == truth[r.doc_id]
    flags = {r.doc_id: r.predicted for r in got}
    assert flags[2902] == flags[2900] == flags[2901] == 0 and flags[2903] == flags[None] == 1
    clean = toxicity.keep_clean(docs_of(spark, rows), lab)
    assert clean.columns == docs_of(spark, []).columns and clean.filter("doc_id = 2903").count() == 0
    assert toxicity.classify(docs_of(spark, []), lab).count() == 0
    assert {r.score for r in toxicity.classify(docs_of(spark, rows[:5]), lab.limit(0)).collect()} == {0.5}


def test_few_toxic_labels_teach_their_words(spark):
    """Some 30 toxic rows, each with one of six words that 3 to 8 of them hold and no clean row."""
    rng = random.Random(11)
    fillers = [f"{a}{b}" for a in ("sto", "wi", "ta", "gre", "li", "ma") for b in ("ne", "nd", "ble", "en", "ght", "rk", "ps", "lo")]
    bad = [("vexmok", 3), ("drulp", 4), ("quazzit", 5), ("hobbrek", 6), ("yimful", 7), ("pnorg", 8)]
    learned = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(learned[k], " ".join([*rng.choices(fillers, k=25), w]))
            for k, w in enumerate(w for w, n in bad for _ in range(n))]
    toxic = {i for i, _ in rows}
    rows += [(i, " ".join(rng.choices(fillers, k=25))) for i in learned[len(rows):300]]
    labels = spark.createDataFrame([(i, int(i in toxic), 0) for i, _ in rows], "doc_id long, toxic int, text int")
    new = [(9000 + k, " ".join([*rng.choices(fillers, k=12), w])) for k, (w, _) in enumerate(bad)]
    new += [(9500 + k, " ".join(rng.choices(fillers, k=12))) for k in range(20)]
    got = {r.doc_id: r.predicted for r in toxicity.classify(docs_of(spark, rows + new), labels).collect()}
    assert [got[9000 + k] for k in range(len(bad))] == [1] * len(bad)
    assert sum(got[9500 + k] for k in range(20)) == 0


def test_the_penalty_evens_out_groups():
    rows = [{"toxic": int(i % 3 == 0), "own": [0, 1] if i % 3 == 0 else [2], "other": [0, 2] if i % 3 == 0 else [1]} for i in range(60)]
    w, _ = toxicity._fit(rows, 3)
    plain, _ = toxicity._fit([{**r, "other": None} for r in rows], 3)
    assert abs(w[1] - w[2]) < 0.2 * abs(plain[1] - plain[2])


# 6 ------------------------------------------------------------------------------

def brute_units(text):
    return [u for u in re.split(linechunks.CUT, text or "") if u]


def brute_chunks(units):
    """(first, last) places of each chunk."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    h = [md5(u.rstrip(" \t\r\n")) for u in units]
    r = [md5((h[i - 1][:8] if i else "") + h[i]) for i in range(len(h))]
    out, at = [], 0
    for i in range(len(units)):
        if i == len(units) - 1 or (i and r[i] < r[i - 1] and r[i] <= r[i + 1]):
            out.append((at, i))
            at = i + 1
    return out


def brute_dedup(rows):
    """(id, text) -> new text, passages and words removed."""
    keys = sorted({(i is not None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), i, t) for i, t in rows}, key=lambda k: k[:3])
    first, want = {}, {}
    for _, _, _, i, t in keys:
        raw = brute_units(t)
        units = [u.rstrip(" \t\r\n") for u in raw]
        chunks, gone = brute_chunks(units), set()
        for k, (a, b) in enumerate(chunks):
            own = units[a:b + 1]
            after = units[b + 1:chunks[k + 1][1] + 1] if k + 1 < len(chunks) else []
            if len(own) < 2 or not "".join(own[-2:]).strip():
                continue
            if first.setdefault((0, tuple(own)), (i, t, k)) != (i, t, k):
                gone.update(range(a, b + 1))
            at, old, new = first.setdefault((1, tuple(own[-2:])), ((i, t, k), own, after))
            if at != (i, t, k):
                n = next((j for j, (x, y) in enumerate(zip(own[::-1], old[::-1])) if x != y), min(len(own), len(old)))
                m = next((j for j, (x, y) in enumerate(zip(after, new)) if x != y), min(len(after), len(new)))
                gone.update(range(b + 1 - n, b + 1 + m))
        passages = words = 0
        for a in sorted(gone):
            if a - 1 in gone:
                continue
            b = a
            while b + 1 in gone:
                b += 1
            many = len("".join(raw[a:b + 1]).split())
            if many >= linechunks.LEAST_WORDS:
                passages, words = passages + 1, words + many
                raw[a:b + 1] = [""] * (b + 1 - a)
        want[(i, t)] = (None if t is None else "".join(raw), passages, words)
    return want


def sentences(rng, words):
    out = []
    for k in range(words):
        out.append("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) + (rng.choice([",", ".", ";"]) if rng.random() < 0.2 else ""))
    return " ".join(out)


def deduped(spark, rows):
    got = linechunks.dedup_lines(docs_of(spark, rows)).select(
        "row.doc_id", linechunks.F.col("row.text").alias("old"), "text", "removed_passages", "removed_words").collect()
    assert len(got) == len(rows)
    return {(r.doc_id, r.old): (r.text, r.removed_passages, r.removed_words) for r in got}


def test_line_chunks(spark):
    rng = random.Random(4)
    passages = [[f"line {p} {k}, {rng.random()}" for k in range(12)] for p in range(3)]
    rows = []
    for i in range(40):
        own = [f"own {i} {k}; {rng.random()}" for k in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(own + passages[i % 3] + own[:2] if i % 4 else own)))
    rows += [(100, None), (101, ""), (102, "\n\n\n\n\n\n\n"), (103, "\n\n\n\n\n\n\n"), (5, rows[5][1]), (None, rows[6][1]),
             (104, "\n".join(["same"] * 3000)), (105, "\r\n".join(passages[0])), (106, "中文。" * 40), (107, "a, " * 400),
             (108, sentences(rng, 30000)), (109, "x" * 200_000),
             (110, "a\x01, b\n" + rows[7][1] + ", \x01")]
    got = deduped(spark, rows)
    assert got == brute_dedup(rows)
    assert sum(w for _, _, w in got.values()) > 800
    assert linechunks.dedup_lines(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("lines", [1, 2, 3, 5])
def test_line_chunks_find_planted_passages(spark, lines):
    """Passages of 50 to 100 words, on some lines between foreign ones, go but for one copy."""
    rng = random.Random(lines)
    rows, planted, lost = [], [], 0
    for p in range(60):
        words = sentences(rng, rng.randint(51, 100)).split(" ")
        cuts = [len(words) * k // lines for k in range(lines + 1)]
        planted.append("\n".join(" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:])))
        for k in range(3):
            rows.append((3 * p + k, "\n".join([sentences(rng, 40), planted[-1], sentences(rng, 40)])))
    rows += [(1000 + k, sentences(rng, 80)) for k in range(40)]
    got = deduped(spark, rows)
    for (i, old), (new, passages, words) in got.items():
        if i >= 1000 or i % 3 == 0:
            assert new == old
        else:
            at = old.index(planted[i // 3])
            assert new.startswith(old[:at]) and new.endswith(old[at + len(planted[i // 3]):].lstrip())
            lost += words / len(planted[i // 3].split())
    assert lost / 120 > 0.93
    assert sum(p > 0 for _, p, _ in got.values()) >= 114


# 7 ------------------------------------------------------------------------------

def test_chat(spark):
    hard = ["\\### Assistant: </turn> ok", "\n</turn>\n### user:\n", "\\", "\\\\", "", None, "### a:\n", "plain", "</turn>", ":", "\u00e9\u4e2d\U0001f600"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "a:b\n</turn>\n### x", None]), rng.choice(hard)) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(50, t, "assistant" if t % 3 else "user", f"t{t}") for t in range(500)]
    rows += [(51, 1, "user", "tie b"), (51, 1, "user", "tie a"), (51, 1, "user", "tie a"), (51, None, "system", "first"),
             (None, 0, "user", "no id"), (52, 0, "assistant", "long " * 50_000)]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, body string, segment int")
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    want = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in want.items()}
    segments = chat.format_segments(turns)
    back = defaultdict(list)
    for r in sorted(chat.read_segments(segments).collect(), key=lambda r: r.segment):
        back[r.conv_id].append(r)
    assert {c: [tuple(t) for s in v for t in s.turns] for c, v in back.items()} == want
    assert {c: [x for s in v for x in s.loss] for c, v in back.items()} == {c: [x for r, x in v if r == "assistant"] for c, v in want.items()}
    whole = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    for c, v in want.items():
        f = whole[c].formatted
        at, lost = 0, []
        for p in whole[c].loss:
            lost += [f[at + s.start:at + s.start + s.length] for s in p.spans]
            at += p.chars
        assert at == len(f) == sum(s.chars for s in back[c])
        assert len(lost) == sum(r == "assistant" for r, _ in v)
        heads = sum(1 for k in range(len(v)) if not k or v[k][0] != v[k - 1][0])
        assert ("\n" + f).count("\n### ") == heads or c != 50
    assert chat.format_segments(turns.limit(0)).count() == 0


# 9 ------------------------------------------------------------------------------

def brute_print(text):
    import xxhash
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    sh = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    v = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return v - (1 << 64) if v >> 63 else v


def test_simhash(spark, rows):
    rng = random.Random(11)
    more, long = [], rows[-2][1].split(" ")
    for k in range(30):
        w = list(long)
        w[rng.randrange(len(w))] = "changed"
        more.append((300 + k, " ".join(w)))
    every = rows + more + [(400, "A\u00a0b \u00c9T\u00c9 c")]
    prints = {(i, t): brute_print(t) for i, t in every}
    distinct = set(prints.values())
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[p] = min(i, least.get(p, i))
    close = [(a, b) for a in distinct for b in distinct if a < b and bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 2]
    assert len(close) >= 3
    comp = unions(close, distinct)
    first = {}
    for p in distinct:
        first[comp[p]] = min(first.get(comp[p], 10 ** 9), least.get(p, 10 ** 9))
    got = simhash.near_duplicates(docs_of(spark, every)).collect()
    assert Counter((r.doc_id, r.bits, r.component_id) for r in got) == Counter(
        (i, prints[(i, t)], None if first[comp[prints[(i, t)]]] == 10 ** 9 else first[comp[prints[(i, t)]]]) for i, t in every)
    kept = simhash.keep_first(docs_of(spark, every))
    assert kept.columns == docs_of(spark, []).columns and kept.count() == len(first)
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_simhash_links_join_all_close_fingerprints(spark):
    rng = random.Random(3)
    points = set()
    for _ in range(15):
        p = rng.getrandbits(64)
        for _ in range(30):
            points.add(p)
            for _ in range(rng.randint(0, 3)):
                p ^= 1 << rng.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    close = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 2]
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "bits long")).collect()]
    assert set(map(tuple, map(sorted, got))) <= set(close)
    assert unions(got, signed) == unions(close, signed)


# 10 -----------------------------------------------------------------------------

def test_lm_scores(spark, rows):
    docs = docs_of(spark, [*rows, (2, "unknown words only")])
    learned = docs.filter(~mixing.held_out())
    got = mixing.score(docs, ~mixing.held_out()).collect()
    toks = lambda t: [*(t or "").encode().lower().split(), b""]
    train = Counter(w for r in learned.collect() for w in toks(r.text))
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t in [*rows, (2, "unknown words only")]:
        w = toks(t)
        base = sum(np.log10((train[x] + 1) / (n + v + 1)) for x in w)
        want[(i, len(w), sum(train[x] > 0 for x in w), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    empty = mixing.score(docs.limit(3), mixing.F.lit(False)).collect()
    assert len(empty) == 3 and all(r.train_tokens == r.n_known == 0 for r in empty)
    assert mixing.score(docs.limit(0), ~mixing.held_out()).count() == 0


def brute_scores(texts, train):
    """The model token by token, with contexts as words instead of hashes."""
    import xxhash
    toks = lambda t: [*(t or "").encode().lower().split(), b""]
    code_of = lambda w: xxhash.xxh64_intdigest(w, 42) & 255      # noqa: E731
    count, after, size = Counter(), defaultdict(Counter), Counter()
    pairs = lambda w: [((a,), (a, b)) for a, b in zip([None, *w], [None, None, *w], strict=False)][:len(w)]
    for t in train:
        w = toks(t)
        count.update(w)
        for x, ctx in zip(w, pairs(w), strict=True):
            for c in ctx:
                after[c][code_of(x)] += 1
    none = Counter()
    for w, k in count.items():
        size[code_of(w)] += k + 1
        none[code_of(w)] += k

    def split(codes, code, b):
        """Counts of the codes that share the first b bits: those with the next bit too, and all."""
        own = sum(k for c, k in codes.items() if c >> (7 - b) == code >> (7 - b))
        return own, sum(k for c, k in codes.items() if c >> (8 - b) == code >> (8 - b))

    out = []
    for t in texts:
        w = toks(t)
        weights, level = mixing.start_weights().astype(float), 1 / (1 + np.exp(-(np.arange(25) - 12) / 2))
        total, at, block = 0.0, 0, 1
        while at < len(w):
            grads, misses = defaultdict(lambda: [0, np.zeros(3)]), defaultdict(lambda: [0, 0.0])
            for j in range(at, min(at + block, len(w))):
                code = code_of(w[j])
                for b in range(8):
                    bit = code >> (7 - b) & 1
                    own, all_ = split(none, code, b)
                    x, classes = [np.log((own + 0.4) / (all_ - own + 0.4))], []
                    for c in pairs(w)[j]:
                        own, all_ = split(after.get(c, {}), code, b)
                        k = sum(all_ >= s for s in (1, 4, 20))
                        step, half = ((1, 0), (0.25, 9), (0.25, 16), (0.125, 101))[k]
                        x.append(step * np.clip(np.rint(np.log((own + 0.4) / (all_ - own + 0.4)) / step), -half, half))
                        classes.append(k)
                    gate, x = 4 * classes[0] + classes[1], np.array(x)
                    z = float(np.clip(weights[gate] @ x, -12, 12))
                    p = 1 / (1 + np.exp(-z))
                    place = int(np.rint(np.clip(2 * z * (1 if bit else -1), -12, 12))) + 12
                    total += np.log10(0.5 * (p + (level[place] if bit else 1 - level[place])))
                    grads[gate][0] += 1
                    grads[gate][1] += (1 - p) * x
                    misses[place][0] += 1
                    misses[place][1] += bit - level[place]
            for g, (n, s) in grads.items():
                weights[g] += mixing.RATE * s / (n + 64)
            for g, (n, s) in misses.items():
                level[g] += mixing.REFINE_RATE * s / (n + 64)
            at += block
            block = min(at, mixing.BLOCK)
        out.append(total + sum(np.log10(count[x] + 1) - np.log10(size[code_of(x)] + 1) for x in w))
    return out


def test_lm_scores_equal_the_model_token_by_token(spark, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (1, 2, 3, 5, 30, 63, 64, 65, 130, 260)] + [
        None, "", "only once the same", "only once the same", "unknown words here", " ".join(f"w{rng.random()}" for _ in range(90))]
    rows = [(i, t) for i, t in enumerate(texts)]
    learns = mixing.F.col("doc_id") % 3 != 1
    want = brute_scores(texts, [t for i, t in rows if i % 3 != 1])
    # one range and one slice, then several ranges and slices a task, then single texts
    for chars, span in ((10 ** 6, 10 ** 6), (500, 200), (1, 1000)):
        monkeypatch.setattr(mixing, "SLICE_CHARS", chars)
        monkeypatch.setattr(mixing, "RANGE_CHARS", span)
        got = {r.doc_id: r.score for r in mixing.score(docs_of(spark, rows).coalesce(2), learns, spare_bits=30).collect()}
        assert np.allclose([got[i] for i in range(len(texts))], want, atol=0.02, rtol=1e-4)


def test_context_counts_are_exact():
    """No count is lost between slices and ranges, and none is another context's."""
    rng = np.random.default_rng(3)
    cells = np.unique(rng.integers(0, 1 << 48, 300_000, dtype=np.uint64))
    counts = rng.integers(0, 50, len(cells)).astype(np.uint64)
    assert (np.cumsum(mixing.unpack(mixing.pack(mixing._gaps(cells)))) == cells).all()
    blocks = {"cells": [], "cell_n": [], "words": [], "word_n": []}
    own = [np.sort(rng.choice(len(cells), 200_000, replace=False)) for _ in range(3)]
    for o in own:
        for name in ("cell", "word"):
            blocks[f"{name}s"].append(mixing.pack(mixing._gaps(cells[o])))
            blocks[f"{name}_n"].append(mixing.pack(counts[o]))
    found, total, at = mixing._added(mixing.pa.table(blocks), "cell")
    held = Counter()
    for o in own:
        for k in o.tolist():
            held[int(cells[k])] += int(counts[k])
    assert dict(zip(found.tolist(), total.astype(int).tolist(), strict=True)) == dict(held)
    assert all((found[a] == cells[o]).all() for a, o in zip(at, own, strict=True))
    assert mixing.unpack(mixing.pack(np.zeros(0, np.uint64))).size == 0
    # dense and sparse contexts: states come back as they were
    cells = np.unique(rng.integers(0, 400, 20_000).astype(np.uint64) ** np.uint64(2) * np.uint64(256) + rng.integers(0, 256, 20_000).astype(np.uint64))
    cells = np.append(cells, np.arange(1 << 40, (1 << 40) + (999 << 8), 256, dtype=np.uint64))
    found = mixing.states(cells, rng.integers(0, 40, len(cells)))
    assert (mixing.unpack_states(mixing.pack_states(found, cells), cells) == found).all()
    assert mixing.unpack_states(mixing.pack_states(found[:0], cells[:0]), cells[:0]).shape == (0, 8)


def test_codes_are_a_distribution():
    """All codes of a text's last token together have the probability one, whatever came before."""
    rng = np.random.default_rng(0)
    before, codes = rng.integers(0, 256, 70), np.arange(256)
    none = mixing.order_nothing(rng.integers(0, 9, 256))
    trees = [mixing.states(np.arange(256, dtype=np.uint64), rng.integers(0, 30, 256) * (rng.random(256) < share)) for share in (0.9, 0.1)]
    code = np.concatenate([np.append(before, c) for c in codes])
    whole = mixing.code_texts(code, np.arange(256) * 71, np.full(256, 71), none, trees[0][code], trees[1][code])
    head = mixing.code_texts(before, np.array([0]), np.array([70]), none, trees[0][before], trees[1][before])
    assert np.isclose((10 ** (whole - head)).sum(), 1, atol=1e-4)


# pipeline -----------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline as P
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = P.store(stage(spark, docs, sf), "test")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    assert P.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_language_model_tasks_stay_small():
    """A range's answer and a slice's tokens hold few arrays of their length at once."""
    rng, peaks = np.random.default_rng(5), {}
    own = [np.unique(rng.integers(0, 1 << 34, 300_000).astype(np.uint64)) for _ in range(4)]
    blocks = mixing.pa.table({
        "range": [0] * 4, "slice": list(range(4)), "cells": [mixing.pack(mixing._gaps(o)) for o in own],
        "cell_n": [mixing.pack(np.ones(len(o), np.uint64)) for o in own],
        "words": [mixing.pack(mixing._gaps(o[:9])) for o in own], "word_n": [mixing.pack(np.ones(9, np.uint64))] * 4})
    texts = [" ".join(map(str, rng.integers(0, 500, 1000))).encode() for _ in range(200)]
    row = {"sizes": [len(t) for t in texts], "texts": mixing.pa.compress(b"".join(texts), codec="zstd", asbytes=True)}
    for name, work in (("range", lambda: mixing._answer(blocks)), ("slice", lambda: mixing._tokens(row))):
        tracemalloc.start()
        work()
        peaks[name] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peaks["range"] < 80 * sum(map(len, own)), peaks
    assert peaks["slice"] < 40 * 200 * 1001, peaks


def test_units_replace_only_ends_that_occur(spark):
    """Texts are searched for each end, and only those found are replaced; the units stay those of the pattern."""
    rows = [(k, t) for k, t in enumerate([
        None, "", "a", "\n", ". ", "a. ", "a, b; c: d! e? f\ng。h，i；j！k？l", "a.b ,c.  d\t\n \r\n", "x\u0001y. z, ", "e? " * 3])]
    made = linechunks.with_ends(linechunks._with_units(docs_of(spark, rows)).withColumn("units", linechunks.F.col("units_")))
    for r in made.collect():
        assert r.units == [u for u in re.split(linechunks.CUT, r.text or "") if u]
        assert r.plain_ == [u.rstrip(" \t\r\n") for u in r.units]
    long = spark.range(0, 100, 1, 1).select(linechunks.F.col("id").alias("doc_id"), linechunks.F.expr("concat(id, repeat('word ', 20000))").alias("text"))
    all_ends = linechunks.F.col("text")
    for end in linechunks.ENDS:
        all_ends = linechunks.F.replace(all_ends, linechunks.F.lit(end), linechunks.F.lit(end + linechunks.MARK))
    frames, took = (long.select(linechunks.F.length(all_ends)), linechunks._with_units(long).select(linechunks.F.size("units_"))), ([], [])
    for _ in range(4):
        for df, seconds in zip(frames, took, strict=True):
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
    assert min(took[1]) < 0.8 * min(took[0]), took
