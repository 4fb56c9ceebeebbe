import random

from runledger.llm import editcount as E
from runledger.llm.tokens import WordIds, vocabulary_path

WORDS = WordIds(vocabulary_path())


def count(text):
    return len(WORDS.tokenizer.encode(text, add_special_tokens=False).ids)


def test_units_and_ids_equal_whole_encoding():
    for text in ["", " ", "a", "Hello, world.\nIt's 12 o'clock…", "  two  spaces\t\ttab\n\nline ", "é ñ x\r\ny 'll", "\n\n", " x"]:
        whole = WORDS._whole(text)
        assert WORDS.encode([text])[0] == whole
        chars, tokens = WORDS.units([text])[0]
        assert sum(chars) == len(text) and sum(tokens) == len(whole) // 4


def test_random_edits_equal_brute_force():
    rng = random.Random(3)
    alphabet = ["a", "the", "I'll", "don't", " ", "  ", "\n", ".", ",", "12", "é", "<|endoftext|>", "\t", " ", "word", "x" * 50]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) + rng.choice(["", " ", "\n"]) for _ in range(rng.choice([0, 1, 3, 60, 600])))
        edits = [{"start": rng.randint(-2, len(text) + 3), "length": rng.choice([0, 0, 1, 5, 300]),
                  "insert": "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 40, 900])))} for _ in range(rng.randint(0, 5))]
        hold = E.accepted(edits, len(text))
        tree, work = E.apply(WORDS, text, E.plant(*WORDS.units([text])[0]), hold)
        new = E.edited(text, hold)
        assert tree.sums[:, 1].tolist() == [len(new), count(new)]
        again = E.edited(new, [(0, 1, "zz ")])
        tree, _ = E.apply(WORDS, new, tree, [(0, min(1, len(new)), "zz ")])
        assert tree.sums[1, 1] == count(again if new else "zz ")


def test_only_the_touched_leaves_are_encoded():
    text = " ".join(["word"] * 20_000)
    _, work = E.apply(WORDS, text, E.plant(*WORDS.units([text])[0]), [(50_000, 50_004, "other")])
    assert work < 1_000


def test_recount_table(spark):
    docs = spark.createDataFrame(
        [(1, "one two three", "x"), (2, None, "y"), (2, None, "y"), (3, "", "z"), (None, "no id", "n"), (4, "kept as is", "k")],
        "doc_id long, text string, edits string")
    edits = spark.createDataFrame(
        [(1, 0, 3, "uno"), (1, 0, 3, "uno"), (1, 2, 3, "over"), (1, 99, 0, " end"), (2, 0, 0, "new"), (3, 0, 5, None),
         (9, 0, 0, "nobody"), (None, 0, 0, "x"), (4, None, 1, "x")], "doc_id long, start long, length long, insert string")
    got = {(r.doc_id, r.n_chars): r for r in E.recount(docs, E.build(docs), edits).drop("chars", "tokens").collect()}
    assert got[(1, 17)].n_tokens == count("uno two three end") and got[(1, 17)].edits == 2 and got[(1, 17)].rejected == 1
    assert got[(2, 3)].n_tokens == count("new") and got[(3, 0)].n_tokens == 0
    assert got[(None, 5)].n_tokens == got[(None, 5)].tokens_before == count("no id") and got[(4, 10)].edits == 0
    assert E.recount(docs.limit(0), E.build(docs.limit(0)), edits).count() == 0
    assert E.recount(docs, E.build(docs), edits.limit(0)).count() == docs.count()
