"""Leaks against every item aligned with every whole document."""

import random
import re

import numpy as np

from pairgraph.llm import decontaminate as d

P = d.Decontamination()


def make(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 60
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [words(rng.choice([10, 20, 40])) for _ in range(12)] + [["one", "two"], [], None]
    docs = []
    for i in range(60):
        text = words(rng.choice([0, 5, 80, 300]))
        if i % 3 == 0:
            part = list(items[rng.randrange(12)])
            for _ in range(i % 4):
                part[rng.randrange(len(part))] = "edited"
            if i % 5 == 0:
                del part[len(part) // 2]
            text[len(text) // 2 : len(text) // 2] = part
        docs.append(" ".join(text).title() if i % 2 else ", ".join(text))
    docs += [None, "", docs[0], " ".join(words(30000) + items[3]), "zero\n One -- two!\nthree", "one two three", "one"]
    return items, docs


def coded(texts):
    """Each text's words as numbers, by plain Python."""
    number = {}
    return [np.array([number.setdefault(w, len(number)) for w in re.findall(r"[0-9a-z]+", (t or "").lower())], int) for t in texts]


def by_hand(items, docs):
    """{(doc, item): (score, end)} of every item aligned with every whole document."""
    out, codes = {}, coded(items + docs)
    for i, words in enumerate(codes[len(items) :]):
        for j, item in enumerate(codes[: len(items)]):
            if len(item) >= 3:
                score, _, end = d.align(item, words)
                if score >= min(len(item), P.enough, max(P.least, P.share * len(item))):
                    out[i, j] = score, end
            elif len(item):
                at = 0
                for line in (docs[i] or "").split("\n"):
                    own = re.findall(r"[0-9a-z]+", line.lower())
                    at += len(own)
                    if own == re.findall(r"[0-9a-z]+", items[j].lower()):
                        out[i, j] = len(own), at
    return out


def test_against_all_pairs(spark):
    items, docs = make()
    rows = [(j, " ".join(x) if x is not None else None, "extra") for j, x in enumerate(items)]
    bench = spark.createDataFrame(rows, "item_id long, text string, score string")
    table = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(docs)], "doc_id long, text string, item string, id int").repartition(3)
    got = {(r["doc_id"], r["item_id"]): r for r in d.find_leaks(table, bench).collect()}
    want = by_hand([" ".join(x or []) for x in items], docs)
    assert (len(docs) - 3, 12) in want and (len(docs) - 2, 12) not in want
    assert {k: (r["score"], r["end_word"]) for k, r in got.items()} == want
    assert len(want) > 15
    often = d.find_leaks(table, bench, params=d.Decontamination(rare=0.0, rare_rows=0)).collect()  # every n-gram is frequent
    assert {(r["doc_id"], r["item_id"]) for r in often} <= set(want) and len(often) > 0.9 * len(want)
    assert all(r["start_word"] < r["end_word"] for r in got.values())
    small = d.find_leaks(table, bench, params=d.Decontamination(block_words=30)).collect()  # in blocks
    assert sorted((r["doc_id"], r["item_id"], r["score"]) for r in small) == sorted((*k, r["score"]) for k, r in got.items())
    left = d.drop_leaks(table, bench)
    assert left.columns == table.columns
    assert {r["doc_id"] for r in left.collect()} == set(range(len(docs))) - {i for i, _ in want}


def test_alignment():
    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        assert d.align(np.array(a, int), np.array(b, int))[0] == plain(a, b)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    some = spark.createDataFrame([(None, "x a b c d e f g h i j y"), (1, "a b c d e f g h i j"), (1, "a b c d e f g h i j")], "doc_id long, text string")
    assert d.find_leaks(docs, bench).count() == 0
    assert d.find_leaks(some, bench.limit(0)).count() == 0
    assert sorted(str(r["doc_id"]) for r in d.find_leaks(some, bench).collect()) == ["1", "1", "None"]
    assert d.drop_leaks(some, bench).count() == d.drop_leaks(docs, bench).count() == 0
    assert d.drop_leaks(some, bench.limit(0)).count() == 3


def test_rows_go_and_not_ids(spark):
    leak = "x a b c d e f g h i j y"
    rows = [(None, leak, 1), (None, "clean", 2), (5, leak, 3), (5, "clean too", 4), (6, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item int")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert sorted(r["item"] for r in d.drop_leaks(docs, bench).collect()) == [2, 4, 5]


def test_seeds_are_rare_or_the_rarest_of_a_window():
    p = d.Decontamination(rare_rows=5, rare=0.0, window=3)
    block = d.Block([(1, "a b c d e f g h i j")], p)
    counts = dict(zip(block.codes[0].tolist(), [9, 8, 7, 6, 4, 0, 20, 0], strict=True))
    block.choose_seeds(np.array([counts[g] for g in block.grams.tolist()]), 1000)
    # under 5 is rare; of each three successive ones the rarest that occurs is a seed
    assert sorted(block.place_of.tolist()) == [2, 3, 4, 6]


def test_a_long_quote_of_a_longer_item_is_found(spark):
    item = " ".join(f"q{i}" for i in range(300))
    docs = spark.createDataFrame([(1, "x " + " ".join(item.split()[100:160])), (2, " ".join(item.split()[100:140]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r["doc_id"], r["score"]) for r in d.find_leaks(docs, bench).collect()] == [(1, 60)]


def test_heavily_edited_copies_against_all_pairs(spark):
    """Every fourth word replaced, beside whole copies that make other n-grams rarer; and random replacements."""
    rng = random.Random(5)
    items = [[f"i{j}w{k}" for k in range(24)] for j in range(12)]
    docs = []
    for j, item in enumerate(items):
        docs.append(" ".join(["x"] * 5 + [f"e{k}" if k % 4 == 3 else w for k, w in enumerate(item)]))
        if j % 2:
            docs.append(" ".join(item))
        docs += [" ".join(w if rng.random() > 0.2 else "edited" for w in item) for _ in range(5)]
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()}
    want = set(by_hand([" ".join(x) for x in items], docs))
    assert got == want and len(want) > 60
