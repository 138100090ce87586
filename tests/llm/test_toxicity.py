"""Toxicity on texts with planted words: held-out accuracy, and features against plain Python."""

import random
import zlib

import numpy as np

from pairgraph.llm import toxicity as t

SMALL = t.Toxicity(bits=16)


def make(n=600):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["grubnard", "snotwick"]))
        rows.append((i, " ".join(words), "src", 3))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = make()
    rows += [(600, None, None, 1), (601, "", None, 1), (602, "x" * 300000 + " grubnard snotwick grubnard", None, 1), (None, "a grubnard", None, 1), (0, rows[0][1], None, 1)]
    labels += [(600, None, None), (601, 1, 0), (9999, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score int").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = t.score_toxicity(docs, table, params=SMALL).collect()
    assert len(out) == len(rows)
    for r in out:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    known = {i: y for i, _, y in labels if i is not None and i < 600}
    held = [r for r in out if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 100
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) > 0.97
    again = t.score_toxicity(docs.repartition(5), table, params=SMALL).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_held_out_labels_are_never_read(spark):
    rows, labels = make(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels]
    a, b = (t.score_toxicity(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int"), params=SMALL).collect() for x in (labels, turned))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_features_do_not_depend_on_blocks():
    texts = ["Some text, é𝄞 " * 40, None, "", "abc", "a" * 5000, "xy", "Some text"]
    owner, code = t.features_of(texts, SMALL)
    for block in (7, 64, 10**6):
        assert all(np.array_equal(a, b) for a, b in zip(t.features_of(texts, SMALL, block=block), (owner, code), strict=True))
    for i, text in enumerate(texts):
        mine = code[owner == i]
        assert np.array_equal(t.features_of([text], SMALL)[1], mine)  # whatever stands beside it
        low = (text or "").lower()
        grams = {low[k : k + n] for n in SMALL.sizes for k in range(len(low) - n + 1)}
        assert len(mine) <= len(grams) and len(mine) >= 0.95 * len(grams)
    keep = np.zeros(1 << SMALL.bits, bool)
    keep[code[::3]] = True
    some = t.features_of(texts, SMALL, keep)
    assert np.array_equal(some[0], owner[keep[code]]) and np.array_equal(some[1], code[keep[code]])


def test_fit_against_newton_steps():
    """The same loss, written densely and brought to its least by Newton's method."""
    rng = np.random.default_rng(4)
    n, k = 120, 15
    y = (rng.random(n) < 0.3).astype(int)
    x = (rng.random((n, k)) < np.where(y[:, None] == 1, np.linspace(0.1, 0.6, k), 0.3)).astype(float)
    p = t.Toxicity(penalty=0.01)
    weights, bias = t.fit(*np.nonzero(x), y, k, p)
    toxic = y.sum()
    ratio = np.log(((x[y == 1].sum(0) + 1) / (toxic + 2)) / ((x[y == 0].sum(0) + 1) / (n - toxic + 2)))
    a = np.c_[x * ratio, np.ones(n)]
    weigh, ridge = np.where(y == 1, 0.5 / toxic, 0.5 / (n - toxic)), np.diag([0.01] * k + [0.0])
    w = np.zeros(k + 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (weigh * q * (1 - q))[:, None]) + ridge, a.T @ (weigh * (q - y)) + ridge @ w)
    assert np.allclose(np.append(weights, bias), np.append(w[:-1] * ratio, w[-1]), atol=1e-4)


def test_chosen_features_lie_off_chance(spark):
    counts = spark.createDataFrame([(0, 100, 10), (1, 100, 40), (2, 2, 2), (3, 50, 5), (4, 400, 4)], "feature int, n long, toxic long")
    assert [r[0] for r in counts.where(t.off_chance(1000, 100, t.Toxicity())).collect()] == [1, 4]  # (40 - 10) / 3 and (4 - 40) / 6 deviations
    assert counts.where(t.off_chance(1000, 0, t.Toxicity())).count() == counts.where("n >= 3").count()  # one class: whatever


def test_long_labelled_texts_count(spark):
    """Labelled texts of any length are learned from."""
    filler = " ".join(f"w{i}" for i in range(6000))
    docs = spark.createDataFrame([(i, filler + (" grubnard snotwick" if i % 2 else ""), "s", 1) for i in range(60)], "doc_id long, text string, source string, score int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    out = t.score_toxicity(docs, labels, params=SMALL).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in out)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "text", "s", 1)], "doc_id long, text string, source string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in t.score_toxicity(docs, none, params=SMALL).collect()] == [0.5]
    assert t.score_toxicity(docs.limit(0), none, params=SMALL).count() == 0
