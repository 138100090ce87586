"""Near-duplicates against all pairs compared by brute force."""

import random
import re

from pairgraph.llm import near_dup
from pairgraph.operators.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    if 0 < len(w) < k:
        return {tuple(w)}
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def by_hand(rows, k, percent=80):
    """{row number: (size, component)}"""
    sets = [shingles(t, k) for _, t in rows]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)]


def check(spark, rows, k=4, **params):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, id string").repartition(5)
    out = near_dup.near_duplicates(docs, params=near_dup.NearDup(words=k, **params)).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)
    assert got == sorted(by_hand(rows, k), key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    left = near_dup.drop_near_duplicates(docs, params=near_dup.NearDup(words=k, **params))
    assert left.columns == docs.columns
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left.collect()) == sorted({(str(i), str(t)) for i, t in rows if i in kept})


def corpus(seed, passage=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(passage)]
    rows, n = [], 0
    for g in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([3, 30, 80, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            t = list(text)
            for _ in range(rng.choice([0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                t = t[: len(t) // 2] + shared + t[len(t) // 2 :]
            rows.append((n * 7 % 1009, " ".join(t).title() if rng.random() < 0.3 else "\n".join(t)))
            n += 1
    return rows


def test_against_all_pairs(spark):
    check(spark, corpus(1))


def test_five_words_and_a_passage_that_most_share(spark):
    check(spark, corpus(2, 150), k=5)


def test_exact_stage_finds_what_few_tables_miss(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(100)]
    rows = []
    for i in range(40):
        t = list(base)
        for _ in range(rng.choice([1, 3, 5])):
            t[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(t)))
    check(spark, rows, collection=2, band=2)


def test_edge_cases(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "a b"), (9, "A  B"), (10, "a b c"), (None, "a b"), (3, "a b c d"), (3, "q r s t"), (2, "Q r s t"), (5, None), (8, "a b"), (None, "a b"), (None, "c"), (6, "")]
    rows += [(12, " ".join(f"w{i}" for i in range(20000))), (11, " ".join(f"w{i}" for i in range(20001)))]
    check(spark, rows)
    check(spark, [])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(500, 500), (None, 3), (601, 600), (600, 601)]
    out = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    want = {i: 100 for i in range(100, 161)} | dict.fromkeys(range(50), 0) | {600: 600, 601: 600}
    assert out == want
