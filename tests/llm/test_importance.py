"""Importance resampling against sums over dictionaries and a sort."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from pairgraph.llm import importance as im

P = im.Importance(buckets=1000, share=0.6)
M = 2**64


def mixed(x):
    x %= M
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD % M
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 % M
    return x ^ x >> 33


def hashed(words):
    """A run of words as a number, word by word and byte by byte."""
    total = len(words)
    for j, w in enumerate(words):
        own = sum((b + 1) * pow(0x9E3779B97F4A7C15 | 1, k, M) for k, b in enumerate(w.encode()))
        total += mixed(own + len(w.encode()) * 0xA0761D6478BD642F) * (mixed((j + 1) * 0xD1B54A32D192ED03 + 11) | 1)
    return mixed(total)


def bag_of(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return Counter(hashed(x) % n for x in [[w] for w in words] + [list(x) for x in zip(words, words[1:], strict=False)])


def make():
    rng = random.Random(11)
    good, bad = [f"good{i}" for i in range(80)], [f"bad{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choice(bad if i % 5 == 0 else good) for _ in range(rng.randrange(5, 60))), 0.5) for i in range(200)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 200, 2)]
    return rows + [(300, None, 0.1), (301, "", 0.1), (None, rows[0][1], 0.1), (3, rows[3][1], 0.1)], labels + [(None, 1, 0), (777, 1, 0), (301, None, 0)]


def test_against_dictionaries(spark):
    rows, labels = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string, u double").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = im.resample(docs, table, params=P).collect()
    target = {i for i, q, _ in labels if q == 1 and i is not None}
    raw, wanted = Counter(), Counter()
    bags = []
    for i, text, _ in rows:
        bag = bag_of(text, P.buckets)
        bags.append(bag)
        raw += bag
        if i in target:
            wanted += bag
    total_a, total_b = sum(wanted.values()) + 1000, sum(raw.values()) + 1000
    want = []
    for (i, _, _), bag in zip(rows, bags, strict=True):
        weight = sum(n * (math.log((wanted[b] + 1) / total_a) - math.log((raw[b] + 1) / total_b)) for b, n in bag.items())
        digest = hashlib.md5(f"gumbel:{'null' if i is None else i}".encode()).hexdigest()
        u = (int(digest[:13], 16) + 0.5) / 2**52
        want.append((str(i), weight, weight - math.log(-math.log(u))))
    want.sort(key=lambda x: -x[2])
    edge = want[round(0.6 * len(rows)) - 1][2]
    assert sum(r["kept"] for r in got) == round(0.6 * len(rows))
    mine = sorted(((str(r["doc_id"]), r["log_weight"], r["sample_key"]) for r in got), key=lambda x: -x[2])
    for a, b in zip(mine, want, strict=True):
        assert a[1] == pytest.approx(b[1], abs=1e-6) and a[2] == pytest.approx(b[2], abs=1e-6)
    assert all(r["kept"] == (r["sample_key"] >= edge - 1e-9) for r in got)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert sum(i % 5 == 0 for i in kept if i is not None and i < 200) < 5
    again = im.resample(docs.repartition(5), table, params=P).collect()
    assert sorted((str(r["doc_id"]), r["kept"]) for r in again) == sorted((str(r["doc_id"]), r["kept"]) for r in got)


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.getrandbits(63) - 2**62, rng.randrange(-5, 5)]) for _ in range(300)]
    keys = spark.createDataFrame([(v,) for v in values], "order_key long")
    values.sort(reverse=True)
    for k in (1, 7, 150, 299, 300):
        edge, n = im.kth_largest(keys, k)
        assert edge == values[k - 1] and n == k - sum(v > edge for v in values)
    assert im.kth_largest(keys, 0) == (None, 0)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = im.resample(docs, none).collect()
    assert [r["kept"] for r in out] == [True, True] and {r["log_weight"] for r in out} == {0.0}
    assert im.resample(docs.limit(0), none).count() == 0
    assert not any(r["kept"] for r in im.resample(docs, none, params=im.Importance(share=0.0)).collect())


def test_ties_at_the_edge(spark):
    """A repeated row that lies at the edge is sampled as often as there is room; a text of any length is weighed."""
    docs = spark.createDataFrame([(1, "a b", "x")] * 200 + [(i, f"w{i}", "y") for i in range(2, 50)] + [(50, "a b " * 100_000, "z")], "doc_id long, text string, part string").repartition(6)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for share in (0.1, 0.5, 0.83, 1.0):
        out = im.resample(docs, labels, params=im.Importance(share=share)).collect()
        k = round(share * 249)
        assert sum(r["kept"] for r in out) == k
        low = min(r["sample_key"] for r in out if r["kept"])
        assert all(r["kept"] for r in out if r["sample_key"] > low) and not any(r["kept"] for r in out if r["sample_key"] < low)


def test_the_bitmap_loses_no_row(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id as string) AS text").union(spark.createDataFrame([(None, "x"), (3, "again")], "id long, text string"))
    ids = spark.range(0, 6000, 3)
    assert sorted(r["id"] for r in im.rows_with(rows, ids).collect()) == sorted([*range(0, 5000, 3), 3])
