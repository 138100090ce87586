"""The pipeline against its stages in plain Python, on documents with planted cases."""

import random
import re

import test_decontaminate
import test_near_dup
from test_native import TEXTS, base_of, spans_by_hand, targets_by_hand

from pyspark.sql import functions as F

import corpus_pipeline
from pairgraph.llm import quality_rules


def planted(seed=8):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ala", "ome", "uti", "ent", "of", "ar")] + ["the", "and"] * 5
    text = lambda n: " ".join(rng.choice(vocab) + str(rng.randrange(30)) for _ in range(n))
    items = [text(20) for _ in range(6)]
    docs = []
    for i in range(80):
        t = text(rng.choice([20, 70, 120, 200]))
        if i % 10 == 0:
            t += " " + items[i % 6] + " " + text(40)
        if i % 9 == 0:
            t += "\ntoken = abcdef0123456789abcdef0123456789 end"
        if i % 8 == 0:
            t = re.sub(" ", "### $$ ", t)
        docs.append(t)
        if i % 4 == 0:
            words = t.split(" ")
            words[len(words) // 2] = "changed"
            docs.append(" ".join(words))
    return items, docs + TEXTS


def quality(rows):
    """Votes by hand of the rules, then the model that EM finds."""
    voted = []
    for r in rows:
        n, chars, symbols, dup, repeat = base_of(r[1])
        t = r[1] or ""
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
        capitals = len(re.findall("[A-Z]", t))
        vote = lambda good, bad: -1 if bad else 1 if good else 0
        votes = (
            vote(n >= 80, n < 50),
            vote(symbols * 50 <= n, symbols * 10 > n),
            vote(symbols * 200 <= chars, symbols * 25 > chars),
            vote(False, chars < 2 * n or chars > 12 * n),
            vote(False, dup * 10 > 3 * lines),
            vote(False, repeat * 10 > 3 * n),
            vote(False, capitals * 10 > 3 * chars),
        )
        voted.append((r, votes, n < 50 or 100 * repeat > 50 * n))
    counts = {}
    for _, v, _ in voted:
        counts[v] = counts.get(v, 0) + 1
    model = quality_rules.fit_rules(sorted(counts.items()))
    return [r for r, v, failed in voted if not failed and model.posterior(v) >= 0.5]


def test_against_plain_python(spark, tmp_path):
    items, texts = planted()
    rows = [(i, t, "en", "abc"[i % 3] if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))

    left = quality(rows)
    assert 20 < len(left) < len(rows)
    comp = {i: c for i, _, c in test_near_dup.by_hand([r[:2] for r in left], 5)}
    one = [r for r in left if comp[r[0]] == r[0]]
    assert len(one) < len(left)
    leaks = {i for i, _ in test_decontaminate.by_hand(items, [r[1] for r in one])}
    clean = [r for i, r in enumerate(one) if i not in leaks]
    assert len(clean) < len(one)
    want = {}
    for i, t, *_ in clean:
        spans, out, at = spans_by_hand(t), "", 0
        for a, _, _, b in spans:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        want[i] = out + t[at:]
    assert any("[SECRET]" in t for t in want.values())
    sizes = {}
    for r in clean:
        sizes[r[3]] = sizes.get(r[3], 0) + len(want[r[0]].split())
    targets = targets_by_hand(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got.collect():
        assert r["text"] == want[r["doc_id"]] and r["size"] == len(r["text"].split()) and r["lang"] == "en"
        assert 0 < r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert corpus_pipeline.source_mix(spark, docs, str(tmp_path)).count() == 0


def test_nulls_repeats_and_clashing_names_through_all_stages(spark, tmp_path):
    items, texts = planted()
    good = [t for t in texts if len((t or "").split()) > 60][:20]
    rows = [(None if i % 6 == 0 else i, t, "s" if i % 4 else None) for i, t in enumerate(good)]
    rows += [rows[1], rows[1], rows[0], rows[0], (None, None, None), (3, "other " + good[5], "s")]
    extra = ["size", "taken", "epochs", "row", "key", "f", "votes", "pattern", "spans", "hits", "clean", "count", "base_failed", "bucket", "id", "item"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    spark.createDataFrame([(1, items[0]), (2, None), (3, ""), (None, "two words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, str(tmp_path))
        assert docs.columns == columns and 0 < docs.count() <= before, name
    assert docs.groupBy("doc_id", "text").count().where("count > 1").isEmpty()
    assert {tuple(r)[3:] for r in docs.collect()} == {tuple(range(len(extra)))}
    out = corpus_pipeline.source_mix(spark, docs, str(tmp_path))
    assert {r["size_in"] for r in out.collect()} == {0} and all(r["size"] == len(r["text"].split()) for r in out.collect())
