"""The engine's operators on worked values and against plain models."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pairgraph import queries
from pairgraph.functions import vectors as vx
from pairgraph.operators import audit, candidates, decisions, evidence, grouping, partitions
from pairgraph.plans import config, registry, sweep
from pairgraph.sources import sinks, tables


def partition(spark, groups):
    rows = [(n, str(i)) for i, g in enumerate(groups) for n in g]
    return spark.createDataFrame(rows, "filename string, group_id string")


ROOMS = [["lr_dark", "lr_mid", "lr_bright"], ["kw_dark", "kw_bright"], ["kc"], ["mb_dark", "mb_mid", "mb_bright"], ["mw_dark", "mw_bright"], ["ba_dark", "ba_bright"], ["yard"], ["ex_day", "ex_dusk"]]


@pytest.mark.parametrize(
    ("predicted", "exact", "score", "splits", "merged"),
    [
        ([g[::-1] for g in ROOMS[::-1]], 8, 1.0, 0, 0),
        ([[n] for g in ROOMS for n in g], 2, 0.25, 6, 0),
        ([ROOMS[0], ROOMS[1] + ROOMS[2], *ROOMS[3:]], 6, 0.75, 0, 2),
        ([["lr_dark", "lr_mid"], ["lr_bright"], *ROOMS[1:]], 7, 0.875, 1, 0),
    ],
)
def test_scores(spark, predicted, exact, score, splits, merged):
    r = partitions.score(partition(spark, ROOMS), partition(spark, predicted)).first()
    assert (r["exact_matches"], r["exact_group_score"], r["split_reference_groups"], r["merge_damaged_reference_groups"]) == (exact, score, splits, merged)
    assert r["total_reference_groups"] == 8 and r["predicted_groups"] == len(predicted)
    bad = partitions.diagnose(partition(spark, ROOMS), partition(spark, predicted)).collect()
    assert len(bad) == 8 - exact
    if merged:
        assert {tuple(r["failure_types"]) for r in bad} == {("merge",)}


def test_empty_scores(spark):
    r = partitions.score(partition(spark, []), partition(spark, [])).first()
    assert r["exact_group_score"] == r["predicted_exact_group_precision"] == 1.0


def test_validation_and_canonical_order(spark):
    p = partition(spark, [["c", "b"], ["a", "d"]])
    assert {r["filename"]: r["group_no"] for r in partitions.canonical(p).collect()} == {"a": 0, "d": 0, "b": 1, "c": 1}
    names = p.select("filename")
    partitions.validate(p, names)
    bad = p.unionByName(spark.createDataFrame([("a", "9"), ("x/y", "")], "filename string, group_id string"))
    found = {(r["problem"], r["filename"]) for r in partitions.violations(bad, names.unionByName(spark.createDataFrame([("z",)], "filename string"))).collect()}
    assert found == {("duplicate", "a"), ("missing", "z"), ("unexpected", "x/y"), ("empty_group", "x/y"), ("bad_name", "x/y")}
    with pytest.raises(ValueError, match="missing"):
        partitions.validate(p, names.unionByName(spark.createDataFrame([("z",)], "filename string")))


def vectors(spark, named):
    return spark.createDataFrame(list(named.items()), "filename string, descriptor array<double>")


def test_top_k_and_ties(spark):
    v = {"a": [1.0, 0.0], "b": [0.995, 0.0998], "c": [-1.0, 0.0], "d": [-0.995, 0.0998]}
    pairs = lambda c: sorted((r["left"], r["right"]) for r in c.pairs.collect())
    c = candidates.screen_candidates(vectors(spark, v), candidates.Screen(2, 1))
    assert pairs(c) == [("a", "b"), ("c", "d")] and c.total_pairs == 6
    same = vectors(spark, dict.fromkeys("abcd", [0.6, 0.8]))
    c = candidates.screen_candidates(same, candidates.Screen(2, 1))
    assert len(pairs(c)) == 6 and c.counters().first()["candidate_pair_fraction"] == 1.0
    some = spark.createDataFrame([("a", None), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "filename string, descriptor array<double>")
    c = candidates.screen_candidates(some, candidates.Screen(2, 1))
    assert pairs(c) == [("b", "c")] and [r[0] for r in c.fallback.collect()] == ["a"]
    assert len(pairs(candidates.screen_candidates(some, candidates.Screen(3, 1)))) == 3
    for bad in ({"all_pairs_max": 1}, {"top_k": 0}, {"top_k": True}):
        with pytest.raises(ValueError):
            candidates.Screen(**bad)


def test_top_k_in_blocks_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = np.round(rng.normal(size=(90, 4)), 1)
    m[:5] = 0
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    named = {f"n{i:02d}": m[i].tolist() for i in range(90)}
    names = list(named)
    d = candidates.distances(m, m)
    np.fill_diagonal(d, np.inf)
    want = set()
    for i in range(90):
        edge = np.sort(d[i])[3]
        want |= {tuple(sorted((names[i], names[j]))) for j in np.flatnonzero(d[i] <= edge)}
    df = vectors(spark, named).repartition(5)
    for size in (700, 1 << 20):
        got = candidates.unordered(candidates.top_k_neighbours(df, 4, size))
        assert {(r["left"], r["right"]) for r in got.collect()} == want
        near = candidates.pairs_within(df, 0.05, size).collect()
        assert {(r["left"], r["right"]) for r in near} == {(names[i], names[j]) for i in range(90) for j in range(i + 1, 90) if d[i, j] <= 0.05}


def test_pair_checks_and_orientation(spark):
    names = spark.createDataFrame([("a",), ("b",)], "filename string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "z")], "left string, right string")
    assert {r["problem"] for r in candidates.check_pairs(pairs, names).collect()} == {"self_pair", "unknown_name", "repeated_pair"}
    t = spark.createDataFrame([("a", "b", "2", "1"), ("a", "b", "1", "1")], "left string, right string, left_hash string, right_hash string")
    assert sorted((r["left"], r["right"]) for r in candidates.orient(t).collect()) == [("a", "b"), ("b", "a")]


EVIDENCE = dict(
    left="a", right="b", left_keypoints=200, right_keypoints=180, forward_ratio_matches=40, reverse_ratio_matches=38, mutual_matches=32, model_found=True, inliers=24, inlier_ratio=0.75,
    median_transfer_error=1.0, grid_coverage_left=0.25, grid_coverage_right=0.25, coverage_min=0.25, scale=1.0, rotation_degrees=0.5, translation_fraction=0.02, structural_correlation=0.8,
)
TYPES = "left string, right string, left_keypoints int, right_keypoints int, forward_ratio_matches int, reverse_ratio_matches int, mutual_matches int, model_found boolean, inliers int, inlier_ratio double, median_transfer_error double, grid_coverage_left double, grid_coverage_right double, coverage_min double, scale double, rotation_degrees double, translation_fraction double, structural_correlation double"


def test_states(spark):
    none = dict(model_found=False, inliers=0, inlier_ratio=0.0, median_transfer_error=None, coverage_min=0.0, scale=None, rotation_degrees=None, translation_fraction=None, structural_correlation=None)
    rows = [EVIDENCE, EVIDENCE | none, EVIDENCE | none | dict(left_keypoints=4, right_keypoints=5, mutual_matches=0), EVIDENCE | dict(inliers=12, structural_correlation=0.1)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], TYPES)
    out = decisions.classify(df, config.StateConfig()).collect()
    assert [r["state"] for r in out] == ["strong_positive", "negative", "unknown", "positive"]
    assert out[0]["score"] == pytest.approx((1 + 1 + 1 + 0.9 + 0.75) / 5) and out[1]["score"] == 0.0
    assert out[1]["reasons"] == ["informative_geometric_contradiction"]


def test_fusion(spark):
    rows = [("1", "a", "b", "unknown", 0.2), ("2", "b", "a", "strong_positive", 0.8), ("3", "a", "b", "positive", 0.9)]
    rows += [("1", "c", "d", "strong_positive", 0.8), ("2", "c", "d", "negative", 0.1), ("3", "c", "d", "unknown", 0.3)]
    df = spark.createDataFrame([(*r, ["why"]) for r in rows], "view string, left string, right string, state string, score double, reasons array<string>")
    decisions.check_views(df, ["1", "2", "3"])
    out = {r["left"]: r for r in decisions.fuse(df).collect()}
    assert (out["a"]["state"], out["a"]["score"]) == ("strong_positive", 0.8)
    assert (out["c"]["state"], out["c"]["score"], out["c"]["reasons"]) == ("negative", 0.1, ["dual_view_negative_veto", "why"])
    with pytest.raises(ValueError):
        decisions.check_views(df.where("NOT (view = '3' AND left = 'c')"), ["1", "2", "3"])
    with pytest.raises(ValueError):
        decisions.check_views(df, ["1"])


def model_groups(names, decided, c):
    """The rule in its plainest form, over all names at once."""
    clusters = {n: {n} for n in sorted(names)}
    of = lambda n: next(k for k, v in clusters.items() if n in v)
    order = sorted((d for d in decided if d[2] in decisions.POSITIVE), key=lambda d: (d[2] != "strong_positive", -d[3], d[0], d[1]))
    again = True
    while again:
        again = False
        for left, right, *_ in order:
            i, j = sorted((of(left), of(right)))
            if i == j:
                continue
            a, b = clusters[i], clusters[j]
            cross = [(x, y, s) if x in a else (y, x, s) for x, y, s, _ in decided if (x in a and y in b) or (x in b and y in a)]
            good = [(x, y) for x, y, s in cross if s in decisions.POSITIVE]
            strong = [(x, y) for x, y, s in cross if s == "strong_positive"]
            ok = bool(strong) and not (c.strong_negative_veto and any(s == "negative" for *_, s in cross))
            if ok and len(a) > 1 and len(b) > 1:
                heads = {min(a), min(b)}
                ok = c.representative_strong_support and any(x in heads or y in heads for x, y in strong)
                ok = ok or len(good) >= c.min_independent_support_edges and len({x for x, _ in good}) > 1 and len({y for _, y in good}) > 1
            if ok:
                clusters[i] = a | clusters.pop(j)
                again = True
    return {frozenset(v) for v in clusters.values()}


def test_grouping_against_the_model(spark):
    rng = random.Random(3)
    for n in range(400):
        names = [f"n{i}" for i in range(rng.randrange(2, 9))]
        decided = [(a, b, rng.choice(["strong_positive", "positive", "negative", "unknown"]), rng.randrange(5) / 4) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.7]
        c = config.GroupingConfig(rng.choice([2, 3]), rng.random() < 0.5, rng.random() < 0.5)
        want = model_groups(names, decided, c)
        found = {}
        for name, head in grouping.settle(names, decided, dict.fromkeys(names, 0.0), c).items():
            found.setdefault(head, set()).add(name)
        assert {frozenset(v) for v in found.values()} == want
        if n < 3 and decided:
            df = spark.createDataFrame(decided, "left string, right string, state string, score double")
            out = grouping.constrained_groups(spark.createDataFrame([(x,) for x in names], "filename string"), df, c)
            got = {}
            for r in out.collect():
                got.setdefault(r["group_id"], set()).add(r["filename"])
            assert {frozenset(v) for v in got.values()} == want


def test_chain_and_veto(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "filename string")
    for state, want in (("unknown", 1), ("negative", 2)):
        d = spark.createDataFrame([("a", "b", "strong_positive", 0.9), ("b", "c", "strong_positive", 0.8), ("a", "c", state, 0.1)], "left string, right string, state string, score double")
        assert grouping.constrained_groups(names, d).select("group_id").distinct().count() == want


def test_pair_diagnostics(spark):
    ref = partition(spark, [["a", "b"], ["c"]])
    d = spark.createDataFrame([("a", "b", "strong_positive", 0.95), ("a", "c", "positive", 0.75), ("b", "c", "unknown", 0.1)], "left string, right string, state string, score double")
    partitions.check_decisions(d, ref)
    r = partitions.pair_diagnostics(d, ref).first()
    assert (r["pair_count"], r["same_group_pair_count"], r["different_group_pair_count"]) == (3, 1, 2)
    assert (r["positive_pair_precision"], r["same_group_positive_recall"], r["known_state_coverage"]) == (0.5, 1.0, 2 / 3)
    ref = partition(spark, [["a", "b", "c"], ["d"]])
    d = spark.createDataFrame([("a", "b", "unknown", 0.0), ("b", "c", "unknown", 0.0)], "left string, right string, state string, score double")
    r = partitions.pair_diagnostics(d, ref).first()
    assert (r["candidate_pair_fraction"], r["candidate_same_group_pair_recall"]) == (2 / 6, 2 / 3)
    assert tuple(partitions.connectivity(d, ref).first()) == (2, 2)
    with pytest.raises(ValueError):
        partitions.check_decisions(d, ref)


def test_fold_aggregation_and_ranking(spark):
    run = lambda c, score, exact, total, splits, merges, wall: (c, exact, total, score, exact, total, merges, splits, wall, 10)
    cols = "candidate_id string, exact_matches long, total_reference_groups long, exact_group_score double, non_singleton_exact_matches long, non_singleton_reference_groups long, merge_damaged_reference_groups long, split_reference_groups long, wall_seconds double, peak_rss_bytes long"
    rows = [run("x", 1.0, 2, 2, 0, 0, 2.0), run("x", 0.5, 2, 4, 2, 0, 3.0), run("merge", 1.0, 6, 6, 0, 1, 1.0)]
    out = sweep.aggregate_runs(spark.createDataFrame(rows, cols))
    r = out.where("candidate_id = 'x'").first()
    assert (r["micro_exact_group_score"], r["mean_fold_exact_group_score"], r["worst_fold_exact_group_score"]) == (4 / 6, 0.75, 0.5)
    assert (r["split_reference_groups"], r["total_wall_seconds"], r["feature_cache_hits"]) == (2, 5.0, 0)
    assert [r["candidate_id"] for r in sweep.rank_candidates(out).orderBy("place").collect()] == ["x", "merge"]


def test_splits_and_folds(spark):
    m = partition(spark, [[f"g{i}_{j}" for j in range(i % 5 + 1)] for i in range(40)])
    assert sweep.select_split(m, {"type": "group_ids", "group_ids": ["1", "3"]}).count() == 6
    for bad in ({"type": "group_ids", "group_ids": ["99"]}, {"type": "group_ids", "group_ids": []}, {"type": "x"}):
        with pytest.raises(ValueError):
            sweep.select_split(m, bad)
    folds = sweep.assign_folds(m, "tag", capacity=30).collect()
    load = {}
    for r in folds:
        load[r["fold"]] = load.get(r["fold"], 0) + r["size"]
    assert len(folds) == 40 and all(v <= 30 for k, v in load.items() if k)
    assert sum(r["size"] for r in sweep.holdout(m, "tag", 50).collect()) <= 50


def test_audit(spark):
    files = spark.createDataFrame([("a", "h1", "p1"), ("b", "h2", "p2")], "filename string, content_hash string, perceptual_hash string")
    left = files.join(partition(spark, [["a", "b"]]), "filename")
    right = spark.createDataFrame([("a", "h1", "p1", "x"), ("b", "h3", "p3", "y"), ("c", "h2", "p2", "y")], "filename string, content_hash string, perceptual_hash string, group_id string")
    out = audit.compare_audits(left, right)
    assert {(r["filename"], r["changed"]) for r in out["names"].collect()} == {("a", False), ("b", True)}
    assert out["content"].count() == 2 and out["perceptual"].count() == 2
    assert tuple(out["relations"].first()) == (1, 1)
    assert audit.label_leak(partition(spark, [["g0_a", "b"]])).first()["fraction"] == 0.5


def test_registry(spark, tmp_path):
    reg = registry.RunRegistry(spark, str(tmp_path / "runs"))
    first = dict(run_id="r1", started_at="2024-01-01T00:00:00", git_commit="c", dirty_tree=False, config_path="p", config_hash="h", dataset_fingerprint="d", split_id="s", seed=0)
    with pytest.raises(ValueError):
        reg.start({"run_id": "r1"})
    reg.start(first)
    reg.start(first | {"run_id": "r2", "started_at": "2024-01-02T00:00:00"})
    reg.finish("r1", "passed", metrics={"m": 1})
    rows = reg.recent(5)
    assert [(r["run_id"], r["status"]) for r in rows] == [("r2", "running"), ("r1", "passed")] and rows[1]["metrics"] == {"m": 1}
    assert reg.contains_split("s") and not reg.contains_split("t")
    with pytest.raises(KeyError):
        reg.finish("r9", "passed")
    with pytest.raises(ValueError):
        reg.finish("r1", "running")
    with pytest.raises(ValueError):
        reg.recent(0)


def test_csv(spark, tmp_path):
    write = lambda text: (tmp_path / "g.csv").write_text(text, "utf-8") and str(tmp_path / "g.csv")
    assert {tuple(r) for r in tables.read_groups(spark, write("﻿group_id,filename\n1,a.jpg\n1,b.jpg\n")).collect()} == {("a.jpg", "1"), ("b.jpg", "1")}
    assert tables.read_manifest(spark, write("filename,group_id,more\na,1,x\n")).columns == ["filename", "group_id", "more"]
    for bad in ("filename,group_id,more\na,1,x\n", "filename\na\n", "filename,group_id\na,1\na,2\n", "filename,group_id\nx/a,1\n", "filename,group_id\na,\n", "filename,group_id\na,1,2\n"):
        with pytest.raises(ValueError):
            tables.read_groups(spark, write(bad))
    p = partition(spark, [["c", "b"], ["a"]])
    out = sinks.write_predictions(p, p.select("filename"), tmp_path / "o" / "p.csv")
    assert out.read_bytes() == b"filename,group_id\na,0\nb,1\nc,1\n"
    none = partition(spark, [])
    assert sinks.write_predictions(none, none.select("filename"), tmp_path / "e.csv").read_bytes() == b"filename,group_id\n"


def test_memo(spark, tmp_path):
    memo = sinks.Memo(spark, str(tmp_path / "memo"), ["k"], "k string, v long")
    wanted = spark.createDataFrame([("a",), ("b",)], "k string")
    hits, misses = memo.lookup(wanted, "f" * 64)
    assert hits.count() == 0 and misses.count() == 2
    memo.put(misses.withColumn("v", F.lit(1).cast("long")), "f" * 64)
    memo.put(spark.createDataFrame([("a", 2)], "k string, v long"), "f" * 64)
    hits, misses = memo.lookup(wanted, "f" * 64)
    assert {tuple(r) for r in hits.collect()} == {("a", 2), ("b", 1)} and misses.count() == 0


def test_config(tmp_path):
    c = config.shipped_config()
    turned = dict(reversed(c.as_dict().items()))
    assert config.make_config(turned).config_hash == c.config_hash
    same = config.default_config("classical", state={"strong_min_inliers": 20})
    assert same.evidence_fingerprint() == config.default_config("classical").evidence_fingerprint()
    assert config.default_config("classical", match={"ratio_test": 0.7}).evidence_fingerprint() != same.evidence_fingerprint()
    with pytest.raises(ValueError):
        config.make_config(c.as_dict() | {"more": 1})
    with pytest.raises(ValueError):
        config.make_config(c.as_dict() | {"schema_version": True})
    with pytest.raises(ValueError):
        config.default_config("classical", grouping={"strong_negative_veto": 1})
    split = config.smoke_split("a" * 64) | {"protected": True}
    with pytest.raises(PermissionError):
        config.check_split(split, "a" * 64)
    assert config.check_split(split, "a" * 64, allow_protected=True)["protected"]
    for bad in ("/a", "../a", "", "."):
        with pytest.raises(ValueError):
            config.safe_path(bad)


def test_descriptor_evidence(spark):
    rng = random.Random(7)
    rows = []
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(16)]
    for name, shift in (("a", 0.0), ("b", 2.0)):
        for i in range(16):
            rows.append((name, i, (i % 4) * 16 + 4 + shift, (i // 4) * 16 + 4 + shift, [x + rng.gauss(0, 0.01) for x in base[i]]))
    for i in range(16):
        rows.append(("c", i, (i % 4) * 16 + 4.0, (i // 4) * 16 + 4.0, [rng.gauss(0, 1) for _ in range(8)]))
    d = spark.createDataFrame(rows, "filename string, no int, x double, y double, descriptor array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "left string, right string")
    out = {r["right"]: r for r in evidence.descriptor_evidence(pairs, d).collect()}
    assert out["b"]["mutual_matches"] == 16 and out["b"]["inliers"] == 16 and out["b"]["scale"] == pytest.approx(1.0)
    assert out["b"]["translation_fraction"] == pytest.approx((2 * (2 / 64) ** 2) ** 0.5) and out["b"]["grid_coverage_left"] == 1.0
    assert out["c"]["mutual_matches"] < 8


def test_variants_and_packaging(tmp_path):
    from pairgraph.sources import packaging

    for name in config.VARIANTS:
        assert config.variant(name).name == name
    shipped = config.shipped_config().parameters
    three = config.variant("group-three-edge-consensus").parameters
    assert all(three[k] == shipped[k] for k in three)
    a = packaging.write_zip({"b": b"1", "a": b"2"}, tmp_path / "a.zip").read_bytes()
    assert a == packaging.write_zip({"a": b"2", "b": b"1"}, tmp_path / "b.zip").read_bytes()
    text = "# note\nimage: repo/name:1\ncontact: <address>\nmachine_type: large # x\n"
    assert packaging.check_manifest(text, ("large",))["image"] == "repo/name:1"
    for bad in (text + "image: x\n", text.replace("large", "tiny"), text.replace("<address>", "nobody"), text + "more: 1\n"):
        with pytest.raises(ValueError):
            packaging.check_manifest(bad, ("large",))


def test_dense_numbers(spark):
    from pairgraph.plans.numbering import dense_numbers

    rng = random.Random(2)
    values = [f"v{rng.randrange(10**6)}" for _ in range(500)] + ["v1", "v1"]
    df = spark.createDataFrame([(v,) for v in values], "x string").repartition(6)
    assert {r["x"]: r["no"] for r in dense_numbers(df, "x").collect()} == {v: i for i, v in enumerate(sorted(set(values)))}
    assert dense_numbers(df.limit(0), "x").count() == 0


def test_tables_in_the_shared_folder(spark):
    from pairgraph.plans import store

    kept = store.materialize(spark.range(5), "five")
    gone = store.materialize(spark.range(3), "three")
    store.discard(gone)
    assert kept.count() == 5 and store.shared_dir(spark) in kept.inputFiles()[0]
    with pytest.raises(Exception, match="FILE|exist|PATH"):
        gone.count()


def test_stretch_rounds_as_its_sql(spark, tmp_path):
    """Percentiles have the bits of quantile_cont, so a share on half a level goes the same way; nulls are no values and come last."""
    want = {
        1: ([35209.1, 17035.67, 40176.53, 95862.88], [49, 0, 104, 255]),
        2: ([994.35, 1417.65, 1060.65, 1151.43, 1121.85, 936.38], [0, 255, 95, 255, 213, 0]),
        3: ([1797.6, 1619.1, 1560.45, 1657.35], [255, 43, 0, 153]),
        4: ([24789.41, 43250.03, None, 57230.42, 87214.56, None, 49859.72, None, 91989.17], [0, 0, 0, 90, 255, 0, 36, 0, 255]),
        5: ([None, None], [0, 0]),
        6: ([7.5, 7.5, None], [7.5, 7.5, None]),
    }
    rows = [(k, i, p) for k, (prices, _) in want.items() for i, p in enumerate(prices)]
    rows += [(7, None, 1.0), (7, 1, None), (7, 1, 3.0), (7, 2, 2.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["l_orderkey"]: r["levels"] for r in queries.queries()["q_stretch"](spark, str(tmp_path)).collect()}
    assert got == {k: levels for k, (_, levels) in want.items()} | {7: [255.0, 0.0, 128.0, 0.0]}


def test_fused_is_rounded_once(spark):
    rng = random.Random(3)
    rows = [tuple(rng.choice((-1, 1)) * 10 ** rng.uniform(-9, 9) for _ in "abc") for _ in range(2000)] + [(float("inf"), 0.75, 1.0)]
    frame = spark.createDataFrame(rows, "a double, b double, c double")
    got = frame.select("a", "b", "c", vx.fused(F.col("a"), F.col("b"), F.col("c")).alias("r")).collect()
    assert all(r["r"] == (float(Fraction(r["a"]) * Fraction(r["b"]) + Fraction(r["c"])) if r["a"] != float("inf") else r["a"]) for r in got)
    assert any(r["a"] * r["b"] + r["c"] != r["r"] for r in got)
