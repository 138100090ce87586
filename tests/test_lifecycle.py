"""Registered runs, sweeps, audits, the gallery, the command line and the watched folder."""

import json

import numpy as np
import pytest
from test_images import expose, scene

import pairgraph
from pairgraph.__main__ import main
from pairgraph.functions import kernels as k
from pairgraph.plans import config, image_runs, lifecycle
from pairgraph.plans.gallery import render_gallery
from pairgraph.plans.registry import RunRegistry
from pairgraph.streaming.folder import watch_folder


@pytest.fixture(scope="module")
def package(tmp_path_factory):
    top = tmp_path_factory.mktemp("package")
    (top / "data").mkdir()
    rows = ["filename,group_id"]
    for i in range(3):
        for gain in (0.7, 1.0):
            name = f"g{i}_{gain}.png"
            (top / "data" / name).write_bytes(k.png_bytes(expose(scene(i, 100, 130), gain)))
            rows.append(f"{name},{i}")
    (top / "manifest.csv").write_text("\n".join(rows) + "\n")
    for name, c in (("b0", config.make_config({"algorithm": "singleton", "name": "b0", "parameters": {}, "schema_version": 1, "seed": 0})), ("b1", config.default_config("structural", "b1"))):
        (top / f"{name}.json").write_text(config.canonical_json(c.as_dict()))
    return top


def options(top, tmp_path):
    return dict(dataset_root=str(top / "data"), manifest_path=str(top / "manifest.csv"), output_root=str(tmp_path / "runs"), registry_path=str(tmp_path / "registry"))


def test_run_and_protected_split(spark, package, tmp_path):
    o = options(package, tmp_path)
    out = lifecycle.run_evaluation(spark, config_path=str(package / "b1.json"), **o)
    assert out.metrics["exact_group_score"] == 1.0 and (out.folder / "predictions.csv").exists()
    assert json.loads((out.folder / "metrics.json").read_text())["predicted_group_size_distribution"] == {"2": 3}
    images = image_runs.load_images(spark, str(package / "data"))
    fingerprint = lifecycle.package_fingerprint(images, package / "manifest.csv")
    split = config.smoke_split(fingerprint) | {"protected": True, "split_id": "holdout", "selection": {"type": "group_ids", "group_ids": ["0"]}}
    path = tmp_path / "split.json"
    path.write_text(json.dumps(split))
    with pytest.raises(PermissionError):
        lifecycle.run_evaluation(spark, config_path=str(package / "b0.json"), split_path=str(path), **o)
    once = lifecycle.run_evaluation(spark, config_path=str(package / "b0.json"), split_path=str(path), allow_protected=True, **o)
    assert once.metrics["total_reference_groups"] == 1 and once.metrics["exact_matches"] == 0
    with pytest.raises(PermissionError):
        lifecycle.run_evaluation(spark, config_path=str(package / "b0.json"), split_path=str(path), allow_protected=True, **o)
    recorded = images.selectExpr("filename", "'0' AS content_hash")
    with pytest.raises(ValueError, match="changed"):
        lifecycle.run_evaluation(spark, config_path=str(package / "b0.json"), recorded=recorded, **o)
    runs = RunRegistry(spark, o["registry_path"]).recent(10)
    assert [r["status"] for r in runs] == ["passed", "passed"]


def test_sweep(spark, package, tmp_path):
    o = options(package, tmp_path)
    images = image_runs.load_images(spark, str(package / "data"))
    fingerprint = lifecycle.package_fingerprint(images, package / "manifest.csv")
    for f, ids in (("fold-a", ["0", "1"]), ("fold-b", ["2"])):
        (package / f"{f}.json").write_text(json.dumps(config.smoke_split(fingerprint) | {"split_id": f, "selection": {"type": "group_ids", "group_ids": ids}}))
    definition = {
        "candidates": [{"candidate_id": c, "config": f"{c}.json"} for c in ("b0", "b1")], "folds": ["fold-a.json", "fold-b.json"], "limitations": [],
        "schema_version": 1, "selection": config.POLICY, "stage": "test", "sweep_id": "s1",
    }
    out = lifecycle.run_sweep(spark, definition, root=str(package), **o)
    assert out["selected"] == "b1" and len(out["runs"]) == 4 and out["ranking"][0]["fold_count"] == 2
    for bad in ({"candidates": []}, {"folds": ["../x"]}, {"selection": {}}, {"more": 1}):
        with pytest.raises(ValueError):
            config.check_sweep(definition | bad)


def test_audits(spark, package, tmp_path):
    a = lifecycle.audit_package(spark, str(package / "data"), str(package / "manifest.csv"))
    assert a["integrity_failures"] == 0 and a["parts"]["label_leak"][0]["fraction"] == 1.0
    b = json.loads(json.dumps(a))
    b["image_sha256"]["g0_0.7.png"], b["group_id_by_filename"]["g1_1.0.png"] = "0" * 64, "9"
    c = lifecycle.compare_packages(spark, a, b)
    assert c["changed_names"] == ["g0_0.7.png"] and c["shared_hashes"] == 5 and (c["checked"], c["disagreeing"]) == (15, 1)


def test_gallery_is_deterministic(spark, package, tmp_path):
    images = image_runs.load_images(spark, str(package / "data"))
    failures = spark.createDataFrame([(["g0_0.7.png", "g0_1.0.png"], ["split"], [["g0_0.7.png"], ["g0_1.0.png"]])], "reference_group array<string>, failure_types array<string>, predicted_groups array<array<string>>")
    seen = []
    for out in ("one", "two"):
        render_gallery(images, failures, tmp_path / out)
        seen.append({p.name: p.read_bytes() for p in (tmp_path / out).iterdir()})
    assert seen[0] == seen[1] and set(seen[0]) == {"failure-0000.png", "index.json"}
    with pytest.raises(ValueError):
        render_gallery(images.where("filename <> 'g0_0.7.png'"), failures, tmp_path / "three")


def test_command_line(spark, package, tmp_path, capsys):
    (tmp_path / "p.csv").write_text("filename,group_id\n" + "".join(f"g{i}_{g},{i}\n" for i in range(3) for g in ("0.7.png", "1.0.png")))
    (tmp_path / "r.csv").write_text((package / "manifest.csv").read_text())
    out = main(["score", "--reference", str(tmp_path / "r.csv"), "--predictions", str(tmp_path / "p.csv")])
    assert out["exact_group_score"] == 1.0 and json.loads(capsys.readouterr().out)["exact_matches"] == 3
    assert main(["fingerprint", "--config", str(package / "b1.json")])["sha256"] == config.default_config("structural", "b1").config_hash
    with pytest.raises(SystemExit):
        main(["fingerprint"])


def test_watched_folder(spark, package, tmp_path):
    q = watch_folder(spark, str(package / "data"), str(tmp_path / "p.csv"), str(tmp_path / "state"), config=config.default_config("classical", feature={"max_features": 64}, state={"negative_min_keypoints": 10, "negative_min_mutual_matches": 4}), once=True)
    q.awaitTermination(120)
    lines = (tmp_path / "p.csv").read_text().splitlines()
    assert len(lines) == 7 and np.unique([x.split(",")[1] for x in lines[1:]]).size == 3


def test_benchmark_and_plain_calls(spark, package):
    report = main(["benchmark", "--dataset-root", str(package / "data"), "--manifest", str(package / "manifest.csv")])
    assert report["predicted_group_count"] == 3 and report["resources"]["candidate_pair_count"] == 15
    paths = sorted(str(p) for p in (package / "data").iterdir())
    out = pairgraph.group_images_with_resources(paths[::-1], spark=spark)
    want = [[f"g{i}_0.7.png", f"g{i}_1.0.png"] for i in range(3)]
    assert out.groups == want and out.resources["image_count"] == 6 and config.canonical_hash(out.groups) == report["prediction_sha256"]
    assert pairgraph.group_images([], spark=spark) == []
    score = pairgraph.score_groups(want, [want[0], want[1] + want[2]], spark=spark)
    assert (score.exact_matches, score.total_reference_groups, score.metrics["merge_damaged_reference_groups"]) == (1, 3, 2)
    with pytest.raises(ValueError):
        pairgraph.score_groups(want, [want[0], want[0]], spark=spark)
