"""The image path on generated scenes."""

import numpy as np
import pytest

from pairgraph.functions import kernels as k
from pairgraph.operators import audit, partitions
from pairgraph.plans import config, image_runs


def scene(seed, height=150, width=200):
    rng = np.random.default_rng(seed)
    image = k.blur(rng.uniform(0, 255, (height, width)), 2.0)
    image = (image - image.min()) / (image.max() - image.min()) * 180 + 20
    y, x = rng.integers(10, 60, 2)
    image[y : y + 50, x : x + 70] += 30
    return image


def expose(image, gain):
    return np.clip(image * gain, 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("images")
    for i, name in enumerate(("house", "hall")):
        base = scene(i)
        for gain in (0.6, 1.0, 1.2):
            (top / f"{name}_{gain}.png").write_bytes(k.png_bytes(expose(base, gain)))
    (top / "house_copy.PNG").write_bytes((top / "house_1.0.png").read_bytes())
    shifted = np.pad(scene(0), 4, mode="reflect")[1:151, 8:208]
    (top / "house_moved é.png").write_bytes(k.png_bytes(np.repeat(expose(shifted, 1.0)[:, :, None], 3, axis=2)))
    (top / "broken.jpg").write_bytes(b"no image")
    (top / "notes.txt").write_text("x")
    (top / "sub").mkdir()
    (top / "sub" / "deep.png").write_bytes(k.png_bytes(expose(scene(5), 1.0)))
    return top


GROUPS = {frozenset({"house_0.6.png", "house_1.0.png", "house_1.2.png", "house_copy.PNG", "house_moved é.png"}), frozenset({"hall_0.6.png", "hall_1.0.png", "hall_1.2.png"}), frozenset({"broken.jpg"})}


def sets(partition):
    found = {}
    for r in partition.collect():
        found.setdefault(r["group_id"], set()).add(r["filename"])
    return {frozenset(v) for v in found.values()}


def test_screened_run_end_to_end(spark, folder, tmp_path):
    images = image_runs.load_images(spark, str(folder))
    assert images.count() == 9 and images.where("NOT decode_ok").count() == 1
    assert image_runs.load_images(spark, str(folder), recursive=True).count() == 10
    run = image_runs.run_classical(images, config.shipped_config())
    assert sets(run.partition) == GROUPS
    assert run.candidates.mode == "all_pairs" and run.evidence.count() == 2 * 28
    out = image_runs.group_folder(spark, str(folder), str(tmp_path / "out"))
    assert out.read_text().splitlines()[:2] == ["filename,group_id", "broken.jpg,0"]


def test_other_algorithms_and_caches(spark, folder, tmp_path):
    images = image_runs.load_images(spark, str(folder)).where("filename LIKE 'h%'")
    c = config.default_config("classical", feature={"max_features": 128})
    first = image_runs.run_classical(images, c, cache=str(tmp_path / "cache"), strict=True)
    assert first.counters == {"feature_hits": 0, "feature_misses": 7, "pair_hits": 0, "pair_misses": first.counters["pair_misses"]}
    again = image_runs.run_classical(images, c, cache=str(tmp_path / "cache"))
    assert again.counters["feature_misses"] == again.counters["pair_misses"] == 0
    assert sets(first.partition) == sets(again.partition) == GROUPS - {frozenset({"broken.jpg"})}
    assert len(sets(image_runs.run_algorithm(images, config.make_config({"algorithm": "singleton", "name": "b0", "parameters": {}, "schema_version": 1, "seed": 0})).partition)) == 8
    b1 = sets(image_runs.run_algorithm(images, config.default_config("structural")).partition)
    assert b1 == GROUPS - {frozenset({"broken.jpg"})}


def test_top_k_screen_and_strict(spark, folder):
    images = image_runs.load_images(spark, str(folder))
    c = config.default_config("classical-screened-dual-clahe", candidate_screen={"all_pairs_max_images": 2, "top_k": 4}, feature={"max_features": 96})
    run = image_runs.run_classical(images, c, strict=True)  # the screen drops what it can't read
    assert run.candidates.mode == "structural_top_k" and [r[0] for r in run.candidates.fallback.collect()] == ["broken.jpg"]
    assert frozenset({"broken.jpg"}) in sets(run.partition)
    with pytest.raises(ValueError):
        image_runs.run_classical(images, config.default_config("classical"), strict=True)


def test_audit_of_a_folder(spark, folder):
    files = image_runs.audit_files(spark, str(folder)).cache()
    manifest = spark.createDataFrame([("house_1.0.png", "1"), ("house_copy.PNG", "2"), ("lost.png", "2")], "filename string, group_id string")
    out = audit.audit(files, manifest)
    assert out["counts"].first()["n_files"] == 10 and out["counts"].first()["undecodable"] == 1
    assert [r["names"] for r in out["duplicate_content"].collect()] == [["house_1.0.png", "house_copy.PNG"]]
    assert out["cross_group_collisions"].count() == 1
    assert {r["filename"] for r in out["inventory"].where("problem = 'missing'").collect()} == {"lost.png"}


def test_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    out = image_runs.group_folder(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    assert out.read_bytes() == b"filename,group_id\n"
    with pytest.raises(FileNotFoundError):
        image_runs.load_images(spark, str(tmp_path / "missing"))


def test_kernels():
    row = np.array([[0, 10, 20, 30, 40]], np.uint8)
    assert k.stretch(row, 25, 75).tolist() == [[0, 0, 128, 255, 255]]
    flat = np.full((3, 4), 17, np.uint8)
    same = k.stretch(flat, 1, 99)
    assert (same == flat).all() and same is not flat
    assert not k.normal_exposure(flat, 2, 98).any()
    assert k.hull_coverage(np.array([[0, 0], [10, 0], [10, 10], [0, 10], [5, 5]]), 20, 10) == pytest.approx(0.5)
    assert k.hull_coverage(np.array([[0, 0], [10, 0]]), 20, 10) == 0
    assert k.grid_coverage(np.array([[0, 0], [63, 63], [64, 64]]), 64, 64, 4) == 2 / 16
    rng = np.random.default_rng(0)
    s = rng.uniform(0, 100, (30, 2))
    m = np.array([[0.9, -0.1, 5], [0.1, 0.9, -3]])
    t = k.apply(m, s)
    t[:8] += 50
    got, inside = k.robust_similarity(s, t, config.MatchConfig(), 1)
    assert np.allclose(got, m) and inside.tolist() == [False] * 8 + [True] * 22
    assert np.allclose(k.apply(k.inverse(m), k.apply(m, s)), s)
    q, d = rng.normal(size=(20, 8)), rng.normal(size=(15, 8))
    plain = {}
    for i, x in enumerate(q):
        e = np.linalg.norm(d - x, axis=1)
        a, b = np.sort(e)[:2]
        if a < 0.9 * b:
            plain[i] = int(e.argmin())
    assert k.ratio_matches(q, d, 0.9) == plain and k.ratio_matches(q, d[:1], 0.9) == {}
    assert k.resize(np.arange(12.0).reshape(3, 4), 3, 2).tolist() == [[0.5, 2.5], [4.5, 6.5], [8.5, 10.5]]
    image = expose(scene(3), 1.0)
    assert len(k.difference_hash(image)) == 16 and k.difference_hash(image) == k.difference_hash(expose(scene(3), 0.9))


def test_orientation():
    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + b"\xff\xda\0\0"
    assert k.orientation_of(jpeg) == 6 and k.orientation_of(b"\x89PNG") == 1 and k.orientation_of(b"\xff\xd8\xff\xda") == 1
    a = np.arange(6).reshape(2, 3)
    assert k.upright(a, 6).tolist() == [[3, 0], [4, 1], [5, 2]] and k.upright(a, 3).tolist() == [[5, 4, 3], [2, 1, 0]]
    assert k.upright(k.upright(a, 6), 8).tolist() == a.tolist()


def test_scoring_a_run(spark, folder):
    images = image_runs.load_images(spark, str(folder)).where("filename LIKE 'h%'")
    truth = images.selectExpr("filename", "substr(filename, 1, 4) AS group_id")
    run = image_runs.run_structural(images, config.StructuralConfig())
    assert partitions.score(truth, run.partition).first()["exact_group_score"] == 1.0
