"""Semantic traps that are easily got wrong."""

import numpy as np
import pytest

from pairgraph.functions import kernels
from pairgraph.operators import candidates, grouping
from pairgraph.plans import image_runs
from pairgraph.plans.config import GroupingConfig
from pairgraph.sources.sinks import write_predictions
from pairgraph.sources.tables import read_groups, read_manifest


def test_csv_columns_and_marks(spark, tmp_path):
    """T10: the group file refuses further columns and the manifest keeps them; both take a byte order mark."""
    path = tmp_path / "m.csv"
    path.write_text("\ufefffilename,group_id,note\na.png,1,x\nb.png,2,y\n", encoding="utf-8")
    assert [tuple(r) for r in read_manifest(spark, str(path)).orderBy("filename").collect()] == [("a.png", "1", "x"), ("b.png", "2", "y")]
    with pytest.raises(ValueError):
        read_groups(spark, str(path))
    path.write_text("\ufeffgroup_id,filename\n1,a.png\n", encoding="utf-8")
    assert [tuple(r) for r in read_groups(spark, str(path)).collect()] == [("a.png", "1")]


def test_a_name_twice_is_refused(spark, tmp_path):
    """T11: no row of a repeated name counts."""
    path = tmp_path / "g.csv"
    path.write_text("filename,group_id\na.png,1\na.png,2\n")
    with pytest.raises(ValueError, match="duplicate"):
        read_groups(spark, str(path))


def test_variance_is_that_of_the_population():
    """T14."""
    image = np.arange(64, dtype=np.uint8).reshape(8, 8)
    stats = kernels.exposure_stats(np.tile(image, (4, 4)))
    assert stats["luminance"] == np.median(image)
    square = np.array([[0, 10, 0, 10]] * 4, np.uint8)
    assert kernels.exposure_stats(square)["sharpness"] >= 0 and float(square.std()) == 5.0


def test_ids_count_up_in_canonical_order(spark, tmp_path):
    """T21: ids are numbers in the order of the groups' members, and text when they are read again."""
    part = spark.createDataFrame([("b", "x"), ("a", "z"), ("c", "x"), ("d", "y")], "filename string, group_id string")
    path = write_predictions(part, part.select("filename"), tmp_path / "p.csv")
    assert path.read_bytes() == b"filename,group_id\na,0\nb,1\nc,1\nd,2\n"
    assert {tuple(r) for r in read_groups(spark, str(path)).collect()} == {("a", "0"), ("b", "1"), ("c", "1"), ("d", "2")}


def test_repeated_names_raise(spark):
    """T27: candidates and runs refuse images of one name."""
    twice = spark.createDataFrame([("a", [1.0]), ("a", [0.0])], "filename string, descriptor array<double>")
    with pytest.raises(ValueError, match="unique"):
        candidates.screen_candidates(twice)
    with pytest.raises(ValueError, match="unique"):
        image_runs.check_names(twice)


def test_a_pair_that_is_screened_off_vetoes_nothing(spark):
    """T3: only decided pairs count."""
    names = spark.createDataFrame([(n,) for n in "abc"], "filename string")
    rows = [("a", "b", "strong_positive", 0.9), ("b", "c", "strong_positive", 0.8), ("a", "c", "negative", 0.1)]
    schema = "left string, right string, state string, score double"
    groups = lambda d: {r["group_id"] for r in grouping.constrained_groups(names, spark.createDataFrame(d, schema), GroupingConfig()).collect()}
    assert groups(rows) == {"a", "c"} and groups(rows[:2]) == {"a"}


def test_tiles_do_not_change_the_join(spark):
    """Top-k and threshold pairs are the same however many blocks there are, ties and empty vectors included."""
    rng = np.random.default_rng(7)
    rows = [(f"v{i:02d}", (rng.integers(-1, 2, 3) / 1.0).tolist()) for i in range(40)]
    rows = [(n, (np.array(v) / max(1e-9, np.linalg.norm(v))).tolist() if any(v) else v) for n, v in rows]
    frame = spark.createDataFrame(rows, "filename string, descriptor array<double>")
    whole = {tuple(r) for r in candidates.top_k_neighbours(frame, 5).collect()}
    small = {tuple(r) for r in candidates.top_k_neighbours(frame, 5, block_bytes=200).collect()}
    d = candidates.distances(np.array([v for _, v in rows]), np.array([v for _, v in rows]))
    want = set()
    for i, (n, _) in enumerate(rows):
        others = sorted(d[i, j] for j in range(40) if j != i)
        want |= {(n, rows[j][0], float(d[i, j])) for j in range(40) if j != i and d[i, j] <= others[4]}
    assert whole == small == want
    near = {(r["left"], r["right"]) for r in candidates.pairs_within(frame, 0.3, block_bytes=200).collect()}
    assert near == {(rows[i][0], rows[j][0]) for i in range(40) for j in range(i + 1, 40) if d[i, j] <= 0.3}
