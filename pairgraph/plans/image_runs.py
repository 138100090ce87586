"""Image runs: from files to a partition, by each of the algorithms.

Images are rows throughout. Kernels run in Arrow batches on the executors, one row at a time within a batch;
features are computed once for each content hash, evidence once for each pair of hashes, and both may be kept in
fingerprinted tables, so sweeps over states or grouping compute nothing again. Pixels never reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgraph.functions import kernels as k
from pairgraph.functions.text import basename, content_hash, pair_seed
from pairgraph.operators import decisions, grouping
from pairgraph.operators.candidates import Candidates, Screen, all_pairs, check_pairs, orient, screen_candidates
from pairgraph.operators.partitions import canonical, validate
from pairgraph.plans.config import Config, FeatureConfig, MatchConfig, StructuralConfig, shipped_config
from pairgraph.plans.store import materialize, small_batches
from pairgraph.sources.sinks import Memo, write_predictions
from pairgraph.sources.tables import discover_images

IMAGE = "filename string, path string, content_hash string, length long, height int, width int, gray binary, decode_ok boolean"
FEATURE = "content_hash string, width int, height int, quality double, normalized binary, points binary, descs binary"
MEASURES = """left_keypoints int, right_keypoints int, forward_ratio_matches int, reverse_ratio_matches int, mutual_matches int,
 model_found boolean, inliers int, inlier_ratio double, median_transfer_error double, grid_coverage_left double, grid_coverage_right double,
 hull_coverage_left double, hull_coverage_right double, coverage_min double, scale double, rotation_degrees double,
 translation_fraction double, structural_correlation double, transform array<array<double>>"""
#: A row of an Arrow batch holds an image, or the features of two.
IMAGES_AT_ONCE = 8
EVIDENCE = f"left_hash string, right_hash string, {MEASURES}"


@dataclass
class Run:
    """A run's partition with what it was made from; tables that an algorithm doesn't make are None."""

    partition: DataFrame
    candidates: Candidates | None = None
    evidence: DataFrame | None = None
    decisions: DataFrame | None = None
    fallback: DataFrame | None = None
    counters: dict[str, int] = field(default_factory=dict)


def load_images(spark: SparkSession, folder: str, *, recursive: bool = False) -> DataFrame:
    """Image files with gray pixels, turned upright; decode_ok is false where a file can't be read. The rows are written
    to the shared folder."""
    files = discover_images(spark, folder, recursive=recursive)
    return _decoded(spark, files, folder if recursive else f"{folder.rstrip('/')}/*", recursive)


def load_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same for a list of files; their names must differ."""
    if not paths:
        return spark.createDataFrame([], IMAGE)
    files = spark.read.format("binaryFile").load(paths).withColumns({"filename": basename(F.col("path")), "content_hash": content_hash(F.col("content"))})
    images = _decoded(spark, files, paths, False)
    check_names(images)
    return images


def _decoded(spark: SparkSession, files: DataFrame, where: str | list[str], recursive: bool) -> DataFrame:
    if files.isEmpty():
        return spark.createDataFrame([], IMAGE)
    reader = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", str(recursive).lower())
    pixels = reader.load(where).select(_plain(F.col("image.origin")).alias("origin"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data"))
    both = files.withColumn("origin", _plain(F.col("path"))).join(pixels, "origin", "left")
    both = both.select("filename", "path", "content_hash", "length", "content", "h", "w", "c", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                gray = None
                if row["h"] and row["h"] > 0 and row["w"] > 0:
                    gray = k.upright(k.gray_of(row["data"], row["h"], row["w"], row["c"]), k.orientation_of(row["content"]))
                shape = gray.shape if gray is not None else (None, None)
                cols = [row["filename"], row["path"], row["content_hash"], row["length"], *shape, gray.tobytes() if gray is not None else None, gray is not None]
                types = [pa.string()] * 3 + [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cols, types, strict=True)], [c.split()[0] for c in IMAGE.split(", ")])

    with small_batches(spark, IMAGES_AT_ONCE):
        return materialize(both.mapInArrow(run, IMAGE), "images")


def _plain(uri):
    """A path without its scheme, and with escapes undone."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(uri, r"\+", "%2B"), r"^[a-z]+:/+", "/"))


def _gray(row: dict) -> np.ndarray:
    return np.frombuffer(row["gray"], np.uint8).reshape(row["height"], row["width"])


def check_names(images: DataFrame) -> None:
    if not images.groupBy("filename").count().where("count > 1").isEmpty():
        raise ValueError("filenames must be unique")


def structural_descriptors(images: DataFrame, c: StructuralConfig) -> DataFrame:
    """(filename, descriptor): null where the image can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = [], []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                names.append(row["filename"])
                out.append(k.structural_descriptor(_gray(row), c).tolist() if row["gray"] is not None else None)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.list_(pa.float32()))], ["filename", "descriptor"])

    with small_batches(images.sparkSession, IMAGES_AT_ONCE):
        return materialize(images.select("filename", "height", "width", "gray").mapInArrow(run, "filename string, descriptor array<float>"), "descriptors")


def local_features(images: DataFrame, c: FeatureConfig, percentiles: tuple[float, float] | None) -> DataFrame:
    """Features of each content, whatever the number of files that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                f = k.extract_features(_gray(row), c, percentiles)
                cols = [row["content_hash"], f.width, f.height, f.quality, f.normalized.tobytes(), f.points.tobytes(), f.descriptors.tobytes()]
                types = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cols, types, strict=True)], [x.split()[0] for x in FEATURE.split(", ")])

    first = images.where("decode_ok").groupBy("content_hash").agg(F.min("filename").alias("filename")).select("filename")
    return images.join(first, "filename").select("content_hash", "height", "width", "gray").mapInArrow(run, FEATURE)


def _features_of(row: dict, side: str) -> k.Features:
    w, h = row[f"{side}_width"], row[f"{side}_height"]
    return k.Features(
        w,
        h,
        np.frombuffer(row[f"{side}_points"], np.float32).reshape(-1, 2),
        np.frombuffer(row[f"{side}_descs"], np.float32).reshape(-1, 128),
        np.frombuffer(row[f"{side}_normalized"], np.uint8).reshape(h, w),
        0.0,
    )


def measure_pairs(hash_pairs: DataFrame, features: DataFrame, c: MatchConfig, seed: int) -> DataFrame:
    """Evidence of pairs (left_hash, right_hash); the random seed of each depends on its hashes only."""
    side = lambda s: features.select(*[F.col(x).alias(f"{s}_{x}" if x != "content_hash" else f"{s}_hash") for x in ("content_hash", "width", "height", "normalized", "points", "descs")])
    rows = hash_pairs.select("left_hash", "right_hash").withColumn("seed", pair_seed(seed, F.col("left_hash"), F.col("right_hash")))
    rows = rows.join(side("left"), "left_hash").join(side("right"), "right_hash")
    names = [x.split()[0] for x in MEASURES.replace("\n", "").split(",")]
    ints = {"left_keypoints", "right_keypoints", "forward_ratio_matches", "reverse_ratio_matches", "mutual_matches", "inliers"}
    kind = lambda n: pa.int32() if n in ints else pa.bool_() if n == "model_found" else pa.list_(pa.list_(pa.float64())) if n == "transform" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, left, right = [], [], []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out.append(k.pair_evidence(_features_of(row, "left"), _features_of(row, "right"), c, row["seed"]))
                left.append(row["left_hash"])
                right.append(row["right_hash"])
            cols = [pa.array(left, pa.string()), pa.array(right, pa.string())] + [pa.array([o[n] for o in out], kind(n)) for n in names]
            yield pa.RecordBatch.from_arrays(cols, ["left_hash", "right_hash", *names])

    return rows.mapInArrow(run, EVIDENCE)


def _memoized(memo: Memo | None, fingerprint: str, wanted: DataFrame, compute, name: str, counters: dict[str, int], kind: str) -> DataFrame:
    """Rows for the wanted keys, those not kept computed and kept; counts hits and misses."""
    if memo is None:
        with small_batches(wanted.sparkSession, IMAGES_AT_ONCE):
            out = materialize(compute(wanted), name)
        counters[f"{kind}_misses"] = counters.get(f"{kind}_misses", 0) + out.count()
        return out
    hits, misses = memo.lookup(wanted, fingerprint)
    counters[f"{kind}_hits"] = counters.get(f"{kind}_hits", 0) + hits.count()
    counters[f"{kind}_misses"] = counters.get(f"{kind}_misses", 0) + misses.count()
    hits = materialize(hits, name)
    if not misses.isEmpty():
        with small_batches(wanted.sparkSession, IMAGES_AT_ONCE):
            fresh = materialize(compute(misses), name)
        memo.put(fresh, fingerprint)
        return hits.unionByName(fresh.select(*hits.columns))
    return hits


def view_evidence(images: DataFrame, pairs: DataFrame, config: Config, view: str, *, cache: str | None = None, counters: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(evidence, features) of candidate pairs in one view, clahe or percentile-clahe.

    Pairs are turned so that content hashes ascend; files of equal content share measurements, which are bound
    to the names of each pair.
    """
    spark, s = images.sparkSession, config.sections()
    counters = {} if counters is None else counters
    stretch = (s["percentile_stretch"].low_percentile, s["percentile_stretch"].high_percentile) if view != "clahe" else None
    feature_memo = Memo(spark, f"{cache}/features", ["content_hash"], FEATURE) if cache else None
    pair_memo = Memo(spark, f"{cache}/evidence", ["left_hash", "right_hash"], EVIDENCE) if cache else None
    hashes = images.where("decode_ok").select("content_hash").distinct()
    features = _memoized(feature_memo, config.feature_fingerprint(view), hashes, lambda m: local_features(images.join(m, "content_hash", "left_semi"), s["feature"], stretch), "features", counters, "feature")
    name_hash = images.select("filename", "content_hash")
    l, r = name_hash.withColumnsRenamed({"filename": "left", "content_hash": "left_hash"}), name_hash.withColumnsRenamed({"filename": "right", "content_hash": "right_hash"})
    turned = orient(pairs.select("left", "right").join(l, "left").join(r, "right"))
    wanted = turned.select("left_hash", "right_hash").distinct()
    found = _memoized(pair_memo, config.evidence_fingerprint(view), wanted, lambda m: measure_pairs(m, features, s["match"], config.seed), "evidence", counters, "pair")
    return turned.join(found, ["left_hash", "right_hash"]).withColumn("view", F.lit(view)), features


def run_singletons(images: DataFrame) -> Run:
    return Run(grouping.singletons(images))


def run_structural(images: DataFrame, c: StructuralConfig) -> Run:
    """Components of descriptors within the threshold; unreadable images stand alone."""
    from pairgraph.operators.candidates import pairs_within

    check_names(images)
    d = structural_descriptors(images, c)
    edges = pairs_within(d.where("descriptor IS NOT NULL"), c.structural_distance_threshold)
    return Run(grouping.component_groups(images, edges), fallback=d.where("descriptor IS NULL").select("filename"))


def _screened(images: DataFrame, config: Config) -> Candidates:
    c = config.sections()["candidate_screen"]
    screen = Screen(c.all_pairs_max_images, c.top_k)
    if images.count() <= screen.all_pairs_max:  # descriptors aren't made for so few
        return screen_candidates(images.select("filename", F.lit(None).cast("array<float>").alias("descriptor")), screen)
    return screen_candidates(structural_descriptors(images, c.structural), screen)


def run_classical(images: DataFrame, config: Config, *, pairs: DataFrame | None = None, cache: str | None = None, strict: bool = False) -> Run:
    """One or two views, over all pairs or screened ones, as the algorithm of the configuration says.

    strict: an unreadable image that isn't screened off raises; else it stands alone.
    """
    check_names(images)
    s = config.sections()
    candidates = None
    if pairs is None:
        candidates = _screened(images, config) if config.algorithm == "classical-screened-dual-clahe" else None
        pairs = candidates.pairs if candidates else all_pairs(images.select("filename"))
    elif not check_pairs(pairs, images).isEmpty():
        raise ValueError("bad candidate pairs")
    good = images.where("decode_ok")
    lost = images.where("NOT decode_ok").select("filename")
    dropped = candidates.fallback if candidates else lost.limit(0)
    if strict and not lost.join(dropped, "filename", "left_anti").isEmpty():
        raise ValueError("an image can't be read")
    names = good.select("filename")
    pairs = materialize(pairs.join(names.withColumnRenamed("filename", "left"), "left", "left_semi").join(names.withColumnRenamed("filename", "right"), "right", "left_semi"), "pairs")
    views = {"classical": ["clahe"], "classical-percentile-clahe": ["percentile-clahe"]}.get(config.algorithm, ["clahe", "percentile-clahe"])
    counters: dict[str, int] = {}
    evidence, features = None, None
    for view in views:
        e, features = view_evidence(good, pairs, config, view, cache=cache, counters=counters)
        evidence = e if evidence is None else evidence.unionByName(e)
    decided = materialize(decisions.classify(evidence, s["state"]), "decisions")
    if len(views) > 1:
        decisions.check_views(decided, views) if not decided.isEmpty() else None
        final = decisions.fuse(decided)
        members = names  # with two views no quality is given, so the smallest name represents
    else:
        final = decided.drop("view")
        members = good.select("filename", "content_hash").join(features.select("content_hash", "quality"), "content_hash").select("filename", "quality")
    partition = grouping.constrained_groups(members, final, s["grouping"]).unionByName(grouping.singletons(lost))
    return Run(materialize(partition, "partition"), candidates, evidence, final, lost, counters)


def run_algorithm(images: DataFrame, config: Config, **options: Any) -> Run:
    if config.algorithm == "singleton":
        return run_singletons(images)
    if config.algorithm == "structural":
        return run_structural(images, config.sections()["structural"])
    return run_classical(images, config, **options)


def as_lists(partition: DataFrame) -> list[list[str]]:
    """A partition in canonical form; it must fit the driver."""
    out: list[list[str]] = []
    for r in canonical(partition).orderBy("group_no", "filename").collect():
        if r["group_no"] == len(out):
            out.append([])
        out[-1].append(r["filename"])
    return out


def group_frame(images: DataFrame) -> DataFrame:
    """The shipped settings: (filename, group_no) in canonical order."""
    return canonical(run_classical(images, shipped_config()).partition)


def group_folder(spark: SparkSession, input_dir: str, output_dir: str):
    """A folder of images to predictions.csv."""
    images = load_images(spark, input_dir)
    run = run_classical(images, shipped_config())
    return write_predictions(run.partition, images.select("filename"), f"{output_dir}/predictions.csv")


def audit_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a package as audits take them, with perceptual hash and exposure measures."""
    images = load_images(spark, folder, recursive=True)
    schema = "filename string, path string, content_hash string, length long, width int, height int, format string, decode_ok boolean, perceptual_hash string, dark double, bright double, luminance double, sharpness double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                seen = {"format": row["filename"].rsplit(".", 1)[-1].lower(), "perceptual_hash": None, "dark": None, "bright": None, "luminance": None, "sharpness": None}
                if row["decode_ok"]:
                    seen |= {"perceptual_hash": k.difference_hash(_gray(row))} | k.exposure_stats(_gray(row))
                rows.append({**row, **seen})
            types = {"length": pa.int64(), "width": pa.int32(), "height": pa.int32(), "decode_ok": pa.bool_(), "dark": pa.float64(), "bright": pa.float64(), "luminance": pa.float64(), "sharpness": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names)

    with small_batches(spark, IMAGES_AT_ONCE):
        return materialize(images.mapInArrow(run, schema), "audited-files")
