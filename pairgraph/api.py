"""The plain calls: lists of paths and of groups in, lists out."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from pairgraph.operators import partitions
from pairgraph.plans import image_runs
from pairgraph.plans.config import shipped_config


@dataclass(frozen=True)
class ScoreResult:
    exact_matches: int
    total_reference_groups: int
    exact_group_score: float
    metrics: dict[str, Any]


@dataclass(frozen=True)
class GroupOutcome:
    groups: list[list[str]]
    resources: dict[str, Any]


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.builder.appName("pairgraph").getOrCreate()


def group_images_with_resources(image_paths: list[str], *, spark: SparkSession | None = None) -> GroupOutcome:
    """Groups of the images by the shipped settings, with counts and time. Names of files decide nothing but order."""
    session, began = _session(spark), time.perf_counter()
    images = image_runs.load_paths(session, list(image_paths))
    n = len(image_paths)
    resources: dict[str, Any] = {"image_count": n, "all_pair_count": n * (n - 1) // 2, "candidate_pair_count": 0}
    groups: list[list[str]] = []
    if n:
        run = image_runs.run_classical(images, shipped_config())
        groups = image_runs.as_lists(run.partition)
        resources |= {"candidate_pair_count": run.decisions.count(), **run.counters}
    return GroupOutcome(groups, resources | {"wall_seconds": time.perf_counter() - began})


def group_images(image_paths: list[str], *, spark: SparkSession | None = None) -> list[list[str]]:
    """The groups, each sorted, in the order of their members."""
    return group_images_with_resources(image_paths, spark=spark).groups


def score_groups(reference: list[list[str]], predicted: list[list[str]], *, spark: SparkSession | None = None) -> ScoreResult:
    """Exact-set score of two partitions of the same names; a group that is given twice raises."""
    session = _session(spark)

    def table(groups: list[list[str]]):
        if len({tuple(sorted(g)) for g in groups}) != len(groups):
            raise ValueError("a group is given twice")
        return session.createDataFrame([(n, str(i)) for i, g in enumerate(groups) for n in g], "filename string, group_id string")

    ref, pred = table(reference), table(predicted)
    partitions.validate(pred, ref.select("filename"))
    m = partitions.score(ref, pred).first().asDict()
    return ScoreResult(m["exact_matches"], m["total_reference_groups"], m["exact_group_score"], m)
