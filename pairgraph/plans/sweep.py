"""Splits, folds, aggregation of fold runs and the ranking of candidates."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = ("feature_cache_hits", "feature_cache_misses", "pair_cache_hits", "pair_cache_misses")


def select_split(manifest: DataFrame, selection: dict[str, Any]) -> DataFrame:
    """The rows of the manifest that a selection names; unknown groups raise."""
    if selection == {"type": "all"}:
        return manifest
    if set(selection) != {"type", "group_ids"} or selection["type"] != "group_ids":
        raise ValueError("a selection is all or group_ids")
    ids = selection["group_ids"]
    if not ids or len(set(ids)) != len(ids) or not all(isinstance(i, str) for i in ids):
        raise ValueError("group_ids must be unique texts")
    wanted = manifest.sparkSession.createDataFrame([(i,) for i in ids], "group_id string")
    if not wanted.join(manifest, "group_id", "left_anti").isEmpty():
        raise ValueError("the selection names unknown groups")
    return manifest.join(wanted, "group_id", "left_semi")


def hash_order(groups: DataFrame, tag: str) -> DataFrame:
    """(group_id, size, order_key): groups with the digest that orders them."""
    key = F.sha2(F.concat(F.lit(f"{tag}:"), "group_id").cast("binary"), 256)
    return groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).withColumn("order_key", key)


def assign_folds(groups: DataFrame, tag: str, folds: tuple[str, ...] = ("a", "b", "c"), capacity: int = 100) -> DataFrame:
    """(group_id, size, fold): groups in hash order go to the smallest fold that has room, else to none.

    The scan is sequential by definition, over one row a group; it runs as one Arrow group.
    """

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        load = dict.fromkeys(folds, 0)
        out = []
        for g, n in pdf.sort_values("order_key")[["group_id", "size"]].itertuples(index=False):
            free = [f for f in folds if load[f] + n <= capacity]
            best = min(free, key=lambda f: (load[f], folds.index(f))) if free else None
            if best is not None:
                load[best] += n
            out.append((g, n, best))
        return pd.DataFrame(out, columns=["group_id", "size", "fold"])

    return hash_order(groups, tag).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(scan, "group_id string, size long, fold string")


def holdout(groups: DataFrame, tag: str, target: int = 400) -> DataFrame:
    """(group_id, size): in hash order, every group that still fits the target."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = target, []
        for g, n in pdf.sort_values("order_key")[["group_id", "size"]].itertuples(index=False):
            if n <= left:
                left -= n
                out.append((g, n))
        return pd.DataFrame(out, columns=["group_id", "size"])

    return hash_order(groups, tag).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(scan, "group_id string, size long")


def aggregate_runs(runs: DataFrame) -> DataFrame:
    """One row for each candidate_id over its folds: micro, mean and worst scores, sums, the highest memory.

    runs: candidate_id, the seven metrics and the resources of a fold; cache counters may be null.
    """
    share = lambda a, b: F.when(F.sum(b) == 0, 1.0).otherwise(F.sum(a) / F.sum(b))
    total = lambda c: F.sum(c).cast("long").alias(c)
    have = [c for c in COUNTERS if c in runs.columns]
    out = runs.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("fold_count"),
        share("exact_matches", "total_reference_groups").alias("micro_exact_group_score"),
        F.avg("exact_group_score").alias("mean_fold_exact_group_score"),
        F.min("exact_group_score").alias("worst_fold_exact_group_score"),
        total("exact_matches"),
        total("total_reference_groups"),
        share("non_singleton_exact_matches", "non_singleton_reference_groups").alias("micro_non_singleton_exact_group_score"),
        total("non_singleton_exact_matches"),
        total("non_singleton_reference_groups"),
        total("merge_damaged_reference_groups"),
        total("split_reference_groups"),
        F.sum("wall_seconds").alias("total_wall_seconds"),
        F.max("peak_rss_bytes").alias("maximum_peak_rss_bytes"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in have],
    )
    return out.select("*", *[F.lit(0).cast("long").alias(c) for c in COUNTERS if c not in have])


def rank_candidates(aggregates: DataFrame) -> DataFrame:
    """Aggregates with place (from 1): candidates without merges first, then by score, splits, time and id."""
    from pyspark.sql import Window

    order = Window.orderBy(
        (F.col("merge_damaged_reference_groups") != 0).cast("int"),
        F.desc("micro_exact_group_score"),
        F.desc("worst_fold_exact_group_score"),
        F.desc("micro_non_singleton_exact_group_score"),
        "split_reference_groups",
        "total_wall_seconds",
        "candidate_id",
    )
    return aggregates.withColumn("place", F.row_number().over(order).cast("long"))
