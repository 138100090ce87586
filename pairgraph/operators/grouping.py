"""Grouping of names by pair decisions with support and veto, and the plainer groupings.

Merges need a strong edge between two clusters, so no cluster leaves a component of the strong-edge graph, and
the order of edges within a component is the order overall. The rule is therefore exact per component: components
are found first, and each is settled by itself in one Arrow group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgraph.operators.components import connected_components
from pairgraph.plans.config import GroupingConfig
from pairgraph.plans.store import materialize


def singletons(names: DataFrame) -> DataFrame:
    return names.select("filename", F.col("filename").alias("group_id"))


def component_groups(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(filename, group_id): components of the edges (left, right); names without edges stand alone."""
    comp = connected_components(edges, "left", "right")
    return (
        names.select("filename")
        .join(comp, F.col("filename") == F.col("id"), "left")
        .select("filename", F.coalesce("component", "filename").alias("group_id"))
    )


def _may_merge(a: set, b: set, edges: dict, quality: dict, c: GroupingConfig) -> bool:
    """Whether two clusters may merge, by the decided edges across them."""
    strong, positive = [], []
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    for x in small:
        for y, state in edges.get(x, {}).items():
            if y not in large:
                continue
            if state == "negative" and c.strong_negative_veto:
                return False
            pair = (x, y) if x in a else (y, x)
            if state == "strong_positive":
                strong.append(pair)
            if state in ("strong_positive", "positive"):
                positive.append(pair)
    if not strong:
        return False
    if len(a) == 1 or len(b) == 1:
        return True
    if c.representative_strong_support:
        heads = {min(s, key=lambda n: (-quality[n], n)) for s in (a, b)}
        if any(x in heads or y in heads for x, y in strong):
            return True
    sides = {x for x, _ in positive}, {y for _, y in positive}
    return len(positive) >= c.min_independent_support_edges and min(map(len, sides)) >= 2


def settle(names: list[str], decided: list[tuple[str, str, str, float]], quality: dict[str, float], c: GroupingConfig) -> dict[str, str]:
    """{name: its cluster's smallest name}. decided: (left, right, state, score).

    Edges are tried strong ones first, then by falling score and by names, in passes until a pass merges none.
    """
    edges: dict[str, dict[str, str]] = {}
    for left, right, state, _ in decided:
        edges.setdefault(left, {})[right] = state
        edges.setdefault(right, {})[left] = state
    order = sorted(
        (d for d in decided if d[2] in ("strong_positive", "positive")),
        key=lambda d: (d[2] != "strong_positive", -d[3], d[0], d[1]),
    )
    members = {n: {n} for n in names}
    owner = {n: n for n in names}
    merged = True
    while merged:
        merged = False
        for left, right, _, _ in order:
            x, y = sorted((owner[left], owner[right]))
            if x != y and _may_merge(members[x], members[y], edges, quality, c):
                members[x] |= members.pop(y)
                for n in members[x]:
                    owner[n] = x
                merged = True
    return {n: min(members[owner[n]]) for n in names}


def constrained_groups(names: DataFrame, decisions: DataFrame, config: GroupingConfig = GroupingConfig()) -> DataFrame:
    """(filename, group_id) from names (filename, and quality if there is one) and decisions.

    Pairs without a decision and unknown ones neither support nor veto. A component's edges go to one group;
    its size is that of the largest set of names tied by strong edges.
    """
    if "quality" not in names.columns:
        names = names.withColumn("quality", F.lit(0.0))
    decisions = materialize(decisions.select("left", "right", "state", F.col("score").cast("double").alias("score")), "decisions")
    strong = decisions.where("state = 'strong_positive'").select("left", "right")
    comp = connected_components(strong, "left", "right").withColumnsRenamed({"id": "name", "component": "comp"})
    l, r = comp.withColumnsRenamed({"name": "left", "comp": "comp_l"}), comp.withColumnsRenamed({"name": "right", "comp": "comp_r"})
    inside = decisions.where("state <> 'unknown'").join(l, "left").join(r, "right").where("comp_l = comp_r")
    inside = inside.select(F.col("comp_l").alias("comp"), "left", "right", "state", "score")
    members = names.join(comp, F.col("filename") == F.col("name"))
    members = members.select("comp", F.col("filename").alias("left"), F.lit(None).cast("string").alias("right"), F.lit(None).cast("string").alias("state"), F.col("quality").cast("double").alias("score"))

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["right"].isna()]
        edges = pdf[pdf["right"].notna()]
        quality = dict(zip(own["left"], own["score"], strict=True))
        found = settle(sorted(quality), list(edges[["left", "right", "state", "score"]].itertuples(index=False, name=None)), quality, config)
        return pd.DataFrame({"filename": list(found), "group_id": list(found.values())})

    grouped = members.unionByName(inside).groupBy("comp").applyInPandas(rule, "filename string, group_id string")
    alone = names.join(comp, F.col("filename") == F.col("name"), "left_anti")
    return grouped.unionByName(singletons(alone))
