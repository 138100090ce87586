"""Partitions (filename, group_id): validation, canonical form, scoring and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgraph.functions.text import valid_filename
from pairgraph.operators.components import connected_components
from pairgraph.operators.decisions import POSITIVE
from pairgraph.plans.numbering import dense_numbers


def violations(partition: DataFrame, expected: DataFrame) -> DataFrame:
    """(problem, filename) of a partition against the names expected; none if it is valid."""
    p, e = partition.select("filename", "group_id"), expected.select("filename")
    say = lambda df, what: df.select(F.lit(what).alias("problem"), "filename")
    twice = lambda df: df.groupBy("filename").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        say(twice(p), "duplicate")
        .unionByName(say(twice(e), "duplicate_expected"))
        .unionByName(say(e.join(p, "filename", "left_anti").distinct(), "missing"))
        .unionByName(say(p.join(e, "filename", "left_anti").distinct(), "unexpected"))
        .unionByName(say(p.where("group_id IS NULL OR group_id = ''"), "empty_group"))
        .unionByName(say(p.where(~valid_filename(F.col("filename"))), "bad_name"))
    )


def validate(partition: DataFrame, expected: DataFrame) -> None:
    found = violations(partition, expected).limit(5).collect()
    if found:
        raise ValueError("invalid partition: " + ", ".join(f"{r['problem']} {r['filename']!r}" for r in found))


def group_sets(partition: DataFrame) -> DataFrame:
    """(group_id, members, size): the sorted members of each group."""
    return partition.groupBy("group_id").agg(F.array_sort(F.collect_list("filename")).alias("members")).withColumn("size", F.size("members"))


def canonical(partition: DataFrame) -> DataFrame:
    """(filename, group_no): groups numbered from 0 in the order of their sorted members.

    Groups are disjoint, so their smallest members alone give that order.
    """
    heads = partition.groupBy("group_id").agg(F.min("filename").alias("head"))
    numbered = heads.join(dense_numbers(heads, "head", "group_no"), "head").select("group_id", "group_no")
    return partition.join(numbered, "group_id").select("filename", "group_no")


def size_distribution(partition: DataFrame) -> DataFrame:
    """(size, n_groups)."""
    return partition.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def overlaps(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """(ref_id, pred_id, overlap, ref_size, pred_size): groups that share names."""
    r = reference.select("filename", F.col("group_id").alias("ref_id"))
    p = predicted.select("filename", F.col("group_id").alias("pred_id"))
    sizes = lambda df, key, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = r.join(p, "filename").groupBy("ref_id", "pred_id").agg(F.count(F.lit(1)).alias("overlap"))
    return both.join(sizes(r, "ref_id", "ref_size"), "ref_id").join(sizes(p, "pred_id", "pred_size"), "pred_id")


def group_outcomes(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """(ref_id, ref_size, touched, exact, split, merged) of each reference group.

    split: its names lie in several predicted groups; merged: one of those holds a name from elsewhere.
    """
    return (
        overlaps(reference, predicted)
        .groupBy("ref_id", "ref_size")
        .agg(F.count(F.lit(1)).alias("touched"), F.max(F.col("pred_size") > F.col("overlap")).alias("merged"))
        .withColumn("split", F.col("touched") > 1)
        .withColumn("exact", ~F.col("split") & ~F.col("merged"))
    )


def score(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row of exact-group metrics; an empty reference or prediction scores 1."""
    o = group_outcomes(reference, predicted)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    single = F.col("ref_size") == 1
    exact = F.col("exact")
    r = o.agg(
        count(exact).alias("exact_matches"),
        F.count(F.lit(1)).alias("total_reference_groups"),
        count(exact & single).alias("singleton_exact_matches"),
        count(single).alias("singleton_reference_groups"),
        count(exact & ~single).alias("non_singleton_exact_matches"),
        count(~single).alias("non_singleton_reference_groups"),
        count(F.col("merged")).alias("merge_damaged_reference_groups"),
        count(F.col("split")).alias("split_reference_groups"),
    ).withColumn("one", F.lit(1))
    p = (
        predicted.groupBy("group_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count(F.lit(1)).alias("predicted_groups"), count(F.col("n") == 1).alias("predicted_singletons"))
        .withColumn("one", F.lit(1))
    )
    share = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b))
    return (
        r.join(p, "one")
        .drop("one")
        .withColumn("exact_group_score", share("exact_matches", "total_reference_groups"))
        .withColumn("predicted_exact_group_precision", share("exact_matches", "predicted_groups"))
    )


def diagnose(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """(reference_group, failure_types, predicted_groups) of each reference group that isn't exact."""
    bad = group_outcomes(reference, predicted).where("NOT exact")
    refs = group_sets(reference).select(F.col("group_id").alias("ref_id"), F.col("members").alias("reference_group"))
    preds = group_sets(predicted).select(F.col("group_id").alias("pred_id"), F.col("members").alias("pred_members"))
    touched = (
        overlaps(reference, predicted)
        .join(bad.select("ref_id", "split", "merged"), "ref_id")
        .join(preds, "pred_id")
        .groupBy("ref_id", "split", "merged")
        .agg(F.array_sort(F.collect_list("pred_members")).alias("predicted_groups"))
    )
    types = F.array_compact(F.array(F.when(F.col("split"), F.lit("split")), F.when(F.col("merged"), F.lit("merge"))))
    return touched.join(refs, "ref_id").select("reference_group", types.alias("failure_types"), "predicted_groups")


def labelled_pairs(decisions: DataFrame, reference: DataFrame) -> DataFrame:
    """Decisions with same_group by the reference; both names must be in it."""
    l = reference.select(F.col("filename").alias("left"), F.col("group_id").alias("left_group"))
    r = reference.select(F.col("filename").alias("right"), F.col("group_id").alias("right_group"))
    return decisions.join(l, "left").join(r, "right").withColumn("same_group", F.col("left_group") == F.col("right_group"))


def check_decisions(decisions: DataFrame, reference: DataFrame, *, complete: bool = True) -> None:
    """Raise unless decisions name reference names only, each unordered pair once, and all pairs if complete."""
    names = reference.select("filename")
    ends = decisions.select(F.explode(F.array("left", "right")).alias("filename"))
    if not ends.join(names, "filename", "left_anti").isEmpty():
        raise ValueError("decisions name files outside the reference")
    pairs = decisions.select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"))
    if not pairs.where("a = b").isEmpty() or not pairs.groupBy("a", "b").count().where("count > 1").isEmpty():
        raise ValueError("decisions hold a self pair or a pair twice")
    if complete:
        n = names.count()
        if pairs.count() != n * (n - 1) // 2:
            raise ValueError("decisions don't cover every pair")


def pair_diagnostics(decisions: DataFrame, reference: DataFrame) -> DataFrame:
    """One row of counts, precision and recall of decisions against the reference."""
    x = labelled_pairs(decisions, reference)
    pos, neg, same = F.col("state").isin(*POSITIVE), F.col("state") == "negative", F.col("same_group")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    t = x.agg(
        F.count(F.lit(1)).alias("pair_count"),
        count(same).alias("same_group_pair_count"),
        count(~same).alias("different_group_pair_count"),
        *[
            count((F.col("state") == s) & (same if label == "same" else ~same)).alias(f"{label}_{s}")
            for label in ("same", "different")
            for s in ("strong_positive", "positive", "negative", "unknown")
        ],
        count(pos & same).alias("_sp"),
        count(pos).alias("_p"),
        count(neg & ~same).alias("_dn"),
        count(neg).alias("_n"),
    ).withColumn("one", F.lit(1))
    sizes = reference.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    e = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("names"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("_same_pairs"))
    e = e.select(F.lit(1).alias("one"), F.expr("names * (names - 1) div 2").alias("all_pair_count"), "_same_pairs")
    share = lambda a, b, empty=1.0: F.when(F.col(b) == 0, empty).otherwise(F.col(a) / F.col(b))
    out = t.join(e, "one").withColumn("_known", F.col("_p") + F.col("_n"))
    return (
        out.withColumn("candidate_pair_fraction", share("pair_count", "all_pair_count", 0.0))
        .withColumn("candidate_same_group_pair_recall", share("same_group_pair_count", "_same_pairs"))
        .withColumn("positive_pair_precision", share("_sp", "_p"))
        .withColumn("same_group_positive_recall", share("_sp", "same_group_pair_count"))
        .withColumn("negative_pair_precision", share("_dn", "_n"))
        .withColumn("different_group_negative_recall", share("_dn", "different_group_pair_count"))
        .withColumn("known_state_coverage", share("_known", "pair_count"))
        .drop("one", "_sp", "_p", "_dn", "_n", "_known", "_same_pairs")
    )


def diagnostic_examples(decisions: DataFrame, reference: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """The first n false positives and the first n missed pairs, strong ones first and then by falling score."""
    x = labelled_pairs(decisions, reference).drop("left_group", "right_group")
    order = [(F.col("state") != "strong_positive").cast("int"), F.desc("score"), "left", "right"]
    positive = F.col("state").isin(*POSITIVE)
    pick = lambda c: x.where(c).drop("same_group").orderBy(*order).limit(n)
    return pick(positive & ~F.col("same_group")), pick(~positive & F.col("same_group"))


def connectivity(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """(connected_groups, total_groups): reference groups whose names the candidate pairs within them connect."""
    inside = labelled_pairs(pairs, reference).where("same_group").select("left", "right")
    comp = connected_components(inside, "left", "right").withColumnRenamed("id", "filename")
    labelled = reference.join(comp, "filename", "left").withColumn("component", F.coalesce("component", "filename"))
    parts = labelled.groupBy("group_id").agg(F.count_distinct("component").alias("parts"))
    return parts.agg(F.coalesce(F.sum((F.col("parts") == 1).cast("long")), F.lit(0)).cast("long").alias("connected_groups"), F.count(F.lit(1)).alias("total_groups"))
