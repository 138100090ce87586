"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Each source gets a token target; whole epochs of a source come first, and what is left of its target is filled
with documents in the order of exponential keys -ln(u) / weight, so that better documents tend to come first. A
document's weight is the posterior probability of its being good that the quality rules give it.
The prefix sums that decide this are made without a task that holds a whole source: keys fall into buckets of
equal ratios, about sqrt(n) rows each however weights are spread, bucket totals are summed first, and the order within a
bucket is settled in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgraph.llm.common import text_of, unit_interval
from pairgraph.llm.quality_rules import fit_rules, pattern_counts, posterior_of, votes_of
from pairgraph.plans.store import materialize


def source_targets(
    sizes: DataFrame, *, cycle: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """One row for each source (source, source_size, n_docs) with its target.

    Sources in code-point order, null last, weigh cycle[0], cycle[1], ... again and again and divide share
    times all sizes; no target passes cap times its source's size, and the excess goes to the others by
    weight. That is water-filling: sources meet their cap in the order of cap / weight, so one pass over
    running sums finds the level that the rest share. The table has a row per source, never per document.
    """
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    s = (
        sizes.withColumn("rn", F.row_number().over(ordered) - 1)
        .withColumn("w", F.element_at(weights, (F.col("rn") % len(cycle) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(cap))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    )
    filling = Window.orderBy(F.col("cap") / F.col("w"), "rn")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn(
        "level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    ).withColumn("place", F.row_number().over(filling))
    open_ = F.col("cap") > F.col("level") * F.col("w")
    level = F.min(F.when(open_, F.struct("place", "level"))).over(everything)["level"]
    return s.withColumn("shared", level).select(
        "source",
        "source_size",
        "n_docs",
        F.when(F.col("shared").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("shared") * F.col("w")))
        .alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    cycle: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    least_weight: float = 0.01,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per document how many words the mix takes of it.

    Columns: the id, source, size, source_size, target, epochs (whole passes over the source), sample_key and
    taken, and before them the columns of docs named in carry; one of these that is named like a column of the mix
    comes back with _in behind its name. Words are counted with repeats; the document on which a source's target falls
    gives its first words only, so each source gives round(target) words. Null sources are one source; null or empty
    texts have size 0 and give 0; equal rows are mixed one by one; an empty table gives no rows. Extra columns are
    ignored. Keys depend on the id, the seed and the text's weight alone, and rows of equal keys go by their texts, so
    reruns agree. least_weight is that of documents that are surely bad.
    """
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        text_of(text_col).alias("text"),
        F.struct(F.lit(0), *[F.col(f"`{c}`") for c in carry]).alias("carried"),
    )
    table = materialize(
        votes_of(narrow).select(
            F.monotonically_increasing_id().alias("row_no"),  # settled by the writing
            "id",
            "source",
            F.col("f")["n_words"].alias("size"),
            "pattern",
            F.xxhash64("text").alias("text_hash"),
            "carried",
        ),
        "mix-rows",
    )
    weight = F.greatest(F.round(posterior_of(F.col("pattern"), fit_rules(pattern_counts(table))), 6), F.lit(least_weight))
    rows = table.drop("carried").withColumn("sample_key", -F.log(unit_interval(F.col("id"), seed)) / weight)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = materialize(source_targets(sizes, cycle=cycle, share=share, cap=cap), "mix-targets")
    t = targets.withColumnRenamed("source", "t_source")
    per_bucket = F.greatest(F.lit(100.0), F.sqrt(F.col("n_docs").cast("double")))
    dealt = rows.join(t, rows["source"].eqNullSafe(t["t_source"])).drop("t_source")
    # a doubling of the key holds about a quarter of the rows at most
    dealt = dealt.withColumn("bucket", F.floor(F.log2("sample_key") * F.ceil(F.col("n_docs") / per_bucket)))
    totals = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("source").alias("b_source"),
        F.col("bucket").alias("b_bucket"),
        F.coalesce(F.sum("bucket_size").over(by_source), F.lit(0)).alias("start"),
    )
    in_bucket = (
        Window.partitionBy("source", "bucket")
        .orderBy("sample_key", "id", "size", "text_hash")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = dealt.withColumn("upto", F.sum("size").over(in_bucket))
    placed = placed.join(
        starts, placed["source"].eqNullSafe(starts["b_source"]) & (placed["bucket"] == starts["b_bucket"])
    )
    whole = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) div source_size")).otherwise(F.lit(0))
    rest = whole - F.col("epochs") * F.col("source_size")
    first = F.col("start") + F.col("upto") - F.col("size")
    out = (
        placed.withColumn("epochs", epochs.cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - first)))
        .withColumn("taken", F.col("taken").cast("long"))
    )
    own = (id_col, source_col, "size", "source_size", "target", "taken", "epochs", "sample_key")
    if carry:  # what is carried meets its row at the end only
        kept = table.select(F.col("row_no").alias("carry_no"), "carried")
        out = out.join(kept, out["row_no"] == kept["carry_no"])
    return out.select(
        *[F.col("carried")[c].alias(n) for c, n in zip(carry, free_names(carry, own), strict=True)],
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        *own[2:],
    )


def free_names(names: Sequence[str], taken: Sequence[str]) -> list[str]:
    """The names, those that are taken (whatever their case) with _in behind them until they are free."""
    used = {t.lower() for t in taken}
    rest = {n.lower() for n in names} - used
    out = []
    for n in names:
        new = n
        while new.lower() in used or new != n and new.lower() in rest:
            new += "_in"
        used.add(new.lower())
        out.append(new)
    return out
