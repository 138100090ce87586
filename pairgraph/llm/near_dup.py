"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on full shingle sets.

Banding with K minhashes a key over L tables needs K * L hash functions. Here there are two collections of m
short keys, of r minhashes each, and the m * m tables take as key a pair of one key from each, so 2 * m * r
functions serve m * m tables of 2 * r minhashes. Two sets of similarity s meet in a table with probability
(1 - (1 - s^r)^m)^2: with r = 3 and m = 16 it is 0.99998 at s = 0.8 and above 0.9999999 at s = 0.9.

Equal sets are one node. Within a bucket nodes are compared with two leaders instead of with each other: the
one that meets most others in all tables, which stands in the middle of a group of edited copies, and the one of
the smallest id. What links merges. Buckets that still hold several components are settled exactly by prefix
filtering: of two sets over the threshold the rarest shingles of both must meet, early enough in either for the
rest to make up the overlap, so only such pairs are compared; a passage that thousands share isn't rare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgraph.llm import shingles as sh
from pairgraph.llm.common import small_batches
from pairgraph.operators.components import connected_components
from pairgraph.plans.store import discard, materialize


@dataclass(frozen=True)
class NearDup:
    """words: of a shingle. percent: sets are linked if 100 * common >= percent * all. collection: m. band: r."""

    words: int = 5
    percent: int = 80
    collection: int = 16
    band: int = 3
    seed: int = 1


def _sketcher(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 2 * p.collection * p.band
        mul, add = sh.constants(n, p.seed), sh.constants(n, p.seed + 1)
        part, place = sh.constants(p.band, p.seed + 2), sh.constants(2 * p.collection, p.seed + 3)
        for batch in batches:
            sizes, d0, d1, keys = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = sh.shingle_set(text, p.words)
                sizes.append(len(s))
                if not len(s):
                    d0.append(None), d1.append(None), keys.append(None)
                    continue
                a, b = sh.set_digest(s)
                d0.append(a), d1.append(b)
                least = sh.min_hashes(s, mul, add).reshape(-1, p.band)
                keys.append(sh.mix((least * part).sum(axis=1, dtype=np.uint64) + place).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "n", "d0", "d1", "keys"],
            )

    return run


def _setter(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                sets = [sh.shingle_set(t, words).tobytes() for t in piece.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = batch.column("left_set"), batch.column("right_set")
            for i in range(batch.num_rows):
                a = np.frombuffer(left[i].as_buffer(), np.uint64)
                b = np.frombuffer(right[i].as_buffer(), np.uint64)
                both = _common(a, b)
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, id_type: str, p: NearDup) -> DataFrame:
    """The pairs (src, dst) whose full sets pass."""
    left = sets.select(F.col("id").alias("src"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("id").alias("dst"), F.col("shingles").alias("right_set"))
    both = pairs.join(left, "src").join(right, "dst").select("src", "dst", "left_set", "right_set")
    return both.mapInArrow(_confirmer(p.percent), f"src {id_type}, dst {id_type}")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: NearDup = NearDup()) -> DataFrame:
    """Per row of docs: the id, n_shingles, component_id and kept.

    component_id is the smallest id reachable over links, its own included; kept says that it is the row's own
    id. Null and empty texts have no shingles and link with nothing; texts shorter than a shingle link with
    equal sequences only. Rows that share an id are one document, which links where any of its texts does.
    A row with a null id links with nothing: its component_id is null and it is kept. An empty table gives no
    rows; extra columns are ignored.
    """
    p, spark = params, docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    with small_batches(spark, 1000):
        sketch = materialize(
            narrow.mapInArrow(_sketcher(p), f"id {id_type}, n bigint, d0 bigint, d1 bigint, keys array<bigint>"), "nd-sketch"
        )
    known = sketch.where("d0 IS NOT NULL AND id IS NOT NULL")
    reps = materialize(known.groupBy("d0", "d1").agg(F.min("id").alias("rep")), "nd-reps")
    # rows that share an id tie their sets together
    several = known.groupBy("id").agg(F.min(F.struct("d0", "d1")).alias("a"), F.max(F.struct("d0", "d1")).alias("b")).where("a <> b")
    ties = (
        known.join(several.select("id"), "id")
        .join(reps, ["d0", "d1"])
        .select(F.col("rep").alias("src"), F.col("id").alias("dst"))
        .where("src <> dst")
    )
    nodes = known.join(reps, ["d0", "d1"]).where("id = rep").select("id", "n", "keys")

    tables = _tables(nodes, p)
    wanted = tables.select("id").distinct()
    with small_batches(spark, 1000):
        sets = materialize(narrow.join(wanted, "id").mapInArrow(_setter(p.words), f"id {id_type}, shingles binary"), "nd-sets")
    with small_batches(spark, 32):  # each row holds two whole sets
        links = materialize(_confirmed(_star_pairs(tables, p), sets, id_type, p).unionByName(ties), "nd-links")
    labels = materialize(connected_components(links), "nd-labels")
    with small_batches(spark, 32):
        more = materialize(_confirmed(_rest_pairs(tables, labels, sets, p), sets, id_type, p), "nd-links")
    if not more.isEmpty():
        stars = labels.select(F.col("id").alias("src"), F.col("component").alias("dst"))
        labels = materialize(connected_components(stars.unionByName(more)), "nd-labels")
    discard(tables, sets)

    of_set = sketch.join(reps, ["d0", "d1"], "left")
    named = of_set.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return named.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: NearDup = NearDup()) -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep; columns as they were.

    Of rows of one id, or of no id, with the same text one stays, any of them; rows of no id are compared with no others.
    """
    out = near_duplicates(docs, id_col=id_col, text_col=text_col, params=params)
    gone = materialize(out.where(~F.col("kept")).select(F.col(id_col).alias("gone_id")).distinct(), "nd-gone")
    left = docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
    keys = docs.select(F.col(id_col).alias("again_id"), F.xxhash64(F.col(text_col)).alias("again_hash"))
    again = materialize(keys.groupBy("again_id", "again_hash").count().where("count > 1"), "nd-again")
    if again.isEmpty():
        return left
    held = left.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("key"), F.xxhash64(F.col(text_col)).alias("hash"))
    held = held.join(again, held["key"].eqNullSafe(again["again_id"]) & (held["hash"] == again["again_hash"]), "left")
    held = materialize(held.select("row", "key", "hash", F.col("count").isNotNull().alias("again")), "nd-held")
    one = held.where("again").groupBy("key", "hash").agg(F.any_value("row").alias("row"))  # a row of each task at most is moved
    return held.where("NOT again").select("row").unionByName(one.select("row")).select("row.*")


def _tables(nodes: DataFrame, p: NearDup) -> DataFrame:
    """(key, id, n, leaders): the entries of all tables that hold two nodes or more, with their bucket's leaders.

    A node can meet another one in table (i, j) only if it meets one in key i of the first collection and in
    key j of the second, so pairs are formed of such keys only. leaders: array of structs (id, n).
    """
    each = nodes.select("id", "n", F.posexplode("keys").alias("no", "h"))
    shared = materialize(
        each.groupBy("h")
        .agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("size"))
        .where("a <> b")
        .select("h", "size"),
        "nd-shared",
    )
    first = F.col("no") < p.collection
    halves = (
        each.join(shared, "h")
        .groupBy("id", "n")
        .agg(
            F.collect_set(F.when(first, F.col("h"))).alias("one"),
            F.collect_set(F.when(~first, F.col("h"))).alias("two"),
            F.sum("size").alias("met"),
        )
    )
    halves = materialize(halves.where("size(one) > 0 AND size(two) > 0"), "nd-halves")
    keys = halves.select("id", "n", "met", F.explode("one").alias("x"), "two").select("id", "n", "met", "x", F.explode("two").alias("y"))
    keys = keys.select(F.xxhash64("x", "y").alias("key"), "id", "n", "met")
    leaders = materialize(
        keys.groupBy("key")
        .agg(F.min(F.struct("id", "n")).alias("low"), F.max(F.struct("met", "id", "n")).alias("mid"), F.max("id").alias("high"))
        .where("low.id <> high")
        .select("key", F.array("low", F.struct("mid.id", "mid.n")).alias("leaders")),
        "nd-leaders",
    )
    out = materialize(keys.drop("met").join(leaders, "key"), "nd-tables")
    discard(shared, halves, leaders)
    return out


def _star_pairs(tables: DataFrame, p: NearDup) -> DataFrame:
    """Each member of a bucket with its leaders, if the sizes allow a link."""
    return (
        tables.select("id", "n", F.explode("leaders").alias("lead"))
        .where(f"id <> lead.id AND 100 * least(n, lead.n) >= {p.percent} * greatest(n, lead.n)")
        .select(F.least("id", "lead.id").alias("src"), F.greatest("id", "lead.id").alias("dst"))
        .distinct()
    )


def _rest_pairs(tables: DataFrame, labels: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """All pairs over the threshold that may be left among nodes of buckets with several components.

    Shingles are ranked by how many of these nodes have them, rarest first. Two sets over the threshold have
    at least o = percent * (n + n') / (100 + percent) shingles in common, so the first one of these stands
    before place n - o + 1 in either set; that place is n - ceil(n * percent / 100) + 1 at most, as sizes differ.
    Shingles that no other node has make no pairs.
    """
    id_type = sets.schema["id"].dataType.simpleString()
    placed = tables.select("key", "id", "n").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_ = materialize(open_, "nd-open")
    unsettled = placed.join(open_, "key").select("id", "n", "component").distinct()
    tokens = materialize(
        unsettled.join(sets, "id").mapInArrow(_tokens, f"id {id_type}, n bigint, component {id_type}, token bigint"), "nd-tokens"
    )
    counts = materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "nd-counts")
    ranked = tokens.join(counts, "token", "left")
    prefix = (
        ranked.groupBy("id", "n", "component")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token"))).alias("t"))
        .select("id", "n", "component", F.posexplode(F.expr(f"slice(t, 1, cast(n - ceil(n * {p.percent} / 100.0) + 1 as int))")).alias("at", "t"))
        .where("t.df > 1")
        .select(F.col("t.token").alias("token"), "id", "n", "component", "at")
    )
    prefix = materialize(prefix, "nd-prefix")
    discard(open_, tokens, counts)
    b = prefix.select("token", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "component", "at")])
    need = f"{p.percent} * (n + n_b)"
    return (
        prefix.join(b, "token")
        .where("id < id_b AND component <> component_b")
        .where(f"{100 + p.percent} * (n - at) >= {need} AND {100 + p.percent} * (n_b - at_b) >= {need}")
        .select(F.col("id").alias("src"), F.col("id_b").alias("dst"))
        .distinct()
    )


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            tokens = np.frombuffer(row.column("shingles")[0].as_buffer(), np.int64)
            same = pa.array(np.zeros(len(tokens), np.int64))
            yield pa.RecordBatch.from_arrays(
                [row.column(c).take(same) for c in ("id", "n", "component")] + [pa.array(tokens)], ["id", "n", "component", "token"]
            )
