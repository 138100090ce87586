"""Candidate pairs: all pairs, pairs under a distance, and the top-k similarity join with boundary ties.

Descriptors are rows (filename, descriptor ARRAY<FLOAT or DOUBLE>, unit length or zeros). The joins work through
tiles: rows are dealt to blocks of bounded bytes, a task holds two blocks against each other in one matrix product and
keeps what may still be among the nearest. The driver sees no row and the plan doesn't grow; the number of tiles is the
square of the blocks', as an exact join of all rows needs, and a row is sent once for each block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distances are compared at this many decimals, so that equal ones tie whatever the order of a sum.
DECIMALS = 9
BLOCK_BYTES = 32 << 20


@dataclass(frozen=True)
class Screen:
    """all_pairs_max: up to so many rows every pair is a candidate. top_k: neighbours of each row above that."""

    all_pairs_max: int = 64
    top_k: int = 12

    def __post_init__(self):
        if type(self.all_pairs_max) is not int or type(self.top_k) is not int:
            raise ValueError("screen sizes must be integers")
        if self.all_pairs_max < 2 or self.top_k < 1:
            raise ValueError("all_pairs_max must be at least 2 and top_k at least 1")


@dataclass
class Candidates:
    """pairs (left, right), left < right; fallback: names without a descriptor; counters as reported."""

    pairs: DataFrame
    fallback: DataFrame
    mode: str
    valid: int
    total_pairs: int

    def counters(self) -> DataFrame:
        n = F.count(F.lit(1))
        return self.pairs.agg(n.alias("candidate_pair_count")).select(
            F.lit(self.mode).alias("mode"),
            F.lit(self.total_pairs).cast("long").alias("all_pair_count"),
            "candidate_pair_count",
            (F.col("candidate_pair_count") / F.lit(float(self.total_pairs)) if self.total_pairs else F.lit(0.0)).alias("candidate_pair_fraction"),
        )


def all_pairs(names: DataFrame, col: str = "filename") -> DataFrame:
    """Every unordered pair of distinct names, left < right. The result is quadratic by definition."""
    a = names.select(F.col(col).alias("left"))
    b = names.select(F.col(col).alias("right"))
    return a.join(b, F.col("left") < F.col("right"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances of unit rows, with the rule for empty vectors, rounded."""
    zero_a, zero_b = ~a.any(axis=1), ~b.any(axis=1)
    d = 1.0 - np.clip(a @ b.T, -1.0, 1.0)
    d[zero_a[:, None] ^ zero_b[None, :]] = 1.0
    d[zero_a[:, None] & zero_b[None, :]] = 0.0
    return np.round(d, DECIMALS)


def _n_blocks(rows: DataFrame, block_bytes: int) -> int:
    """Blocks of at most about so many bytes, and as many as give each core a tile at least."""
    size = rows.agg(F.sum(F.size("descriptor").cast("long"))).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(8 * size / block_bytes), math.isqrt(2 * cores))


def _tile(keep, piece_bytes: int = 16 << 20):
    """The rows of two blocks against each other, so many at once that their distances fill piece_bytes; keep(distances)
    says which entries of each row to return. Both directions are returned, l < r or not."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = ["l", "r", "distance"], (pa.string(), pa.string(), pa.float64())
        if not left.num_rows or not right.num_rows:  # a block without rows
            return pa.table([pa.array([], t) for t in types], names)
        own, other = (t.column(0).to_numpy() for t in (left, right))
        a, b = (t.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (left, right))
        same = left.column(2)[0].as_py() == left.column(3)[0].as_py()
        out: list[tuple] = []

        def one_way(mine, rows, others, matrix) -> None:
            step = max(1, piece_bytes // (8 * len(matrix)))
            for start in range(0, len(rows), step):
                d = distances(rows[start : start + step], matrix)
                d[mine[start : start + step, None] == others[None, :]] = np.inf  # not its own neighbour
                i, j = np.nonzero(keep(d))
                out.append((mine[start + i], others[j], d[i, j]))

        one_way(own, a, other, b)
        if not same:
            one_way(other, b, own, a)
        return pa.table([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _joined(vectors: DataFrame, keep, block_bytes: int) -> DataFrame:
    rows = vectors.select(F.col("filename").cast("string").alias("filename"), F.col("descriptor").cast("array<double>").alias("descriptor"))
    n = _n_blocks(rows, block_bytes)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("filename"), F.lit(n)).cast("int"))
    # a row stands left in the tiles of its block and later ones, and right in those of its block and earlier ones
    side = lambda i, j, c: dealt.select(F.col("filename").alias(f"{c}_name"), F.col("descriptor").alias(f"{c}_vector"), i.alias("i"), j.alias("j"))
    left = side(F.col("block"), F.explode(F.sequence("block", F.lit(n - 1))), "l")
    right = side(F.explode(F.sequence(F.lit(0), "block")), F.col("block"), "r")
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_tile(keep), "l string, r string, distance double")


def top_k_neighbours(vectors: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(l, r, distance): each row's k nearest others and all that tie with the k-th."""

    def keep(d: np.ndarray) -> np.ndarray:
        if d.shape[1] <= k:
            return np.isfinite(d)
        edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        return np.isfinite(d) & (d <= edge)

    found = _joined(vectors, keep, block_bytes)
    return found.withColumn("rank", F.rank().over(Window.partitionBy("l").orderBy("distance"))).where(F.col("rank") <= k).drop("rank")


def unordered(pairs: DataFrame) -> DataFrame:
    """Directed neighbours as unordered pairs, each once."""
    return pairs.select(F.least("l", "r").alias("left"), F.greatest("l", "r").alias("right")).distinct()


def pairs_within(vectors: DataFrame, threshold: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(left, right, distance) with distance <= threshold, left < right."""
    edge = threshold

    def keep(d: np.ndarray) -> np.ndarray:
        return d <= edge

    found = _joined(vectors, keep, block_bytes)
    return found.where("l < r").select(F.col("l").alias("left"), F.col("r").alias("right"), "distance")


def screen_candidates(images: DataFrame, screen: Screen = Screen()) -> Candidates:
    """Candidate pairs of images (filename, descriptor; null where an image can't be read).

    Up to all_pairs_max images descriptors aren't looked at. Above, images without one fall back to groups of
    their own, and top-k neighbours of the others are candidates; with k >= n - 1 that is every pair.
    """
    names = images.select("filename")
    stats = names.agg(F.count(F.lit(1)), F.countDistinct("filename")).first()
    if stats[0] != stats[1]:
        raise ValueError("candidate generation needs unique filenames")
    n = stats[0]
    if n <= screen.all_pairs_max:
        return Candidates(all_pairs(names), names.limit(0), "all_pairs", n, n * (n - 1) // 2)
    valid = images.where("descriptor IS NOT NULL")
    fallback = images.where("descriptor IS NULL").select("filename")
    n = valid.count()
    if screen.top_k >= n - 1:
        pairs = all_pairs(valid.select("filename"))
    else:
        pairs = unordered(top_k_neighbours(valid, screen.top_k))
    return Candidates(pairs, fallback, "structural_top_k", n, n * (n - 1) // 2)


def check_pairs(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Violations (left, right, problem) of a candidate list: self pairs, unknown names, repeated pairs."""
    p = pairs.select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"))
    known = names.select(F.col("filename").alias("known"))
    selfs = p.where("a = b").withColumn("problem", F.lit("self_pair"))
    strange = p.select("a", "b", F.explode(F.array("a", "b")).alias("name")).join(known, F.col("name") == F.col("known"), "left_anti")
    repeated = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return (
        selfs.unionByName(strange.drop("name").withColumn("problem", F.lit("unknown_name")))
        .unionByName(repeated.withColumn("problem", F.lit("repeated_pair")))
        .withColumnsRenamed({"a": "left", "b": "right"})
    )


def orient(pairs: DataFrame) -> DataFrame:
    """Pairs with left_hash and right_hash, turned so that (hash, name) ascends."""
    turned = F.struct("right_hash", "right") < F.struct("left_hash", "left")
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    return pairs.select(
        pick("left", "right").alias("left"),
        pick("right", "left").alias("right"),
        pick("left_hash", "right_hash").alias("left_hash"),
        pick("right_hash", "left_hash").alias("right_hash"),
    )
