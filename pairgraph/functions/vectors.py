"""Column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 1e-8
SPLIT = 134217729.0  # 2^27 + 1 parts a double into halves of 26 bits


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its length; a vector of no length stays zeros."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n <= ZERO, 0.0).otherwise(x / n)))[0]


def cosine_distance(a: Column, b: Column, a_zero: Column, b_zero: Column, similarity: Column | None = None) -> Column:
    """1 - cosine of unit vectors, clipped; two empty vectors are alike, one is unlike anything else."""
    s = dot(a, b) if similarity is None else similarity
    plain = F.lit(1.0) - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s))
    return F.when(a_zero & b_zero, 0.0).when(a_zero | b_zero, 1.0).otherwise(plain)


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def root_weights(v: Column) -> Column:
    """Square roots of a non-negative vector over its sum (at least 1e-12)."""
    return F.transform(F.array(F.greatest(total(v), F.lit(1e-12))), lambda s: F.transform(v, lambda x: F.sqrt(x / s)))[0]


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once: Dekker's product and Knuth's sum keep what plain steps lose (factors under 1e300)."""

    def high(x: Column) -> Column:
        return x * SPLIT - (x * SPLIT - x)

    def rest(s: Column) -> Column:
        a_low, b_low = s["a"] - s["ah"], s["b"] - s["bh"]
        of_product = ((s["ah"] * s["bh"] - s["p"]) + s["ah"] * b_low + a_low * s["bh"]) + a_low * b_low
        z = s["s"] - s["p"]
        return s["s"] + F.nanvl((s["p"] - (s["s"] - z)) + (s["c"] - z) + of_product, F.lit(0.0))

    parts = F.struct(
        a.alias("a"), b.alias("b"), c.alias("c"), high(a).alias("ah"), high(b).alias("bh"), (a * b).alias("p"), (a * b + c).alias("s")
    )
    return F.transform(F.array(parts), rest)[0]


def percentile_of(v: Column, percent: float, weighted: bool = False) -> Column:
    """Percentile of an array with linear interpolation between neighbours; nulls are left out.

    A place d after the low neighbour is low + (high - low) * d, or low * (1 - d) + high * d if weighted, the sum
    rounded once. They differ in the last bit; the second is that of DuckDB's quantile_cont.
    """

    def between(b: Column) -> Column:
        if not weighted:
            return b["low"] + (b["high"] - b["low"]) * b["d"]
        return F.when(b["d"] == 0, b["low"]).otherwise(fused(b["low"], 1 - b["d"], b["high"] * b["d"]))

    def at(s: Column) -> Column:
        place = F.lit(percent / 100.0) * (F.size(s) - 1)
        low = F.floor(place).cast("int")
        high = F.least(low + 1, F.size(s) - 1)
        b = F.struct(F.get(s, low).alias("low"), F.get(s, high).alias("high"), (place - low).alias("d"))
        return F.transform(F.array(b), between)[0]

    return F.transform(F.array(F.array_sort(F.array_compact(v))), at)[0]


def stretch(v: Column, low: float, high: float, levels: int | None = 255, weighted: bool = False) -> Column:
    """Values between two percentiles spread over 0..levels and rounded half to even; levels None: over 0..1.

    A flat range (at most 1e-12) gives the values as they were; a null counts as the lowest. weighted is that of
    percentile_of.
    """
    if not 0 <= low < high <= 100:
        raise ValueError("percentiles must satisfy 0 <= low < high <= 100")

    def spread(b: Column) -> Column:
        span = b["hi"] - b["lo"]

        def one(x: Column) -> Column:
            share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - b["lo"]) / span))
            return F.rint(share * levels) if levels else share

        return F.when(span <= 1e-12, v).otherwise(F.transform(v, one))

    bounds = F.struct(percentile_of(v, low, weighted).alias("lo"), percentile_of(v, high, weighted).alias("hi"))
    return F.transform(F.array(bounds), spread)[0]


def soft_bins(angle: Column, bins: int) -> Column:
    """Weights of an angle (in bin widths, circular) on each orientation bin."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda b: F.greatest(F.lit(0.0), 1.0 - F.least(F.abs(angle - b), bins - F.abs(angle - b))),
    )


def pearson(a: Column, b: Column) -> Column:
    """Correlation clipped to [-1, 1]; null where either side is flat."""

    def of(s: Column) -> Column:
        va, vb = s["aa"] - s["a"] * s["a"] / s["n"], s["bb"] - s["b"] * s["b"] / s["n"]
        r = (s["ab"] - s["a"] * s["b"] / s["n"]) / F.sqrt(va * vb)
        return F.when((va > 1e-12) & (vb > 1e-12), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))

    sums = F.struct(
        F.size(a).cast("double").alias("n"), total(a).alias("a"), total(b).alias("b"), dot(a, a).alias("aa"), dot(b, b).alias("bb"), dot(a, b).alias("ab")
    )
    return F.transform(F.array(sums), of)[0]


def sign_hash(v: Column) -> Column:
    """Bits of whether each value is over the one before, as a string of 0 and 1."""
    return F.array_join(
        F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda i: F.when(F.get(v, i) > F.get(v, i - 1), "1").otherwise("0")), ""
    )
