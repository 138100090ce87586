"""What several of the text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgraph.plans.store import small_batches

__all__ = ["WORD", "let", "running", "small_batches", "table", "text_of", "unit_interval", "words_of"]

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, fold: Callable[[Column, Column], Column], zero: Column, chunk: int = 64) -> Column:
    """For each value the fold of all before it, beginning with zero; fold must not mind how its arguments are grouped.

    Chunks are folded first and then what is before a value in its chunk, as an array that grew by one value at a time
    would be copied as often.
    """

    def worked(v: Column) -> Column:
        n = F.size(v)

        def folded(at: Column, size: Column) -> Column:
            return F.aggregate(F.slice(v, at + 1, size), zero, fold)

        heads = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda c: folded(c * chunk, F.lit(chunk)))
        bases = F.aggregate(heads, F.array(zero), lambda acc, x: F.concat(acc, F.array(fold(F.element_at(acc, -1), x))))
        place = lambda b, i, c: fold(b[c], folded(c * chunk, i % chunk))
        by_place = let(bases, lambda b: F.transform(F.sequence(F.lit(0), n - 1), lambda i: place(b, i, F.floor(i / chunk).cast("int"))))
        return F.when(n > 0, by_place).otherwise(F.slice(F.array(zero), 1, 0))

    return let(values, worked)


def unit_interval(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed only: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
