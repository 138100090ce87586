"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and pairs of words are hashed into a fixed number of buckets. Two bags of buckets are counted, over the
texts labelled as target and over all texts, and a document's log weight is the sum over its n-grams of the log
ratio of the two models. Adding independent Gumbel noise and taking the k largest samples k documents without
replacement in proportion to the weights. The k-th largest key is found by counting leading bits, sixteen at a
time, so no task sorts the documents. Of the texts only those go through a join that a bitmap of hashed target ids, of
fixed size, lets pass; it loses none of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgraph.llm import shingles as sh
from pairgraph.llm.common import small_batches, unit_interval
from pairgraph.plans.store import discard, materialize


@dataclass(frozen=True)
class Importance:
    """buckets: of the hashed models. share: of the documents to sample; None: the share of target rows among
    labelled ones. smooth: added to each bucket's count."""

    buckets: int = 10_000
    share: float | None = None
    smooth: float = 1.0
    seed: str = "gumbel"


def buckets_of(text: str | None, n: int) -> np.ndarray:
    """Buckets of the words and word pairs of a text, in lower case."""
    words = sh.word_hashes((text or "").lower().encode("utf-8", "replace"))
    both = np.concatenate([sh.ngram_hashes(words, 1), sh.ngram_hashes(words, 2)])
    return (both % np.uint64(n)).astype(np.int64)


def count_ngrams(texts: DataFrame, p: Importance) -> np.ndarray:
    """Counts by bucket over all rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(buckets_of(text, p.buckets), minlength=p.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(p.buckets)
    with small_batches(texts.sparkSession, 1000):
        counted = texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    for bucket, n in counted:
        out[bucket] = n
    return out


#: Bits of the number of a bitmap's word; the bitmap has 2 ** WORD_BITS words of 64 bits, whatever it holds.
WORD_BITS = 17


def _slot(key: Column) -> tuple[Column, Column]:
    """The word and the bit of a key's hash in the bitmap."""
    h = F.xxhash64(key)
    return F.shiftrightunsigned(h, 64 - WORD_BITS), F.shiftrightunsigned(h, 64 - WORD_BITS - 6).bitwiseAND(F.lit(63)).cast("int")


def rows_with(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ids, which are distinct. Rows that a bitmap of the ids excludes are never shuffled."""
    word, bit = _slot(F.col("id"))
    bitmap = ids.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("one")).groupBy("word").agg(F.bit_or("one").alias("ones"))
    near = rows.withColumn("word", word).join(F.broadcast(bitmap), "word")  # 2 ** WORD_BITS rows of the bitmap at most
    near = near.where(F.call_function("shiftrightunsigned", F.col("ones"), bit).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)
    return near.join(ids.hint("merge"), "id").select(*rows.columns)  # a semi join would be moved before the bitmap


def log_ratios(raw: np.ndarray, target: np.ndarray, p: Importance) -> np.ndarray:
    if not target.sum():
        return np.zeros(p.buckets)
    a, b = target + p.smooth, raw + p.smooth
    return np.log(a / a.sum()) - np.log(b / b.sum())


def kth_largest(keys: DataFrame, k: int) -> tuple[int | None, int]:
    """The k-th largest of the longs in column order_key, and how many of the rows equal to it are among the k.

    Each step counts sixteen more leading bits, so at most 65,536 counts come to the driver. None: no row.
    """
    if k <= 0:
        return None, 0
    low, left = 0, k
    for shift in (48, 32, 16, 0):
        head = F.shiftright("order_key", shift)
        part = keys if shift == 48 else keys.where(F.shiftright("order_key", shift + 16) == low)
        counts = sorted(((r[0], r[1]) for r in part.groupBy(head.alias("h")).count().collect()), reverse=True)
        for value, n in counts:
            if left <= n:
                low = value
                break
            left -= n
        else:
            return (counts[-1][0] if counts and shift == 0 else -(2**63)), 0  # fewer than k rows
    return low, left


def _first_of(tied: DataFrame, n: int) -> DataFrame:
    """The rows, all of one key, with kept for the n first by id. Rows of one id count by the task that wrote them, so a
    row that is repeated without end is not sorted in one place."""
    counts = tied.groupBy("id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("id", "part").rowsBetween(Window.unboundedPreceding, -1)
    quota = counts.select(F.col("id").alias("q_id"), F.col("part").alias("q_part"), (n - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("quota"))
    place = F.row_number().over(Window.partitionBy("id", "part").orderBy("log_weight"))
    both = tied.withColumn("place", place).join(quota, F.col("id").eqNullSafe(F.col("q_id")) & (F.col("part") == F.col("q_part")))
    return both.withColumn("kept", F.col("place") <= F.col("quota")).select(*tied.columns, "kept")


def resample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    params: Importance = Importance(),
) -> DataFrame:
    """Per row of docs: the id, log_weight, sample_key and kept (among the k sampled).

    k is the share of all rows, rounded. Null and empty texts have log weight 0; a null id has noise of its own
    and is never a target; ties at the k-th key go by id; equal rows have equal keys and are sampled one by one.
    Without target rows all weights are 0. An empty table gives no rows; extra columns are ignored.
    """
    p = params
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    share = p.share
    if share is None:
        good, known = named.agg(F.sum((F.col("y") == 1).cast("long")), F.count(F.lit(1))).first()
        share = (good or 0) / known if known else 1.0
    wanted = materialize(named.where("y = 1").select("id"), "importance-target")
    ratios = log_ratios(count_ngrams(narrow.select("text"), p), count_ngrams(rows_with(narrow, wanted).select("text"), p), p)
    discard(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.array([ratios[buckets_of(t, p.buckets)].sum() for t in batch.column(1).to_pylist()], np.float64)
            key = np.round(weight, 9) - np.log(-np.log(batch.column(2).to_numpy()))
            bits = key.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(weight), pa.array(key), pa.array(bits ^ ((bits >> 63) & np.int64(2**63 - 1)))],
                ["id", "log_weight", "sample_key", "order_key"],
            )

    id_type = narrow.schema["id"].dataType.simpleString()
    drawn = narrow.select("id", "text", unit_interval(F.col("id"), p.seed).alias("u"))
    with small_batches(docs.sparkSession, 1000):
        drawn = drawn.mapInArrow(run, f"id {id_type}, log_weight double, sample_key double, order_key bigint")
        scored = materialize(drawn.withColumn("part", F.spark_partition_id()), "importance")  # a row's part is settled by the writing
    k = round(share * scored.count())
    edge, of_edge = kth_largest(scored, k)
    if edge is None:
        out = scored.withColumn("kept", F.lit(False))
    else:
        at_edge = _first_of(scored.where(F.col("order_key") == edge), of_edge)
        out = scored.where(F.col("order_key") != edge).withColumn("kept", F.col("order_key") > edge).unionByName(at_edge)
    return out.select(F.col("id").alias(id_col), "log_weight", "sample_key", "kept")
