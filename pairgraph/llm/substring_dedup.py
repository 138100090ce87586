"""Repeated lines and sentences: hash normalised units, keep the first occurrence, cut the others out.

A unit is a line, or each sentence of a line that holds several. It is normalised (lower case, ASCII punctuation and
white space to single spaces) and hashed to 128 bits; digests are grouped over the whole corpus with partial
aggregates, and the occurrence of the lowest rank is the one that stays. Of the others those are cut that belong to
a repeated passage: units that follow each other in a document and are all repeated make one, and it is cut
when it reaches a number of words. A short unit recurs by chance and counts only where its first occurrence stands next to
that of its neighbour as well; what counts must be half of the words at least. So a passage is found whether it stands in one long line, in many short ones or in
the middle of a line, and a phrase of a few words that recurs by itself stays where it is. Offsets are those of the
original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgraph.llm.common import small_batches
from pairgraph.plans.store import discard, materialize

#: ASCII punctuation and white space separate words; every character beyond ASCII belongs to one.
_TABLE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_BREAK = re.compile(r"[.!?…]+(?=[\x20\x09-\x0D])|[。！？]+|\n")
_SPACE = " \t\n\v\f\r"


@dataclass(frozen=True)
class Units:
    """least_words, least_chars: a repeated passage is cut if it reaches so many words, or so many code points (for
    scripts without spaces). short_words, short_chars: a unit under both is short. With all of them 1 every repeated unit
    is cut, whatever its length."""

    least_words: int = 20
    least_chars: int = 160
    short_words: int = 4
    short_chars: int = 24


def units_of(text: str | None) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit in order, offsets in code points without outer white space.

    Units without any word (rules, lone brackets) are none.
    """
    if not text:
        return
    low = text.lower()
    if len(low) != len(text):  # a few letters get longer
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    at = 0
    for end in [m.end() for m in _BREAK.finditer(low)] + [len(low)]:
        part = low[at:end]
        words = part.encode("utf-8", "replace").translate(_TABLE).split()
        if words:
            yield end - len(part.lstrip(_SPACE)), at + len(part.rstrip(_SPACE)), len(words), xxhash.xxh3_128_digest(b" ".join(words))
        at = end


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "row", "no", "start", "end", "words", "digest"]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            piece = batch.slice(at, 500)
            rows = [(i, no, *u) for i, text in enumerate(piece.column(2).to_pylist()) for no, u in enumerate(units_of(text))]
            i, no, start, end, words, digest = zip(*rows, strict=True) if rows else ((),) * 6
            take = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(take), piece.column(1).take(take)]
                + [pa.array(x, pa.int32()) for x in (no, start, end, words)]
                + [pa.array(digest, pa.binary())],
                names,
            )


def repeated_units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each unit that isn't the first of its digest: id, row (a hash of the text), no (the unit's place in
    it), start, end, words, first_id, first_start, first_no.

    Occurrences rank by id and then by offset. Rows that share an id are one document: units at the same
    offset are the same occurrence. Null ids rank before all others. Null and empty texts have no units; an
    empty table gives no rows; extra columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).cast("string").alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    cut = narrow.mapInArrow(_cutter, f"id {id_type}, row bigint, no int, start int, end int, words int, digest binary")
    rank = F.struct("id", "start", "no")
    with small_batches(docs.sparkSession, 1000):
        firsts = cut.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("NOT first <=> last")
        firsts = materialize(firsts.select("digest", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("id", "start", "no")]), "sd-firsts")
        again = cut.join(firsts, "digest").where("NOT (id <=> first_id AND start = first_start)").drop("digest")
        out = materialize(again, "sd-again")
    discard(firsts)
    return out.withColumnRenamed("id", id_col)


def _passages(p: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, counts, firsts = [], [], []
            for units in batch.column(2).to_pylist():  # sorted by place
                out, n, ids = [], 0, []
                for a, b in _runs([u["no"] for u in units]):
                    count = [u for i, u in enumerate(units[a:b], a) if _counts(u, units[max(a, i - 1) : min(b, i + 2)], p)]
                    words = sum(u["words"] for u in count)
                    if 2 * words < sum(u["words"] for u in units[a:b]):
                        continue
                    if words >= p.least_words or sum(u["end"] - u["start"] for u in count) >= p.least_chars:
                        out.append({"start": units[a]["start"], "end": units[b - 1]["end"]})
                        n += b - a
                        ids += [u["first_id"] for u in units[a:b]]
                spans.append(out)
                counts.append(n)
                firsts.append(sorted({x for x in ids if x is not None}) + [None] * (None in ids))
            types = [pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64(), pa.list_(batch.schema.field(0).type)]
            cols = [batch.column(0), batch.column(1)] + [pa.array(v, t) for v, t in zip((spans, counts, firsts), types, strict=True)]
            found = pa.RecordBatch.from_arrays(cols, ["id", "row", "spans", "n_units", "first_ids"])
            yield found.filter(pa.array([n > 0 for n in counts], pa.bool_()))

    return run


def _counts(unit: dict, around: list[dict], p: Units) -> bool:
    """Whether a unit is long, or stands first where one of those around it does as well."""
    if unit["words"] >= p.short_words or unit["end"] - unit["start"] >= p.short_chars:
        return True
    return any(v["first_id"] == unit["first_id"] and v["first_no"] - unit["first_no"] == v["no"] - unit["no"] != 0 for v in around)


def _runs(numbers: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of indexes over which ascending numbers follow each other."""
    a = 0
    for i in range(1, len(numbers) + 1):
        if i == len(numbers) or numbers[i] != numbers[i - 1] + 1:
            yield a, i
            a = i


def cut_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", units: Units = Units()) -> DataFrame:
    """Per text that loses something: id, row (a hash of the text), spans (structs of start and end, sorted), n_units
    (in them) and first_ids (where they stand first, sorted, null last).

    Equal rows of one id are one. As in repeated_units otherwise.
    """
    found = repeated_units(docs, id_col=id_col, text_col=text_col).withColumnRenamed(id_col, "id")
    unit = F.struct("no", "start", "end", "words", "first_id", "first_no")
    grouped = found.groupBy("id", "row").agg(F.sort_array(F.collect_set(unit)).alias("units"))
    id_type = found.schema["id"].dataType.simpleString()
    with small_batches(docs.sparkSession, 1000):
        spans = materialize(
            grouped.mapInArrow(_passages(units), f"id {id_type}, row bigint, spans array<struct<start:int,end:int>>, n_units bigint, first_ids array<{id_type}>"),
            "sd-spans",
        )
    return spans.withColumnRenamed("id", id_col)


def _without(text: str, spans: list[dict]) -> str:
    edges = [0] + [x for s in spans for x in (s["start"], s["end"])] + [len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", units: Units = Units()) -> DataFrame:
    """docs with repeated passages cut out of the text; columns and rows otherwise as they were."""
    spans = cut_spans(docs, id_col=id_col, text_col=text_col, units=units).select(F.col(id_col).alias("cut_id"), F.col("row").alias("cut_row"), "spans")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("key"), F.xxhash64(F.col(text_col)).alias("hash"))
    same = held["key"].eqNullSafe(spans["cut_id"]) & (held["hash"] == spans["cut_row"])
    joined = held.join(spans, same, "left").select("doc", "spans")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.column(0).flatten()
            texts = [t if s is None else _without(t, s) for t, s in zip(cols[at].to_pylist(), batch.column(1).to_pylist(), strict=True)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    with small_batches(docs.sparkSession, 1000):
        return materialize(joined.mapInArrow(run, docs.schema), "sd-clean")
