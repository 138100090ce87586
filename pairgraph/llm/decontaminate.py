"""Benchmark decontamination: rare n-gram seeds find where test items may stand, Smith-Waterman scores them.

Test items are taken in blocks of bounded size, so what goes to every executor is bounded however long the
benchmark is. For a block, one pass counts in how many documents each of its n-grams occurs. Rare ones are an item's
seeds, and where all of several successive ones are frequent the rarest of them is; n-grams that occur in no document
are none. So any copied run of ngram + window - 1 words holds a seed whatever the counts are, and a phrase of everyday
words doesn't lead every document to every item. A second pass looks seeds up in each document and aligns the item
with the words around them. Words are hashed to 64 bits, a text at a time. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgraph.llm import shingles as sh
from pairgraph.llm.common import small_batches
from pairgraph.plans.store import materialize

#: ASCII punctuation separates words like white space does.
_TABLE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_U = np.uint64
_BITS = 22


@dataclass(frozen=True)
class Decontamination:
    """ngram: words of a seed. rare, rare_rows: an n-gram in at most this share of all documents, or in at most so
    many, is rare. window: successive n-grams of which the rarest is a seed although it is frequent. share: least
    alignment score by the item's words. least: least score. enough: a score that passes whatever the item's length.
    block_words: words of the items that are handled at once."""

    ngram: int = 3
    rare: float = 0.001
    rare_rows: int = 100
    window: int = 4
    share: float = 0.4
    least: int = 8
    enough: int = 50
    block_words: int = 2_000_000


def _normal(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_TABLE) if text else b""


def words_of(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    return sh.word_hashes(_normal(text))


class Block:
    """Some test items with their n-grams and, once chosen, seeds. Items of fewer words than an n-gram are short: they
    match lines that are equal."""

    def __init__(self, items: list[tuple[object, str]], p: Decontamination):
        self.p = p
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.codes = [sh.ngram_hashes(w, p.ngram) for w in self.words]
        self.grams = np.unique(np.concatenate([np.empty(0, _U), *self.codes]))
        self.marks = self._marks(self.grams)
        self.short: dict[tuple[int, ...], list[int]] = {}
        for no, w in enumerate(self.words):
            if 0 < len(w) < p.ngram:
                self.short.setdefault(tuple(w.tolist()), []).append(no)

    @staticmethod
    def _marks(table: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << _BITS, bool)
        out[table >> _U(64 - _BITS)] = True
        return out

    @staticmethod
    def look_up(table: np.ndarray, marks: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where codes of the sorted table stand, and their places in it; marks: leading bits that occur in it."""
        at = np.flatnonzero(marks[codes >> _U(64 - _BITS)])
        if not len(at):
            return at, at
        place = np.searchsorted(table, codes[at])
        place[place == len(table)] = 0
        hit = table[place] == codes[at]
        return at[hit], place[hit]

    def choose_seeds(self, counts: np.ndarray, n_docs: int) -> None:
        """counts: for each gram, the documents with it. Sets the table of seeds and where in items they stand."""
        often, absent = max(self.p.rare_rows, self.p.rare * n_docs), np.iinfo(np.int64).max
        codes, items, places = [np.empty(0, _U)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for no, own in enumerate(self.codes):
            if not len(own):
                continue
            n = counts[np.searchsorted(self.grams, own)]
            views = np.lib.stride_tricks.sliding_window_view(np.where(n > 0, n, absent), min(self.p.window, len(own)))
            seed = (n > 0) & (n <= often)
            seed[views.argmin(axis=1) + np.arange(len(views))] = True
            at = np.flatnonzero(seed & (n > 0))
            codes.append(own[at])
            items.append(np.full(len(at), no))
            places.append(at)
        every = np.concatenate(codes)
        order = np.argsort(every, kind="stable")
        self.seeds, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.item_of, self.place_of = np.concatenate(items)[order], np.concatenate(places)[order]
        self.marks = self._marks(self.seeds)

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): stretches of the document that hold seeds of the item, widened by half its length."""
        at, seed = self.look_up(self.seeds, self.marks, sh.ngram_hashes(words, self.p.ngram))
        if not len(at):
            return
        n = self.first[seed + 1] - self.first[seed]
        entry = np.repeat(self.first[seed] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, start = self.item_of[entry], np.repeat(at, n) - self.place_of[entry]
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        size = np.array([len(self.words[i]) for i in item])
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size[1:])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(item)) - 1
        for a, b in zip(heads, tails, strict=True):
            m = int(size[a])
            yield int(item[a]), max(0, int(start[a]) - m // 2), min(len(words), int(start[b]) + m + m // 2)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words, match 1, mismatch and gap -1: best score and where it ends in a and b (exclusive)."""
    steps = np.arange(len(b) + 1, dtype=np.int64)
    row = np.zeros(len(b) + 1, np.int64)
    best, end_a, end_b = 0, 0, 0
    for i, w in enumerate(a):
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(b == w, 1, -1), row[1:] - 1), 0)
        row = np.maximum.accumulate(new + steps) - steps  # gaps along the row
        at = int(row.argmax())
        if row[at] > best:
            best, end_a, end_b = int(row[at]), i + 1, at
    return best, end_a, end_b


def matches(block: Block, text: str | None) -> Iterator[tuple[int, int, int, int]]:
    """(item, score, start, end) of each item's best alignment that passes, start and end in words."""
    words, p = words_of(text), block.p
    best: dict[int, tuple[int, int, int]] = {}
    for item, low, high in block.candidates(words):
        a, b = block.words[item], words[low:high]
        need = min(max(p.least, int(np.ceil(p.share * len(a)))), p.enough, len(a))
        if np.isin(a, b).sum() < need:  # the score can't pass the words in common
            continue
        score, end_a, end_b = align(a, b)
        if score >= need and score > best.get(item, (0, 0, 0))[0]:
            back, _, from_b = align(a[:end_a][::-1], b[:end_b][::-1])
            best[item] = (score, low + end_b - from_b, low + end_b)
    if block.short and text:
        at = 0
        for line in text.split("\n"):
            own = words_of(line)
            for item in block.short.get(tuple(own.tolist()), []) if len(own) < p.ngram else []:
                best.setdefault(item, (len(own), at, at + len(own)))
            at += len(own)
    for item, found in sorted(best.items()):
        yield item, *found


def _counter(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(block.grams), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                _, place = block.look_up(block.grams, block.marks, sh.ngram_hashes(words_of(text), block.p.ngram))
                total[np.unique(place)] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["gram", "n"])

    return run


def _matcher(block: Block, item_type: pa.DataType):
    names = ["id", "item", "score", "item_words", "start_word", "end_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for no, text in enumerate(batch.column(1).to_pylist()):
                for item, score, start, end in matches(block, text):
                    rows.append((no, block.ids[item], score, len(block.words[item]), start, end))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type)]
                + [pa.array(c, pa.int64()) for c in cols[2:]],
                names,
            )

    return run


def _blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, p: Decontamination) -> Iterator[Block]:
    """Blocks with their seeds chosen. Items are streamed to the driver, which holds one block at a time."""

    def ready(items: list[tuple[object, str]]) -> Block:
        block = Block(items, p)
        texts = docs.select(F.col(text_col).cast("string").alias("text"))
        with small_batches(docs.sparkSession, 500):
            counted = texts.mapInArrow(_counter(block), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(block.grams) + 1, np.int64)  # a row for each n-gram of the block at most; the last one counts documents
        for gram, n in counted:
            counts[gram] = n
        block.choose_seeds(counts[:-1], int(counts[-1]))
        return block

    now, size = [], 0
    for item, text in benchmark.select(F.col(item_col), F.col(item_text_col).cast("string")).toLocalIterator():
        n = len(words_of(text))
        if n:
            now.append((item, text))
            size += n
        if size >= p.block_words:
            yield ready(now)
            now, size = [], 0
    if now:
        yield ready(now)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    params: Decontamination = Decontamination(),
) -> DataFrame:
    """A row for each document and test item that align: the id, the item's id, score, item_words, start_word,
    end_word (words of the document, end exclusive).

    Items of fewer words than a seed match lines of the same words. Null or empty texts and items without words align
    with nothing; equal rows and equal items are reported one by one; null ids are carried; an empty table on either side
    gives no rows; extra columns are ignored. What a block of items finds is written to the shared folder.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = narrow.schema["id"].dataType, benchmark.select(item_col).schema[0].dataType
    schema = f"id {kinds[0].simpleString()}, item {kinds[1].simpleString()}, score bigint, item_words bigint, start_word bigint, end_word bigint"
    found = []
    for block in _blocks(docs, benchmark, text_col, item_col, item_text_col, params):
        with small_batches(spark, 500):
            found.append(materialize(narrow.mapInArrow(_matcher(block, to_arrow_type(kinds[1])), schema), "leaks"))
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    params: Decontamination = Decontamination(),
) -> DataFrame:
    """docs without the rows that hold a test item; columns as they were.

    It goes by row, so null and repeated ids make no difference. The rows that stay are written to the shared folder.
    """
    names, at = docs.columns, docs.columns.index(text_col)

    def clean_of(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [next(matches(block, text), None) is None for text in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(batch.columns, names).filter(pa.array(keep, pa.bool_()))

        return run

    left = docs
    for block in _blocks(docs, benchmark, text_col, item_col, item_text_col, params):
        with small_batches(docs.sparkSession, 500):
            left = materialize(left.mapInArrow(clean_of(block), docs.schema), "leaks-left")
    return left
