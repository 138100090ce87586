"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams that occur in it, of which those stay that occur in toxic
texts more or less often than by chance. Each is scaled by the log ratio of how often it occurs in toxic and in other
labelled texts, and logistic regression with an L2 penalty is fitted on the scaled features. Fitting uses a bounded
sample of labelled rows; scoring reads every text whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgraph.llm.common import small_batches
from pairgraph.plans.store import discard, materialize

_U = np.uint64
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], _U)


@dataclass(frozen=True)
class Toxicity:
    """sizes: of n-grams. bits: of the feature space. fit_rows: the sample for fitting is at most so many labelled rows
    of each class. least_rows, least_z: features that fewer rows of the sample have, or that lie by fewer standard
    deviations off chance, are left out. penalty, rounds: of the regression. folds: by which the score decide, from
    which a text is called toxic, is placed."""

    sizes: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    fit_rows: int = 4000
    least_rows: int = 3
    least_z: float = 3.0
    penalty: float = 0.001
    rounds: int = 60
    folds: int = 3
    decide: float = 0.7


def features_of(texts: list[str | None], p: Toxicity, keep: np.ndarray | None = None, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature): the distinct hashed n-grams of each text in order; with keep only those that it marks.

    Texts are hashed together, block by block, so memory is that of the code points and of what is found.
    """
    lows = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lows).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t) for t in lows])
    longest, found = max(p.sizes), [np.empty(0, np.int64)]
    for at in range(0, len(points), block):
        part = points[at : at + block + longest - 1].astype(_U)
        state = part * _MUL[0]
        for n in range(1, min(longest, len(part)) + 1):
            if n > 1:
                state = (state[:-1] * _MUL[1]) ^ (part[n - 1 :] + _U(n) * _MUL[2])
            if n in p.sizes:
                code = ((state[:block] * _MUL[3]) >> _U(64 - p.bits)).astype(np.int64)
                here = np.arange(len(code)) if keep is None else np.flatnonzero(keep[code])
                owner = np.searchsorted(ends, here + at, side="right")
                inside = here + at + n <= ends[owner]  # not over the end of its text
                found.append(_distinct((owner[inside] << p.bits) | code[here[inside]]))
    out = _distinct(np.concatenate(found))
    return out >> p.bits, out & ((1 << p.bits) - 1)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


@dataclass
class Model:
    weights: np.ndarray  # of each feature, with its ratio
    bias: float

    def score(self, texts: list[str | None], p: Toxicity) -> np.ndarray:
        owner, code = features_of(texts, p, self.weights != 0)
        return _chance(np.bincount(owner, weights=self.weights[code], minlength=len(texts)) + self.bias)


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def off_chance(n_docs: int, toxic_docs: int, p: Toxicity) -> Column:
    """Whether the count of a feature in toxic texts (column toxic, of n texts with it) is least_z deviations or more from
    that of chance."""
    share = toxic_docs / n_docs if n_docs else 0.0
    spread = F.sqrt(F.greatest(F.col("n") * share * (1 - share), F.lit(1e-9)))
    return (F.col("n") >= p.least_rows) & (F.abs(F.col("toxic") - F.col("n") * share) >= p.least_z * spread)


def fit(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, n_features: int, p: Toxicity) -> tuple[np.ndarray, float]:
    """(weights, bias) from the entries (row, feature) and the rows' labels, 0 or 1. Classes weigh alike.

    Each feature is scaled by its naive Bayes log-count ratio (of presence, one added to each count), and the mean
    logistic loss with penalty / 2 times the squared weights is brought to its least by limited-memory BFGS. Without
    rows all texts score 0.5; with one class only, all score as that class.
    """
    n, y = len(labels), labels.astype(np.float64)
    toxic = y.sum()
    if not n or toxic in (0, n):
        return np.zeros(n_features), 0.0 if not n else (2.0 if toxic else -2.0)
    in_toxic = np.bincount(features, weights=y[rows], minlength=n_features)
    in_rest = np.bincount(features, minlength=n_features) - in_toxic
    ratio = np.log((in_toxic + 1) / (toxic + 2)) - np.log((in_rest + 1) / (n - toxic + 2))
    weigh = np.where(y == 1, 0.5 / toxic, 0.5 / (n - toxic))

    def loss(wb: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, weights=(wb[:-1] * ratio)[features], minlength=n) + wb[-1]
        error = weigh * (_chance(z) - y)
        g = np.append(ratio * np.bincount(features, weights=error[rows], minlength=n_features) + p.penalty * wb[:-1], error.sum())
        return float(weigh @ (np.logaddexp(0, z) - y * z)) + p.penalty / 2 * float(wb[:-1] @ wb[:-1]), g

    wb = _lowest(loss, np.zeros(n_features + 1), p.rounds)
    return wb[:-1] * ratio, float(wb[-1])


def _lowest(f, x: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """Where the convex f (value and gradient) is least, by limited-memory BFGS with halved steps."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(g).max() < 1e-6:
            break
        q, parts = g.copy(), []
        for s, y, r in reversed(steps):
            parts.append(r * (s @ q))
            q -= parts[-1] * y
        if steps:
            s, y, r = steps[-1]
            q /= r * (y @ y)
        for (s, y, r), a in zip(steps, reversed(parts), strict=True):
            q += (a - r * (y @ q)) * s
        size, slope = 1.0, g @ q
        while size > 1e-10:
            new_value, new_g = f(x - size * q)
            if new_value <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = -size * q, new_g - g
        x, value, g = x + s, new_value, new_g
        if s @ y > 1e-12:
            steps = [*steps, (s, y, 1 / (s @ y))][-memory:]
    return x


def fit_at(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, weigh: np.ndarray, n_features: int, p: Toxicity) -> tuple[np.ndarray, float]:
    """fit(), with the bias moved so that the score p.decide is where it tells the classes apart best.

    Best is the largest F1 over rows scored by models of the other folds; weigh: how many rows of the corpus each one
    stands for.
    """
    weights, bias = fit(rows, features, labels, n_features, p)
    z, part = np.zeros(len(labels)), np.arange(len(labels)) % p.folds
    if len(labels) < 10 * p.folds or any(len(set(labels[part != k])) < 2 for k in range(p.folds)):
        return weights, bias
    for k in range(p.folds):
        learn = part != k
        number = np.cumsum(learn) - 1
        mine = learn[rows]
        w, b = fit(number[rows[mine]], features[mine], labels[learn], n_features, p)
        z += np.where(learn, 0.0, np.bincount(rows, weights=w[features], minlength=len(labels)) + b)
    order = np.argsort(-z, kind="stable")
    right, called = np.cumsum((weigh * labels)[order]), np.cumsum(weigh[order])
    at = int(np.argmax(2 * right / (called + (weigh * labels).sum())))
    edge = z[order[at]] if at + 1 == len(z) else (z[order[at]] + z[order[at + 1]]) / 2
    return weights, bias - float(edge) + float(np.log(p.decide / (1 - p.decide)))


def fold_of(key: Column, folds: int = 3) -> Column:
    """crc32 of the key as text, modulo folds; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, params: Toxicity) -> Model:
    """The model from labelled rows outside fold 1. The sample is the rows of each class whose hashed ids come first.

    Features of the sample's texts are made and counted on the executors; what the counts leave of them is fitted in
    one task, whose input is bounded by the sample.
    """
    p, spark, size = params, docs.sparkSession, 1 << params.bits
    named = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    named = named.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")).where(fold_of(F.col("id")) != 1)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    known = materialize(named.join(texts.select("id").distinct(), "id", "left_semi"), "toxic-known")
    order = [F.xxhash64("id"), F.col("id")]
    both = [known.where(f"y = {y}").orderBy(*order).limit(p.fit_rows) for y in (0, 1)]
    chosen = F.broadcast(both[0].unionByName(both[1]))  # 2 * fit_rows ids at most
    stands = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = features_of([text], p)[1].astype(np.int32)
                key = hashlib.blake2b(found, digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([y], pa.int32()), pa.array([found.tobytes()])], ["key", "y", "features"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, toxic = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for y, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.frombuffer(found, np.int32)  # distinct
                rows[at] += 1
                toxic[at] += y
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(rows[some]), pa.array(toxic[some])], ["feature", "n", "toxic"])

    with small_batches(spark, 200):
        sample = texts.join(chosen, "id").select("y", "text")
        sample = materialize(sample.mapInArrow(made, "key binary, y int, features binary"), "toxic-sample")
        counts = sample.select("y", "features").mapInArrow(counted, "feature bigint, n bigint, toxic bigint")
        n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
        counts = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(off_chance(n, toxic, p))
        chosen_features = np.array(sorted(r[0] for r in counts.select("feature").collect()), np.int64)  # 2 ** bits at most
    number = np.full(size, -1, np.int32)
    number[chosen_features] = np.arange(len(chosen_features))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [number[np.frombuffer(x, np.int32)] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[x >= 0].tobytes() for x in found], pa.binary())], ["key", "y", "features"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, y = [], []
        for batch in batches:
            for label, mine in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                entries.append(np.frombuffer(mine, np.int32))
                y.append(label)
        labels_ = np.array(y, np.int64)
        of = np.bincount(labels_, minlength=2)
        weigh = np.array([stands.get(v, 0) / max(1, of[v]) for v in (0, 1)])[labels_] if len(y) else np.empty(0)
        row = np.repeat(np.arange(len(y)), [len(e) for e in entries])
        weights, bias = fit_at(row, np.concatenate([np.empty(0, np.int64), *entries]).astype(np.int64), labels_, weigh, len(chosen_features), p)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    # the order depends on the rows alone, so that sums come out alike in reruns
    with small_batches(spark, 200):
        small = sample.mapInArrow(numbered, "key binary, y int, features binary")
        model = small.orderBy("key", "y").coalesce(1).mapInArrow(fitted, "weights binary, bias double").collect()
    discard(known, sample)
    weights = np.zeros(size)
    if not model:
        return Model(weights, 0.0)
    weights[chosen_features] = np.frombuffer(model[0]["weights"], np.float64)
    return Model(weights, model[0]["bias"])


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    params: Toxicity = Toxicity(),
) -> DataFrame:
    """Per row of docs: the id, held_out (crc32 of the id modulo 3 is 1), score (0 to 1) and predicted.

    Labels other than 0 and 1 and labels without a text are ignored, several labels of one id count as the
    largest. Null and empty texts have no features and get the score of the bias; a null id is not held out; equal rows score
    alike; an empty table gives no rows; without labels all score 0.5. Extra columns are ignored. Scores are written to
    the shared folder.
    """
    p = params
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, params=p)
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(fold_of(F.col(id_col)) == 1, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    used = np.flatnonzero(model.weights)
    values, bias = model.weights[used], model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << p.bits)
        weights[used] = values
        mine = Model(weights, bias)
        for batch in batches:
            scores = mine.score(batch.column(2).to_pylist(), p)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= p.decide).astype(np.int32))],
                ["id", "held_out", "score", "predicted"],
            )

    id_type = narrow.schema["id"].dataType.simpleString()
    with small_batches(docs.sparkSession, 500):
        out = materialize(narrow.mapInArrow(run, f"id {id_type}, held_out boolean, score double, predicted int"), "toxicity")
    return out.withColumnRenamed("id", id_col)
