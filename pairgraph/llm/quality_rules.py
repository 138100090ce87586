"""Weak supervision of text quality: rules vote or abstain, EM weighs them, a posterior decides.

Seven rules vote good (1), bad (-1) or abstain (0) on each document; those that know defects only never vote good.
Expectation-maximisation over the counts of vote patterns estimates how accurate each rule's votes are, on good
and on bad documents, and how common good documents are; a document stays if its posterior probability of being
good reaches a threshold. A rule that often objects to what others hold good loses its weight. Patterns are at most 3^7 however many documents there
are, so the estimation reads the corpus once (a grouped count) and works on that small table. Everything runs
as DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairgraph.llm.common import WORD, let, text_of, words_of
from pairgraph.plans.store import materialize

RULES = ("length", "symbols", "symbol_share", "word_length", "line_repeats", "word_repeats", "capitals")
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class RuleModel:
    """What EM found: the share of good documents and, by rule, the share of right votes on good and on bad ones."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self, votes: tuple[int, ...]) -> float:
        good, bad = math.log(self.prior), math.log(1 - self.prior)
        for v, g, b in zip(votes, self.on_good, self.on_bad, strict=True):
            if v:
                good += math.log(g if v > 0 else 1 - g)
                bad += math.log(1 - b if v > 0 else b)
        return 1 / (1 + math.exp(min(700.0, bad - good)))


def base_features(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals (all long).

    n_repeat_words counts words within a window of three that occurs twice or more in the text. Windows are
    64-bit hashes; their leading bits are sorted with their positions in the trailing ones, neighbours near each other
    whose whole hashes are equal mark their positions, and the words covered by marked windows are counted from the gaps
    between these.
    """
    words = words_of(text)

    def from_words(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(n >= 4, let(hashes, _covered)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    by_words = let(words, from_words)
    by_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return let(
        F.struct(by_words.alias("w"), by_lines.alias("l")),
        lambda x: F.struct(
            x["w"]["n_words"].alias("n_words"),
            x["w"]["word_chars"].alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            x["l"]["n_dup_lines"].alias("n_dup_lines"),
            x["w"]["n_repeat_words"].alias("n_repeat_words"),
            x["l"]["n_lines"].alias("n_lines"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        ),
    )


def _covered(hashes: Column) -> Column:
    """Words covered by windows of equal hash."""
    n = F.size(hashes)

    def with_mask(mask: Column) -> Column:
        """mask: ones where the position stands."""
        packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftrightunsigned(h, 1).bitwiseAND(-1 - mask).bitwiseOR(i.cast("long"))))

        def places(s: Column) -> Column:
            at = lambda i: s[i].bitwiseAND(mask).cast("int")
            near = F.filter(F.sequence(F.lit(1), n - 1), lambda i: s[i] - s[i - 1] <= mask)
            equal = F.filter(near, lambda i: hashes[at(i)] == hashes[at(i - 1)])
            return F.sort_array(F.array_distinct(F.concat(F.transform(equal, at), F.transform(equal, lambda i: at(i - 1)))))

        return let(packed, places)

    def counted(p: Column) -> Column:
        steps = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(3), lambda total, i: total + F.least(F.lit(3), p[i] - p[i - 1]))
        return F.when(F.size(p) < 2, F.lit(0)).otherwise(steps)

    return let(let(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1, with_mask), counted)


def rule_votes(f: Column) -> list[Column]:
    """The seven votes on a struct of base_features()."""

    def vote(bad: Column, good: Column | None = None) -> Column:
        out = F.when(bad, -1)
        return (out if good is None else out.when(good, 1)).otherwise(0).cast("int")

    n, lines = f["n_words"], f["n_lines"]
    return [
        vote(n < 50, n >= 80),
        vote(f["n_symbols"] * 10 > n, f["n_symbols"] * 50 <= n),
        vote(f["n_symbols"] * 25 > f["word_chars"], f["n_symbols"] * 200 <= f["word_chars"]),
        vote((f["word_chars"] < 2 * n) | (f["word_chars"] > 12 * n)),
        vote(f["n_dup_lines"] * 10 > 3 * lines),
        vote(f["n_repeat_words"] * 10 > 3 * n),
        vote(f["n_capitals"] * 10 > 3 * f["word_chars"]),
    ]


def fit_rules(
    patterns: list[tuple[tuple[int, ...], int]], *, rounds: int = 20, prior: float = 0.8, on_good: float = 0.95, on_bad: float = 0.5
) -> RuleModel:
    """EM over (votes, count), from the shares given.

    Ten documents of the shares given are added throughout, which keeps shares off 0 and 1, also in an empty
    table. A vote for good never counts against a document: on_good stays at 1 - on_bad at least.
    """
    k = len(RULES)
    model = RuleModel(prior, (on_good,) * k, (on_bad,) * k)
    for _ in range(rounds):
        total = good = 0.0
        right_g, cast_g, right_b, cast_b = ([0.0] * k for _ in range(4))
        for votes, n in patterns:
            p = model.posterior(votes)
            total += n
            good += n * p
            for j, v in enumerate(votes):
                if v:
                    cast_g[j] += n * p
                    cast_b[j] += n * (1 - p)
                    if v > 0:
                        right_g[j] += n * p
                    else:
                        right_b[j] += n * (1 - p)
        bads = tuple((right_b[j] + 10 * on_bad) / (cast_b[j] + 10) for j in range(k))
        goods = tuple(max(1 - bads[j], (right_g[j] + 10 * on_good) / (cast_g[j] + 10)) for j in range(k))
        model = RuleModel((good + 10 * prior) / (total + 10), goods, bads)
    return model


def _pattern(votes: list[Column]) -> Column:
    code = F.lit(0)
    for v in votes:
        code = code * 3 + v + 1
    return code


def _votes_of(code: int) -> tuple[int, ...]:
    out = []
    for _ in RULES:
        code, digit = divmod(code, 3)
        out.append(digit - 1)
    return tuple(reversed(out))


def score_quality(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, rounds: int = 20
) -> DataFrame:
    """Per row of docs: the id, the base counts, base_failed, kept, posterior and the vote of each rule.

    base_failed: fewer than 50 words, or over half of the words in repeated windows; such rows are not kept
    whatever the posterior. A null text counts as empty and so fails; null ids and equal rows are kept apart
    and returned as they came; an empty table gives no rows; extra columns are ignored.
    """
    voted = materialize(votes_of(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))).drop("text"), "quality-votes")  # texts are read once
    model = fit_rules(pattern_counts(voted), rounds=rounds)
    return _decided(voted, model, threshold).select(
        F.col("id").alias(id_col),
        *[F.col("f")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
        F.round("posterior", 6).alias("posterior"),
        *[F.col("votes")[i].alias(f"vote_{r}") for i, r in enumerate(RULES)],
    )


def keep_good(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5, rounds: int = 20) -> DataFrame:
    """The rows of docs that are kept, with their own columns only.

    Rows are written to the shared folder with their votes, those that the base rules reject with the votes alone, so
    that texts are measured once.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of(text_col).alias("text"))
    voted = votes_of(held).withColumn("base_failed", base_failed())
    written = materialize(voted.select(F.when(~F.col("base_failed"), F.col("row")).alias("row"), "pattern", "base_failed"), "quality-rows")
    model = fit_rules(pattern_counts(written), rounds=rounds)
    return written.where(~F.col("base_failed") & (posterior_of(F.col("pattern"), model) >= threshold)).select("row.*")


def votes_of(rows: DataFrame) -> DataFrame:
    """rows with f (the features of their column text), votes and pattern (the votes as one number)."""
    # a generated column is worked out once, where a projected one would be again for each use
    features = rows.withColumn("f", F.explode(F.array(base_features(F.col("text")))))
    return features.withColumn("votes", F.array(*rule_votes(F.col("f")))).withColumn(
        "pattern", _pattern([F.col("votes")[i] for i in range(len(RULES))])
    )


def pattern_counts(voted: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """How many documents vote in each way: at most 3^7 rows, in a fixed order."""
    found = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    return [(_votes_of(r["pattern"]), r["n"]) for r in sorted(found, key=lambda r: r["pattern"])]


def base_failed() -> Column:
    return (F.col("f")["n_words"] < 50) | (100 * F.col("f")["n_repeat_words"] > 50 * F.col("f")["n_words"])


def posterior_of(pattern: Column, model: RuleModel) -> Column:
    posteriors = [float(model.posterior(_votes_of(code))) for code in range(3 ** len(RULES))]
    return F.element_at(F.lit(posteriors).cast(T.ArrayType(T.DoubleType())), pattern + 1)


def _decided(voted: DataFrame, model: RuleModel, threshold: float) -> DataFrame:
    return (
        voted.withColumn("posterior", posterior_of(F.col("pattern"), model))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )
