"""Secret scan with trigram queries in front of the regular expressions.

From each rule's regular expression a Boolean query over trigrams is derived that every match must satisfy, and only
documents that satisfy a rule's query are searched with its expression. Rules without mandatory trigrams search
every document. A scan of all documents meets the queries document at a time, where the text is, so no text is moved:
posting lists by trigram would have to send every candidate's text to its row. posting_lists() makes such lists to be
kept, and candidates() intersects them, for rules that come later and are to read their candidates only. Matches carry
code-point offsets, which come from the lengths of the pieces between matches, so all of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre  # type: ignore[attr-defined]
from re import _parser as parser  # type: ignore[attr-defined]

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgraph.llm.common import let, running, text_of


@dataclass(frozen=True)
class Rule:
    """A pattern in the syntax that Java and Python share. group and least: drop matches whose group is shorter."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


ASSIGN = Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)
#: A greedy run that is too short holds no longer run, so for these two the least length stands in the pattern.
ACCESS = Rule("access", r"AKIA[A-Z0-9]{16,}")
HEX = Rule("hex", r"[0-9a-f]{24,}")
BASE_RULES = (ASSIGN, ACCESS, HEX)
#: Formats that their issuers publish.
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: A query is a set of alternatives, each a set of trigrams that must all occur; the empty alternative is no condition.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
MOST_STRINGS = 64


def trigram_query(pattern: str) -> Query:
    """The alternatives of trigrams (of lower-cased text) that every match of the pattern needs."""
    exact, query = _analyse(list(parser.parse(pattern)))
    return _smallest(_both(query, _of_strings(exact)) if exact is not None else query)


def _of_strings(strings: frozenset[str]) -> Query:
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _both(a: Query, b: Query) -> Query:
    return _smallest(frozenset(x | y for x in a for y in b))


def _smallest(q: Query) -> Query:
    """Without alternatives that ask for more than another one does."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _analyse(nodes: list) -> tuple[frozenset[str] | None, Query]:
    """The strings that the nodes can match, if they are few, and a query that holds besides."""
    run: frozenset[str] | None = frozenset([""])  # strings since the last break
    whole, query = True, ANY
    for op, arg in nodes:
        strings, inner = _analyse_one(op, arg)
        query = _both(query, inner)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = frozenset(a + b for a, b in product(run, strings))
            continue
        query = _both(query, _of_strings(run))
        whole, run = False, strings if strings is not None else frozenset([""])
    if whole:
        return run, query
    return None, _both(query, _of_strings(run))


def _analyse_one(op, arg) -> tuple[frozenset[str] | None, Query]:
    if op is sre.LITERAL:
        return frozenset([chr(arg).lower()]), ANY
    if op is sre.IN:
        chars = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, ANY
        return (frozenset(chars), ANY) if len(chars) <= 8 else (None, ANY)
    if op is sre.SUBPATTERN:
        return _analyse(list(arg[3]))
    if op is sre.BRANCH:
        parts = [_analyse(list(x)) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return frozenset().union(*[s for s, _ in parts]), ANY
        return None, frozenset().union(*[_both(q, _of_strings(s)) if s is not None else q for s, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _analyse(list(inner))
        if low == 0 and high == 1 and strings is not None:
            return strings | {""}, ANY
        if low == high and strings is not None and len(strings) ** low <= MOST_STRINGS:
            return frozenset("".join(x) for x in product(strings, repeat=low)), ANY
        if low == 0:
            return None, ANY
        return None, _both(query, _of_strings(strings)) if strings is not None else query
    if op is sre.AT:
        return frozenset([""]), ANY
    return None, ANY


def spans_of(text: Column, rule: Rule) -> Column:
    """Leftmost matches of a rule that do not overlap: array of structs (start, end), code points, end exclusive."""
    pattern = rule.pattern

    def located(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        groups = m if rule.group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
        steps = F.arrays_zip(
            F.transform(F.slice(gaps, 1, F.size(m)), F.length).alias("gap"),
            F.transform(m, F.length).alias("own"),
            F.transform(groups, F.length).alias("part"),
        )

        def placed(s: Column) -> Column:
            before = running(F.transform(s, lambda x: x["gap"] + x["own"]), lambda a, b: a + b, F.lit(0))
            spans = F.zip_with(
                before,
                s,
                lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["own"]).alias("end"), x["part"].alias("part")),
            )
            kept = F.filter(spans, lambda x: x["part"] >= rule.least)
            return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

        return let(steps, placed)

    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, located(m)).otherwise(none))


def meets(query: Query, has) -> Column:
    """Whether the query holds, where has(trigram) says that a trigram occurs."""
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [has(t) for t in sorted(alternative)]) for alternative in sorted(query, key=sorted)])


def _vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules if (q := trigram_query(r.pattern)) != ANY for alternative in q for t in alternative})


def posting_lists(docs: DataFrame, rules: tuple[Rule, ...], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, doc): the documents of each trigram that some of the rules ask for, to be kept by trigram.

    Rows that share an id are one document. Null and empty texts are in no list.
    """
    low = docs.select(F.col(id_col).alias("doc"), F.lower(text_of(text_col)).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in _vocabulary(rules)] or [F.lit(None).cast("string")]))
    return low.select(F.explode(found).alias("trigram"), "doc").distinct()


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(rule, doc): the documents that meet the query of each rule with mandatory trigrams, by intersecting their lists."""
    asked = [
        (r.name, no, t, len(alternative))
        for r in rules
        if (q := trigram_query(r.pattern)) != ANY
        for no, alternative in enumerate(sorted(q, key=sorted))
        for t in alternative
    ]
    lists = postings.sparkSession.createDataFrame(asked, "rule string, alternative int, trigram string, size int")
    met = postings.join(F.broadcast(lists), "trigram").groupBy("rule", "alternative", "doc", "size").agg(F.count_distinct("trigram").alias("n"))
    return met.where("n = size").select("rule", "doc").distinct()


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], *, text_col: str) -> DataFrame:
    """(row, hits): each row of docs as a struct, with sorted structs (start, kind_no, end, kind)."""
    text = text_of(F.col("row")[text_col])
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, kind_no: INT, end: INT, kind: STRING>>)")

    def marked(no: int, rule: Rule) -> Column:
        with_kind = F.transform(
            spans_of(text, rule),
            lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(rule.name).alias("kind")),
        )
        query = trigram_query(rule.pattern)
        return with_kind if query == ANY else F.when(meets(query, lambda t: F.contains(F.lower(text), F.lit(t))), with_kind).otherwise(none)

    # a generated column is worked out once, whatever is made of it
    every = F.sort_array(F.concat(*[marked(no, rule) for no, rule in enumerate(rules)]))
    return held.select("row", F.explode(F.array(every)).alias("hits"))


CHUNK = 1024


def _pieces(text: Column, spans: Column) -> Column:
    """The part of the text in each of the spans (structs of start and end), in time linear in the text."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def part(c: Column, s: Column) -> Column:
        start, end = s["start"], s["end"]
        first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
        joined = F.array_join(F.slice(c, first + 1, last - first + 1), "")
        return F.when(end <= start, "").otherwise(F.substring(joined, start - first * CHUNK + 1, end - start))

    return let(chunks, lambda c: F.transform(spans, lambda s: part(c, s)))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", more_rules: tuple[Rule, ...] = MORE_RULES
) -> DataFrame:
    """Per row of docs: the id, n_assign, n_access, n_hex, base_sha256, spans and secrets.

    spans is kind:start:end by start and then kind, comma-joined; base_sha256 is the digest of that string for
    the three base kinds; secrets holds the same spans as structs with the matched text. A null or empty text
    has no spans (spans empty, base_sha256 that of an empty string). Null ids and repeated rows are scanned like any other; an
    empty table gives no rows; extra columns are ignored.
    """
    rules = BASE_RULES + tuple(more_rules)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _scanned(narrow, rules, text_col="text")
    base = F.filter("hits", lambda s: s["kind_no"] < len(BASE_RULES))
    text = text_of(F.col("row")["text"])

    def count(no: int) -> Column:
        return F.size(F.filter("hits", lambda s: s["kind_no"] == no)).cast("long")

    return found.select(
        F.col("row")["id"].alias(id_col),
        *[count(no).alias(f"n_{r.name}") for no, r in enumerate(BASE_RULES)],
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("hits")).alias("spans"),
        F.zip_with(
            "hits",
            F.when(F.size("hits") > 0, _pieces(text, F.col("hits"))).otherwise(F.array().cast("array<string>")),
            lambda s, found: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), found.alias("found")),
        ).alias("secrets"),
    )


def redact_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", more_rules: tuple[Rule, ...] = MORE_RULES
) -> DataFrame:
    """docs with every span replaced by the mark, overlapping spans by one; all other columns as they were.

    Rows without a span come back unchanged, a null text as null.
    """
    rules = BASE_RULES + tuple(more_rules)
    found = _scanned(docs, rules, text_col=text_col)
    text = F.col("row")[text_col]

    def between(merged: Column) -> Column:
        """The spans outside the merged ones."""
        return F.transform(
            F.sequence(F.lit(0), F.size(merged)),
            lambda i: F.struct(
                F.when(i > 0, F.get(merged, i - 1)["end"]).otherwise(0).alias("start"),
                F.when(i < F.size(merged), F.get(merged, i)["start"]).otherwise(F.length(text)).alias("end"),
            ),
        )

    clean = let(let(_merged(F.col("hits")), between), lambda outside: F.array_join(_pieces(text, outside), mark))
    clean = F.when(text.isNull() | (F.size("hits") == 0), text).otherwise(clean)
    return found.withColumn("clean", clean).select(
        *[F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    )


def _merged(spans: Column) -> Column:
    """Sorted spans with those that overlap made one."""
    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))

    def joined(before: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: spans[i]["start"] >= before[i])
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return let(
            heads,
            lambda h: F.transform(
                h,
                lambda i, k: F.struct(
                    spans[i]["start"].alias("start"), F.when(k + 1 < F.size(h), before[F.get(h, k + 1)]).otherwise(last).alias("end")
                ),
            ),
        )

    return let(ends, joined)
