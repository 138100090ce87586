"""Repeated passages against a walk over all documents with its own units, and the cut text against its offsets."""

import random

from pairgraph.llm import substring_dedup as sd

SPACE = " \t\n\v\f\r"


def units_by_hand(text):
    """(start, end, words as text) character by character."""
    out, start, i, text = [], 0, 0, text or ""
    while i <= len(text):
        stop = i == len(text)
        if not stop and text[i] == "\n":
            i, stop = i + 1, True
        elif not stop and text[i] in "。！？":
            while i < len(text) and text[i] in "。！？":
                i += 1
            stop = True
        elif not stop and text[i] in ".!?…":
            k = i
            while k < len(text) and text[k] in ".!?…":
                k += 1
            stop, i = k < len(text) and text[k] in SPACE, k
        elif not stop:
            i += 1
        if stop:
            piece = text[start:i]
            words = "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in piece).split()
            if words:
                out.append((start + len(piece) - len(piece.lstrip(SPACE)), start + len(piece.rstrip(SPACE)), words))
            if i >= len(text):
                break
            start = i
    return out


def by_hand(texts, p=sd.Units()):
    """{no: [(start, end), ...]} of the passages that go."""
    seen, gone = {}, {}
    for i, t in enumerate(texts):
        run, spans = [], []
        for k, (start, end, words) in enumerate([*units_by_hand(t), (0, 0, None)]):
            if words and (first := seen.setdefault(tuple(words), (i, start, k)))[:2] != (i, start):
                run.append((start, end, len(words), first))
                continue
            size = chars = 0
            for j, (a, b, n, first) in enumerate(run):
                beside = [(f[0], f[2] - (m - j)) for m, (*_, f) in enumerate(run) if abs(m - j) == 1]
                if n >= p.short_words or b - a >= p.short_chars or (first[0], first[2]) in beside:
                    size, chars = size + n, chars + b - a
            if run and 2 * size >= sum(n for _, _, n, _ in run) and (size >= p.least_words or chars >= p.least_chars):
                spans.append((run[0][0], run[-1][1]))
            run = []
        if spans:
            gone[i] = spans
    return gone


def docs_of(seed=2):
    rng = random.Random(seed)
    sent = lambda n: " ".join(rng.choice("abcdefghij") * 2 + str(rng.randrange(50)) for _ in range(n)).capitalize() + "."
    passage = " ".join(sent(n) for n in (8, 12, 7, 3, 15, 9))
    line, short = sent(24), sent(4)
    out = []
    for i in range(40):
        lines = [" ".join(sent(rng.choice([2, 6, 11])) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(6))]
        if i % 4 == 0:
            lines.append("start of a line that differs " + str(i) + " " + passage + " and goes on")
        if i % 5 == 0:
            lines.insert(0, "  " + line.upper() + "\t")
        if i % 3 == 0:
            lines.insert(len(lines) // 2, short)
        out.append("\n".join(lines))
    return out + [None, "", "\n\n", out[8], "é𝄞 " + line, "word " * 30000 + "\n" + passage, "...\n。\n! ?", passage.replace(" ", "\n")]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 5, "x", "y", 7) for i, t in enumerate(texts)], "doc_id long, text string, start int, digest string, row string, id int").repartition(4)


def spans_of(spark, texts, units=sd.Units()):
    return {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in sd.cut_spans(frame(spark, texts), units=units).collect()}


def test_against_a_walk(spark):
    texts = docs_of()
    want = by_hand(texts)
    assert spans_of(spark, texts) == want and set(range(4, 40, 4)) <= set(want)  # also in the middle of lines
    every = sd.Units(1, 1, 1, 1)
    assert spans_of(spark, texts, every) == by_hand(texts, every) != want
    table = frame(spark, texts)
    clean = sd.remove_repeats(table)
    assert clean.columns == table.columns and clean.count() == len(texts)
    for r in clean.collect():
        t = texts[r["doc_id"]]
        for a, b in reversed(want.get(r["doc_id"], [])):
            t = t[:a] + t[b:]
        assert (r["text"], r["row"], r["id"]) == (t, "y", 7)


def test_units():
    for t in docs_of(5) + ["One. Two!? Three… four.five\nSix。seven！？eight 9.\n", "İstanbul ŞİŞLİ. x", "a.\r\nb"]:
        got = [(a, b, n) for a, b, n, _ in sd.units_of(t)]
        assert got == [(a, b, len(w)) for a, b, w in units_by_hand(t)]


def test_short_phrases_stay_and_passages_of_short_lines_go(spark):
    verse = "\n".join(f"so {a} it\nwent {a}" for a in "abcdefghijklmnopqrstuvwxyz")
    han = "这是一个没有空格的很长的句子它在两个文件里都出现而且超过了最低的字符数" * 5
    texts = [
        f"first head\n{verse}\nAll rights reserved",
        f"other head\n{verse}\nmiddle\nall rights reserved.",
        f"甲乙丙。{han}。丁戊己",
        f"子丑寅。{han}。卯辰巳\n---",
    ]
    shout = [f"W{i}!!" for i in range(100)]
    texts += [" ".join(shout), " ".join(shout[::3] + shout[1::3])]  # words that recur in another order
    clean = {r["doc_id"]: r["text"] for r in sd.remove_repeats(frame(spark, texts)).collect()}
    assert clean[0] == texts[0] and clean[2] == texts[2] and clean[5] == texts[5]
    assert clean[1] == "other head\n\nmiddle\nall rights reserved."
    assert clean[3] == "子丑寅。卯辰巳\n---"


def test_null_ids_repeated_rows_and_empty_tables(spark):
    line = " ".join(f"w{i}" for i in range(25))
    table = spark.createDataFrame([(None, line), (1, line), (1, line), (2, line + "\n" + line)], "doc_id long, text string")
    got = sd.repeated_units(table).select("doc_id", "start", "first_id", "first_start").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 0, None, 0)] * 2 + [(2, 0, None, 0), (2, len(line) + 1, None, 0)]))
    spans = [(r["doc_id"], r["n_units"], r["first_ids"]) for r in sd.cut_spans(table).orderBy("doc_id").collect()]
    assert spans == [(1, 1, [None]), (2, 2, [None])]
    assert sorted(map(str, (tuple(r) for r in sd.remove_repeats(table).collect()))) == sorted(map(str, [(None, line), (1, ""), (1, ""), (2, "")]))
    assert sd.repeated_units(table.limit(0)).count() == sd.cut_spans(table.limit(0)).count() == sd.remove_repeats(table.limit(0)).count() == 0


def test_a_text_full_of_hits(spark):
    lines = [f"line {i} " + " ".join(f"w{i % 97}x{j}" for j in range(20)) for i in range(20000)]
    texts = ["\n".join(lines), "\n".join(f"{x}\n{i}y" for i, x in enumerate(lines))]
    got = {r["doc_id"]: r["text"] for r in sd.remove_repeats(frame(spark, texts)).collect()}
    assert got[0] == texts[0] and got[1].split() == [f"{i}y" for i in range(20000)]
