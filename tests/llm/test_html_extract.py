"""HTML extraction on pages whose article is known."""

import os
import random
import re
from collections import Counter

from pairgraph.llm import html_extract as h

PROSE = "It was the best of times and it was the worst of times, for we had all that there is to have in the city of the king, "


def test_article_element():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{a:b}</style><script>var x = "<p>no</p>";</script></head>
    <body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>no</p> -->
    <div class="cookie-notice">We use cookies</div><div class='ad'>Buy</div>
    <article><header><h1>Title &lt;1&gt;</h1></header><p>One <b>two</b><i>three</i>
      four&nbsp;&eacute;&#x41;<p>a < b &amp c<ul><li>x<li>y</ul><form><input value="q"><button>Go</button></form>
    <section id="comments"><article><p>First!</p></article></section><p data-x="a>b">Last<br>line</p><aside>Side</aside></article>
    <div id="sidebar"><p>Side</p></div><footer>&copy; me</footer>"""
    assert h.main_text(page) == "Title <1>\nOne twothree four éA\na < b & c\nx\ny\nLast line"


def test_without_an_article_element():
    page = f"""<body><div class=menu><a href=1>{PROSE}</a></div><p><a href=2>All</a> <a href=3>links</a></p>
    <h2>Heading</h2><p>{PROSE * 2}</p><p>Short one.</p><p>{PROSE * 2}</p>
    <p>zxqv wkjh qqqq zzzz xxxx yyyy wwww vvvv tttt ssss rrrr pppp oooo nnnn mmmm llll kkkk</p><p>tail</p></body>"""
    want = "\n".join(["Heading", (PROSE * 2).strip(), "Short one.", (PROSE * 2).strip()])
    assert h.main_text(page) == want


def test_named_content():
    page = f"<div id='wrap'><p>{PROSE * 3}</p></div><div class='post-content'><p>###</p><p>ANY !! TEXT</p><div class='share-buttons'>x</div></div>"
    assert h.main_text(page) == "###\nANY !! TEXT"


def test_titles_and_main():
    page = "<h2>Site</h2><nav>x</nav><main><h1>Title</h1><article><p>a</p></article><h3>Comments</h3><div class='user-comments'><p>b</p></div><p>teaser</p></main>"
    assert h.main_text(page) == "Title\na"
    assert h.main_text("<div>x</div><main><p>a</p><aside>b</aside><p>c</p></main>") == "a\nc"


def test_broken_and_empty_pages():
    assert h.main_text(None) == h.main_text("") == h.main_text("<html></html>") == ""
    assert h.main_text("<article><p>open <b>tags") == "open tags"
    assert h.main_text("<article>a<p class='x>b</p><p>c</p></article>") == "a\nb\nc"
    assert h.main_text("<article>a<script>never closed") == "a"
    assert h.main_text("<article>5 < 6 <3 & &amp; &bogus; </p></div></article>") == "5 < 6 <3 & & &bogus;"
    assert h.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert len(h.main_text("<article><p>" + "word " * 200000)) == 999999
    assert h.main_text("<p>x</p>" * 30000) == "\n".join(["x"] * 30000)


def test_frame(spark):
    rows = [(1, "u", "<article>é<p>b", "x"), (None, None, None, "y"), (1, "u", "<article>é<p>b", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = h.extract_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == ["(1, 'u', 'é\\nb', 3)", "(1, 'u', 'é\\nb', 3)", "(None, None, '', 0)"]
    assert h.extract_text(pages.limit(0)).count() == 0


def test_article_elements_are_taken_whole(spark):
    """Every page of the smallest tables, against what stands between the article tags."""
    import html

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        return
    for r in spark.read.parquet(path).collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert h.main_text(r["html"]) == "\n".join(x for x in parts if x)


def test_densities_decide_beside_articles():
    cards = "".join(f"<article><h3><a href='/{i}'>Card {i}</a></h3><p>A teaser.</p></article>" for i in range(4))
    body = (PROSE * 3).strip()
    want = "\n".join([body, "Short one.", body])
    for tag in ("main", "div"):
        page = f"<body><nav>x</nav><{tag}><p>{PROSE * 3}</p><p>Short one.</p><p>{PROSE * 3}</p></{tag}>{cards}<footer>f</footer>"
        assert h.main_text(page) == want
    page = f"<article><h1><a href='/'>Title</a></h1><p>{PROSE * 3}</p><p>zxqv</p><p>{PROSE * 3}</p><ul><li><a href=1>See also</a></li></ul></article><p>Ad</p>"
    assert h.main_text(page) == "\n".join(["Title", body, "zxqv", body])
    assert h.main_text(f"<article><p>{'Zażółć gęślą jaźń ' * 20}</p></article><div>{PROSE}</div>") == ("Zażółć gęślą jaźń " * 20).strip()


def test_page_wide_wrappers_are_no_boilerplate():
    body = (PROSE * 3).strip()
    rest = "<div class='cookie-notice'>We use cookies</div>"
    side = f"<div class='sidebar'><p>{PROSE}</p></div><section id='comments'><article><p>First!</p></article></section>"
    for inner in (f"<article><p>{body}</p></article>", f"<main><p>{body}</p></main>", f"<div><p>{body}</p></div>"):
        page = f"<nav>x</nav><h1>T</h1>{inner}<div class='menu'>y</div>"
        for start in ("<body class='has-sidebar'>", "<html class='comments-open'><body>", "<form id=f>", "<div class='layout-sidebar-right'>"):
            assert h.main_text(f"{start}{page}") in (body, f"T\n{body}"), (start, inner)
        assert h.main_text(f"<body class=comments-open><form><div class='layout-sidebar-right'>{page}</div></form>{rest}") in (body, f"T\n{body}")
    assert h.main_text(f"<body><div class='has-sidebar'><article><p>{body}</p></article>{side}</div>{rest}") == body
    assert h.main_text(f"<main><p>Home</p><div class='layout-sidebar-right'><article><p>{body}</p></article></div></main>").endswith(body)
    assert h.main_text(f"<article><p>{body}</p></article>{side}") == body
    assert h.main_text(f"<article class='post category-social'><p>{body}</p></article>{side}") == body
    assert h.main_text(f"<div class='cookie-notice'>{body}</div>") == h.main_text(f"<nav>{body}</nav>") == ""


def _bare(page):
    """The page with its telling tags renamed and without attributes that name parts."""
    page = re.sub(r"<(/?)(article|nav|footer|header|aside|main|section)\b", r"<\1div", page)
    return re.sub(r"""\s(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def _words(text):
    return Counter(text.split())


def test_densities_find_the_article_without_its_tags(spark, monkeypatch):
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        return
    whole = found = more = 0
    bare = [_bare(r["html"]) for r in spark.read.parquet(path).collect()]
    texts = [h.main_text(p) for p in bare]
    for r, got in zip(spark.read.parquet(path).collect(), texts, strict=True):
        want, got = _words(h.main_text(r["html"])), _words(got)
        whole, found, more = whole + want.total(), found + (want & got).total(), more + (got - want).total()
    assert found >= 0.95 * whole and more <= 0.02 * whole
    monkeypatch.setattr(h, "STOP_WORDS", frozenset())
    assert [h.main_text(p) for p in bare] != texts


def _by_two_passes(blocks, rules=h.BlockRules()):
    """blocks: (text, linked share) without any structure; the labels by the rules as they are worded."""

    def first(text, links, low, high):
        words = re.findall(r"\w+", text.lower())
        density = sum(w in h.STOP_WORDS for w in words) / max(1, len(words))
        if links > rules.links:
            return -1
        if len(text) < rules.short:
            return 0
        if density >= high or len(text) > rules.long and density >= low:
            return 1
        return -1 if density < low else 0

    labels = [first(t, x, rules.low, rules.high) for t, x in blocks]
    if 1 not in labels:
        labels = [first(t, x, 0, 0) for t, x in blocks]
    out = []
    for i, label in enumerate(labels):
        near = sorted((abs(i - k), k, v) for k, v in enumerate(labels) if v)
        out.append(label or (near[0][2] if near else 1))
    return out


def test_two_passes_against_the_worded_rules():
    rng = random.Random(3)
    stop, other = sorted(h.STOP_WORDS), ["zyx" + c for c in "abcdefghij"]
    for _ in range(300):
        blocks, page = [], ""
        for _ in range(rng.randrange(1, 12)):
            share, n, links = rng.choice([0, 0.05, 0.12, 0.5]), rng.choice([2, 8, 20, 60]), rng.choice([0, 0, 0, 1])
            text = " ".join(rng.choice(stop) if rng.random() < share else rng.choice(other) for _ in range(n))
            blocks.append((text, links))
            page += f"<p><a href=x>{text}</a></p>" if links else f"<p>{text}</p>"
        want = [t for (t, _), label in zip(blocks, _by_two_passes(blocks), strict=True) if label > 0]
        assert h.main_text(page) == "\n".join(want)
