"""URL filters against a list replayed day by day."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pairgraph.llm import url_filter as u


def parts(url):
    """(host, path, query) or None."""
    if not url or "://" not in url:
        return None
    rest = url.split("://", 1)[1].split("#", 1)[0]
    cut = min((rest.index(c) for c in "/?" if c in rest), default=len(rest))
    host = rest[:cut].lower().split("@")[-1].split(":")[0].rstrip(".")
    path, mark, query = rest[cut:].partition("?")
    return host, path or "/", mark + query


def keys_by_hand(url):
    if not (found := parts(url)) or not found[0]:
        return set()
    host, path, query = found
    labels, folder = host.split("."), path if path.endswith("/") else path + "/"
    out = {"host:" + ".".join(labels[i:]) for i in range(len(labels))}
    out |= {"prefix:" + host + folder[: i + 1] for i, c in enumerate(folder) if c == "/"}
    return out | {"url:" + host + path, "url:" + host + path + query}


def entry_key(kind, value):
    host, path, query = parts(value if "://" in value else "x://" + value)
    return f"{kind}:{host}" + {"host": "", "prefix": path if path.endswith("/") else path + "/", "url": path + query}[kind]


def test_against_replay(spark):
    rng = random.Random(4)
    at = lambda n: dt.datetime(2023, 1, 1) + dt.timedelta(hours=6 * n)
    hosts = ["a.example.com", "B.example.com", "example.org", "x.y.example.org", "lone"]
    urls = [f"http{'s' * (i % 2)}://{rng.choice(hosts)}{rng.choice(['', '/', '/p/q.html', '/p/', '/p', '/z?x=/p/', '#f', ':80/p/q.html', '?q'])}" for i in range(120)]
    urls += [None, "", "not a url", "http://", "http://user:pw@A.example.com./p/q.html", "http://lone/" + "a/" * 2000 + "?" + "b" * 100000]
    pages = [(i, x, at(rng.randrange(900)) if i % 11 else None, "k") for i, x in enumerate(urls)]
    pages += pages[:3]
    values = [("host", "example.com"), ("host", "b.example.com"), ("host", "org"), ("prefix", "a.example.com/p/"), ("url", "example.org/"), ("host", "LONE"), ("host", "http://Example.org:80/x")]
    values += [("prefix", "https://A.example.com/p"), ("prefix", "example.org"), ("url", "EXAMPLE.org/z?x=/p/"), ("url", "lone?q"), ("url", "a.example.com/p")]
    entries = [(rng.choice(["spam", "adult", "allow"]), *rng.choice(values), rng.choice(["add", "add", "remove"]), at(rng.randrange(900))) for _ in range(150)]
    entries += [("spam", "host", "lone", "remove", at(500)), ("spam", "host", "lone", "add", at(500))]  # removal counts last
    odd = [(None, "host", "lone", "add", at(0)), ("spam", None, "lone", "add", at(0)), ("spam", "host", "lone", "add", None), ("spam", "host", "lone", "drop", at(1)), ("spam", "net", "lone", "add", at(1))]
    captures = spark.createDataFrame(pages, "page_id long, url string, fetched timestamp, key string").withColumn("host", F.lit(1)).repartition(3)
    table = spark.createDataFrame(entries + odd, "list string, kind string, value string, action string, since timestamp")
    got = u.filter_urls(captures, table).collect()
    assert len(got) == len(pages)
    for r in got:
        _, url, when, _ = pages[r["page_id"]]
        assert r["fetched"] == when and r["host"] == (parts(url) or [""])[0]
        state = {}
        for name, kind, value, action, since in sorted(entries, key=lambda e: (e[4], e[3])):
            if when and since <= when:
                state[name, entry_key(kind, value)] = action
        mine = keys_by_hand(url)
        hits = sorted(f"{n}={k}" for (n, k), a in state.items() if a == "add" and k in mine)
        assert r["hits"] == ",".join(hits), url
        names = {h.split("=")[0] for h in hits}
        assert r["kept"] == (not names & {"spam", "adult"} or "allow" in names)


def test_empty(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", None)], "page_id long, url string, fetched date")
    none = spark.createDataFrame([], "list string, kind string, value string, action string, since date")
    assert [r["kept"] for r in u.filter_urls(captures, none).collect()] == [True]
    assert u.filter_urls(captures.limit(0), none).count() == 0
