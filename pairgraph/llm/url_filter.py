"""URL filters whose lists change over time.

A list is a table of dated entries (list, kind, value, action, since): a host, a URL prefix or a whole URL is
added to a list or taken off it at a time. Entries become validity intervals, [since, next entry of the same key),
and the intervals of a key are one row. URLs give keys (the host and the domains above it, the URL, the folders above
it); keys of hosts and of folders are formed once for each host and folder, and those that no list holds are dropped before
anything is gathered by URL. Every capture then meets the intervals of its URL's keys, and those that hold its fetch time
decide. No row is multiplied by time, and no side of a join is chosen by size: what is joined grows with the data
on both sides. DataFrame expressions throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgraph.plans.store import materialize


@dataclass(frozen=True)
class Lists:
    """block: names of lists that reject. allow: names of lists that overrule them."""

    block: tuple[str, ...] = ("spam", "adult")
    allow: tuple[str, ...] = ("allow",)


def host_of(url: Column) -> Column:
    """The host in lower case without user, port and closing dot; empty where the URL has none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(host, r"\.$", "")


def path_of(url: Column) -> Column:
    """The path without query and fragment, at least a slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def query_of(url: Column) -> Column:
    """The query with its question mark; empty where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*(\?[^#]*)", 1)


def host_keys(host: Column) -> Column:
    """host: keys of the host and of every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def folder_of(path: Column) -> Column:
    """The path as a folder, ending at a slash."""
    return F.when(F.endswith(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/")))


def folder_keys(host: Column, folder: Column) -> Column:
    """prefix: keys of every folder from the root to this one."""
    parts = F.split(folder, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))
    )


def entry_key(kind: Column, value: Column) -> Column:
    """The key of an entry; kind is host, prefix or url. A value is brought to the form of captures: with or without
    scheme, any case of the host, port and user dropped, a prefix ending at a slash. An entry of kind url with a
    query means that query only, and without one any."""
    url = F.when(F.rlike(value, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), value).otherwise(F.concat(F.lit("http://"), value))
    rest = F.when(kind == "host", "").when(kind == "prefix", folder_of(path_of(url))).otherwise(F.concat(path_of(url), query_of(url)))
    return F.concat(kind, F.lit(":"), host_of(url), rest)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, start, end): when a key is on a list, timestamps, end exclusive and null while it lasts.

    Of entries of one list and key at the same time a removal counts last; entries with a null in any of their
    columns, or another kind or action, are ignored.
    """
    known = entries.select("list", entry_key(F.col("kind"), F.col("value")).alias("key"), "kind", "action", F.col("since").cast("timestamp").alias("since"))
    known = known.where(F.col("kind").isin("host", "prefix", "url") & F.col("action").isin("add", "remove") & F.col("key").isNotNull())
    once = known.where("list IS NOT NULL AND since IS NOT NULL").groupBy("list", "key", "since").agg(F.max("action").alias("action"))
    after = Window.partitionBy("list", "key").orderBy("since")
    return once.withColumn("end", F.lead("since").over(after)).where("action = 'add'").select("list", "key", F.col("since").alias("start"), "end")


def filter_urls(
    captures: DataFrame,
    entries: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    time_col: str = "fetched",
    lists: Lists = Lists(),
) -> DataFrame:
    """Per row of captures: the id, host, fetched (as it came), hits and kept.

    hits lists list=key of all entries active when the page was fetched, sorted and comma-joined; kept is false
    if a blocking list hits and no allowing one does. Null URLs, URLs without a host and null fetch times hit
    nothing and are kept, with an empty host where there is none. Equal rows come back one by one; without
    entries all are kept; an empty table gives no rows; extra columns are ignored.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = captures.select(F.col(id_col).alias("id"), url.alias("url"), F.col(time_col).alias("fetched"))
    span = F.struct("list", "start", "end")
    listed = materialize(intervals(entries).groupBy("key").agg(F.collect_list(span).alias("spans")), "url-intervals")
    keys = listed.select("key")

    def held(places: DataFrame, made: Column) -> DataFrame:
        """The places with those of their keys that some list holds."""
        by = places.columns
        each = places.distinct().select(*by, F.explode(made).alias("key"))
        return each.join(keys.hint("merge"), "key").groupBy(by).agg(F.collect_set("key").alias("keys"))

    urls = materialize(rows.select("url").distinct().withColumn("host", host_of(F.col("url"))).where("host <> ''"), "url-distinct")
    at = urls.withColumn("path", path_of(F.col("url")))
    whole = F.concat(F.lit("url:"), "host", "path")
    by_host = held(at.select("host"), host_keys(F.col("host")))
    by_folder = held(at.select("host", folder_of(F.col("path")).alias("folder")), folder_keys(F.col("host"), F.col("folder")))
    own = at.select("url", F.explode(F.array_distinct(F.array(whole, F.concat(whole, query_of(F.col("url")))))).alias("key"))
    found = (
        own.join(keys.hint("merge"), "key").select("url", "key")
        .unionByName(at.select("url", "host").join(by_host.hint("merge"), "host").select("url", F.explode("keys").alias("key")))
        .unionByName(
            at.select("url", "host", folder_of(F.col("path")).alias("folder")).join(by_folder.hint("merge"), ["host", "folder"]).select("url", F.explode("keys").alias("key"))
        )
    )
    each = found.join(listed.hint("merge"), "key").select("url", F.explode(F.transform("spans", lambda s: F.struct(s.alias("s"), F.concat_ws("=", s["list"], "key").alias("name")))).alias("hit"))
    history = materialize(each.groupBy("url").agg(F.collect_list("hit").alias("history")), "url-history")

    when = F.col("fetched").cast("timestamp")
    active = F.filter("history", lambda h: (h["s"]["start"] <= when) & (h["s"]["end"].isNull() | (when < h["s"]["end"])))
    joined = rows.join(history.hint("merge"), "url", "left").withColumn("active", F.coalesce(active, F.slice("history", 1, 0)))
    on = lambda names: F.exists("active", lambda h: h["s"]["list"].isin(*names))
    return joined.select(
        F.col("id").alias(id_col),
        host_of(F.col("url")).alias("host"),
        "fetched",
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("active", lambda h: h["name"]))), ","), F.lit("")).alias("hits"),
        F.coalesce(~on(lists.block) | on(lists.allow), F.lit(True)).alias("kept"),
    )
