"""The registered queries opN_<name>, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgraph.llm.common import table


def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairgraph.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairgraph.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairgraph.llm.quality_rules import score_quality

    return score_quality(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairgraph.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairgraph.llm.near_dup import NearDup, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), params=NearDup(words=4))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries made up from the hosts and URLs that occur, as the tables hold no list."""
    from pairgraph.llm.url_filter import host_of, path_of

    def number(key):
        return F.conv(F.substring(F.md5(key.cast("binary")), 1, 6), 16, 10).cast("int")

    def entry(rows, where, name, kind, value, action, days):
        day = F.date_add(F.lit("2024-01-01").cast("date"), F.expr(days))
        return rows.where(where).select(
            F.lit(name).alias("list"), F.lit(kind).alias("kind"), F.expr(value).alias("value"), F.lit(action).alias("action"), day.alias("since")
        )

    at = pages.where("url IS NOT NULL").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    hosts = at.select("host").distinct().withColumn("n", number(F.col("host")))
    urls = at.select(F.concat("host", "path").alias("url")).distinct().withColumn("n", number(F.col("url")))
    out = entry(hosts, "n % 3 = 0", "spam", "host", "host", "add", "n % 400")
    for more in (
        entry(hosts, "n % 6 = 0", "spam", "host", "host", "remove", "n % 400 + 90"),
        entry(hosts, "n % 12 = 0", "spam", "host", "host", "add", "n % 400 + 150"),
        entry(hosts, "n % 5 = 1", "adult", "prefix", "concat(host, '/en/')", "add", "n % 300"),
        entry(hosts, "n % 7 = 2", "allow", "prefix", "concat(host, '/')", "add", "n % 500"),
        entry(urls, "n % 10 = 0", "adult", "url", "url", "add", "n % 600"),
    ):
        out = out.unionByName(more)
    return out


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch time, so a day is made up from the id."""
    from pairgraph.llm.url_filter import filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 700).cast("int"))
    return filter_urls(pages.withColumn("fetched", day), list_entries(pages))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairgraph.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents")).drop("secrets")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairgraph.llm.html_extract import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairgraph.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairgraph.llm.substring_dedup import cut_spans

    cut = cut_spans(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_units",
        F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"]).alias("n_chars_cut"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
        "first_ids",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and name[2].isdigit() and callable(f)}
