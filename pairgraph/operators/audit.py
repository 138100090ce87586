"""Audits of a package (its files and manifest) and their comparison."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgraph.functions.text import leaks_group


def repeated(rows: DataFrame, key: str, name: str = "filename") -> DataFrame:
    """(key, names, n): values that several rows share, with the sorted names."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(name)).alias("names"), F.count(F.lit(1)).alias("n")).where("n > 1")


def inverted(rows: DataFrame, value: str, out: str = "names", name: str = "filename") -> DataFrame:
    """(value, out): a map from names to values turned round, with the sorted names of each value."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.sort_array(F.collect_list(name)).alias(out))


def cross_group(rows: DataFrame, key: str) -> DataFrame:
    """repeated() values whose names lie in more than one group, with the number of groups."""
    g = rows.where(F.col(key).isNotNull()).groupBy(key)
    out = g.agg(F.array_sort(F.collect_list("filename")).alias("names"), F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("groups"))
    return out.where("n > 1 AND groups > 1")


def missing_and_extra(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(problem, filename): names of the manifest without a file, and files that it doesn't name."""
    m, f = manifest.select("filename").distinct(), files.select("filename").distinct()
    return (
        m.join(f, "filename", "left_anti").select(F.lit("missing").alias("problem"), "filename")
        .unionByName(f.join(m, "filename", "left_anti").select(F.lit("extra").alias("problem"), "filename"))
    )


def summary(rows: DataFrame, col: str | Column) -> DataFrame:
    """(minimum, median, maximum), null without rows."""
    c = F.col(col) if isinstance(col, str) else col
    return rows.agg(F.min(c).alias("minimum"), F.median(c).alias("median"), F.max(c).alias("maximum"))


def label_leak(manifest: DataFrame) -> DataFrame:
    """(leaked, n, fraction): names that begin with the label of their group."""
    hit = leaks_group(F.col("filename"), F.col("group_id"))
    return manifest.agg(
        F.coalesce(F.sum(hit.cast("long")), F.lit(0)).cast("long").alias("leaked"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("fraction"),
    )


def dataset_fingerprint(files: DataFrame, manifest_hash: str) -> str:
    """Digest of the manifest's hash and of every file's, by (hash, name).

    The digest of a sequence can't be split: rows are sorted by all tasks and stream through the driver, which
    holds a partition at a time.
    """
    digest = hashlib.sha256(f"manifest:{manifest_hash}\n".encode())
    for r in files.select("content_hash", "filename").orderBy("content_hash", "filename").toLocalIterator():
        digest.update(f"image:{r['filename']}:{r['content_hash']}\n".encode())
    return digest.hexdigest()


def audit(files: DataFrame, manifest: DataFrame) -> dict[str, DataFrame]:
    """The parts of an audit by name.

    files: filename, path, content_hash, length, perceptual_hash, width, height, format, decode_ok and the
    exposure measures dark, bright, luminance, sharpness. manifest: filename, group_id.
    """
    labelled = files.join(manifest.select("filename", "group_id"), "filename", "left")
    counts = files.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum((~F.col("decode_ok")).cast("long")), F.lit(0)).alias("undecodable"),
    )
    by = lambda *c: files.groupBy(*c).agg(F.count(F.lit(1)).alias("n"))
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("directory")
    return {
        "counts": counts,
        "formats": by("format"),
        "dimensions": by("width", "height"),
        "directories": files.groupBy(folder).agg(F.count(F.lit(1)).alias("n")),
        "inventory": missing_and_extra(manifest, files),
        "ambiguous_names": repeated(files, "filename", "path"),
        "duplicate_content": repeated(files, "content_hash"),
        "perceptual_collisions": repeated(files, "perceptual_hash"),
        "cross_group_collisions": cross_group(labelled, "perceptual_hash"),
        "label_leak": label_leak(manifest),
        "group_sizes": manifest.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups")),
        "dark": summary(files, "dark"),
        "bright": summary(files, "bright"),
        "luminance": summary(files, "luminance"),
        "sharpness": summary(files, "sharpness"),
    }


def shared_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(filename, changed): names of both audits and whether their content differs."""
    r = right.select("filename", F.col("content_hash").alias("other"))
    return left.select("filename", "content_hash").join(r, "filename").select("filename", (F.col("content_hash") != F.col("other")).alias("changed"))


def shared_values(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left_names, right_names): values that both audits hold."""
    return inverted(left, key, "left_names").join(inverted(right, key, "right_names"), key)


def relation_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(checked, disagreeing): pairs of shared names, and those grouped together on one side only.

    No pair is formed: pairs together are counted from group sizes, on the left, on the right and on both.
    """
    both = left.select("filename", F.col("group_id").alias("l")).join(right.select("filename", F.col("group_id").alias("r")), "filename")

    def together(*keys: str) -> DataFrame:
        n = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else both.agg(F.count(F.lit(1)).alias("n"))
        return n.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs")).withColumn("one", F.lit(1))

    a, b = together("l"), together("r").withColumnRenamed("pairs", "on_right")
    c, d = together("l", "r").withColumnRenamed("pairs", "on_both"), together().withColumnRenamed("pairs", "checked")
    j = a.join(b, "one").join(c, "one").join(d, "one")
    return j.select("checked", (F.col("pairs") + F.col("on_right") - 2 * F.col("on_both")).alias("disagreeing"))


def compare_audits(left: DataFrame, right: DataFrame) -> dict[str, DataFrame]:
    """left, right: filename, content_hash, perceptual_hash, group_id."""
    return {
        "names": shared_names(left, right),
        "content": shared_values(left, right, "content_hash"),
        "perceptual": shared_values(left, right, "perceptual_hash"),
        "relations": relation_changes(left, right),
    }
