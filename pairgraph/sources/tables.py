"""Readers: image folders, group and manifest CSV files, audits and cached tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgraph.functions.text import basename, content_hash, has_suffix, valid_filename

SUFFIXES = (".jpg", ".jpeg", ".png")


def discover_images(spark: SparkSession, folder: str, *, recursive: bool = False, content: bool = True) -> DataFrame:
    """(filename, path, length, content_hash and content if asked for) of the image files in a folder.

    One level unless recursive; suffixes in any case; a missing folder raises FileNotFoundError. Sort by
    filename where order matters.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    try:
        files = reader.load(folder if recursive else f"{folder.rstrip('/')}/*")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) or not _empty_folder(spark, folder):
            raise FileNotFoundError(folder) from error
        files = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    name = basename(F.col("path"))
    found = files.withColumn("filename", name).where(has_suffix(F.col("filename"), SUFFIXES))
    if not recursive:  # listing goes into subfolders that the pattern names
        found = found.where(F.regexp_extract("path", "^(.*)/[^/]*$", 1) == _qualified(spark, folder))
    cols = ["filename", "path", "length"]
    if content:
        found = found.withColumn("content_hash", content_hash(F.col("content")))
        cols += ["content_hash", "content"]
    return found.select(*cols)


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _empty_folder(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(path) and system.getFileStatus(path).isDirectory()


def _csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """All columns as text, under the header's names, without a byte order mark."""
    first = spark.read.text(path).limit(1).collect()
    header = [h.strip('"') for h in first[0][0].lstrip("﻿").rstrip("\r").split(",")] if first else []
    if len(set(header)) != len(header) or not {"filename", "group_id"} <= set(header):
        raise ValueError(f"{path}: needs a header with filename and group_id, each column once")
    # one column more shows rows with extra values
    schema = ", ".join(f"`c{i}` string" for i in range(len(header) + 1))
    rows = spark.read.option("header", True).option("enforceSchema", True).option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).csv(path)
    return rows, header


def csv_violations(rows: DataFrame) -> DataFrame:
    """(problem, filename) of rows (filename, group_id)."""
    say = lambda df, what: df.select(F.lit(what).alias("problem"), "filename")
    return (
        say(rows.where(~valid_filename(F.col("filename"))), "bad_name")
        .unionByName(say(rows.where("group_id IS NULL OR group_id = ''"), "empty_group"))
        .unionByName(say(rows.groupBy("filename").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate"))
    )


def read_manifest(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """A manifest's rows, all text. strict: exactly the two columns, in any order; else more may follow."""
    raw, header = _csv(spark, path)
    if strict and set(header) != {"filename", "group_id"}:
        raise ValueError(f"{path}: needs exactly the columns filename and group_id")
    if not raw.where(F.col(f"c{len(header)}").isNotNull()).isEmpty():
        raise ValueError(f"{path}: a row has more values than the header")
    rows = raw.select(*[F.col(f"c{i}").alias(h) for i, h in enumerate(header)])
    bad = csv_violations(rows).limit(5).collect()
    if bad:
        raise ValueError(f"{path}: " + ", ".join(f"{r['problem']} {r['filename']!r}" for r in bad))
    return rows


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return read_manifest(spark, path, strict=True).select("filename", "group_id")


def verify_audit(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """(problem, filename): files whose bytes differ from the audit's, or that one of the two lacks."""
    r = recorded.select("filename", F.col("content_hash").alias("recorded"))
    j = files.select("filename", "content_hash").join(r, "filename", "full_outer")
    problem = F.when(F.col("content_hash").isNull(), "missing").when(F.col("recorded").isNull(), "extra").when(F.col("content_hash") != F.col("recorded"), "changed")
    return j.select(problem.alias("problem"), "filename").where("problem IS NOT NULL")


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    schema = "failures ARRAY<STRUCT<failure_types: ARRAY<STRING>, predicted_groups: ARRAY<ARRAY<STRING>>, reference_group: ARRAY<STRING>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("failures").alias("f")).select("f.*")
