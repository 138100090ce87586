"""Writers: predictions, canonical JSON artifacts and tables keyed by fingerprint."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgraph.operators.partitions import canonical, validate
from pairgraph.plans.config import canonical_json


def write_predictions(partition: DataFrame, expected: DataFrame, path: str | Path) -> Path:
    """The validated partition as CSV in canonical order, with ids from 0; the bytes depend on the groups alone.

    The file is one CSV by contract, so its rows stream through the driver.
    """
    validate(partition, expected)
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    with part.open("w", encoding="utf-8", newline="") as out:
        out.write("filename,group_id\n")
        for r in canonical(partition).orderBy("group_no", "filename").toLocalIterator():
            name = r["filename"]
            quoted = '"' + name.replace('"', '""') + '"' if any(c in name for c in ',"\n\r') else name
            out.write(f"{quoted},{r['group_no']}\n")
    os.replace(part, target)
    return target


def write_json(path: str | Path, value: Any) -> Path:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    part.write_text(canonical_json(value), encoding="utf-8")
    os.replace(part, target)
    return target


class Memo:
    """Rows kept as Parquet under fp=<fingerprint>, found again by key columns.

    What is there is never computed twice: lookup() splits rows into hits and misses, put() appends. Rows that
    were appended twice are read once, the latest one winning.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str):
        self.spark, self.folder, self.keys, self.schema = spark, folder.rstrip("/"), keys, schema

    def path(self, fingerprint: str) -> str:
        return f"{self.folder}/fp={fingerprint}"

    def read(self, fingerprint: str) -> DataFrame:
        try:
            rows = self.spark.read.schema(self.schema + ", put_seq long").parquet(self.path(fingerprint))
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], self.schema)
        cols = [c for c in rows.columns if c != "put_seq"]
        return rows.groupBy(self.keys).agg(F.max_by(F.struct(*cols), "put_seq").alias("r")).select("r.*")

    def lookup(self, wanted: DataFrame, fingerprint: str) -> tuple[DataFrame, DataFrame]:
        """(hits with their kept columns, misses) of rows that hold the keys."""
        kept = self.read(fingerprint)
        return wanted.join(kept, self.keys), wanted.join(kept, self.keys, "left_anti")

    def put(self, rows: DataFrame, fingerprint: str) -> None:
        import time

        rows.withColumn("put_seq", F.lit(time.time_ns())).write.mode("append").parquet(self.path(fingerprint))
