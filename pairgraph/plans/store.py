"""Tables in the folder that driver and executors share, to cut lineage.

The folder is the one that the session names in ``spark.checkpoint.dir``; only where that is unset and driver and
executors are one process (master local) does a temporary folder stand in. Files written there outlive a lost executor,
unlike blocks of a local checkpoint. Tables of one application share a folder; clear() deletes it once their results are
stored, and scratch() what was written inside it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, set to a local temporary one only where the session names none and runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pairgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pairgraph/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, with its lineage cut."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    for written in _open_scopes:
        written.append(path)
    out = spark.read.schema(schema).parquet(path)
    out._pairgraph_path = path
    return out


_open_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at the end what materialize() writes inside, but for the tables that are passed to what this yields."""
    written: list[str] = []
    kept: set[str | None] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, "_pairgraph_path", None))
        return df

    _open_scopes.append(written)
    try:
        yield keep
    finally:
        _open_scopes.remove(written)
    for path in written:
        if path not in kept:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing lazy reads it any more."""
    for df in tables:
        path = getattr(df, "_pairgraph_path", None)
        if path:
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote; results that were not stored elsewhere go with them."""
    _delete(spark, _folder(spark))


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside, as rows may be long: memory is a batch's size."""
    was = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, was)
