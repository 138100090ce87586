"""A run registry as an append-only Parquet event table, folded to the latest state of each run."""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = (
    "run_id", "started_at", "finished_at", "git_commit", "dirty_tree", "config_path", "config_hash", "dataset_fingerprint",
    "split_id", "split_fingerprint", "cache_schema_versions", "seed", "status", "parent_run_id", "hypothesis_id", "metrics",
    "resources", "artifact_paths", "notes",
)
REQUIRED = ("run_id", "started_at", "git_commit", "dirty_tree", "config_path", "config_hash", "dataset_fingerprint", "split_id", "seed")
FINAL = ("passed", "failed", "reverted")
_TYPES = {"dirty_tree": "boolean", "seed": "long"}
SCHEMA = ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in COLUMNS) + ", event_seq long"


def utc_now() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds")


def latest(events: DataFrame, key: str = "run_id", seq: str = "event_seq") -> DataFrame:
    """The last event of each key."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*events.columns), F.struct(F.col(seq), F.to_json(F.struct(*events.columns)))).alias("e"))
    return last.select("e.*")


def recent(runs: DataFrame, n: int = 20) -> DataFrame:
    if n <= 0:
        raise ValueError("n must be positive")
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


class RunRegistry:
    """start() and finish() append events; runs() folds them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as error:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def _append(self, row: dict[str, Any]) -> None:
        row = row | {"event_seq": time.time_ns()}
        values = [tuple(row.get(c) for c in (*COLUMNS, "event_seq"))]
        self.spark.createDataFrame(values, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def start(self, record: dict[str, Any]) -> None:
        missing = [c for c in REQUIRED if record.get(c) is None]
        if missing or set(record) - set(COLUMNS):
            raise ValueError(f"missing {missing}, unknown {sorted(set(record) - set(COLUMNS))}")
        if not self.runs().where(F.col("run_id") == record["run_id"]).isEmpty():
            raise ValueError("the run is registered already")
        empty = {"metrics": "{}", "resources": "{}", "artifact_paths": "{}", "notes": "", "cache_schema_versions": "{}"}
        coded = {k: v if isinstance(v, (str, bool, int, type(None))) else json.dumps(v, sort_keys=True) for k, v in record.items()}
        self._append(empty | coded | {"status": "running"})

    def finish(self, run_id: str, status: str, *, metrics=None, resources=None, artifact_paths=None, notes: str = "") -> None:
        if status not in FINAL:
            raise ValueError(f"status must be one of {FINAL}")
        found = self.runs().where(F.col("run_id") == run_id).collect()
        if not found:
            raise KeyError(run_id)
        done = {k: json.dumps(v or {}, sort_keys=True) for k, v in (("metrics", metrics), ("resources", resources), ("artifact_paths", artifact_paths))}
        self._append(found[0].asDict() | done | {"status": status, "finished_at": utc_now(), "notes": notes})

    def runs(self) -> DataFrame:
        return latest(self.events()).drop("event_seq")

    def recent(self, n: int = 20) -> list[dict[str, Any]]:
        out = [r.asDict() for r in recent(self.runs(), n).collect()]
        for r in out:
            for c in ("cache_schema_versions", "metrics", "resources", "artifact_paths"):
                r[c] = json.loads(r[c] or "{}")
        return out

    def contains_split(self, split_id: str) -> bool:
        return not self.events().where(F.col("split_id") == split_id).limit(1).isEmpty()
