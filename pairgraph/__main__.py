"""python -m pairgraph COMMAND: audit, compare-audits, score, run, final-evaluate, summarize, gallery, sweep, fingerprint, group, benchmark."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from pairgraph.plans import lifecycle
from pairgraph.plans.config import canonical_hash, canonical_json, load_config
from pairgraph.plans.registry import RunRegistry
from pairgraph.sources.sinks import write_json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairgraph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: str, more: tuple[str, ...] = ()) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for o in options:
            c.add_argument(f"--{o}", required=True)
        for o in more:
            c.add_argument(f"--{o}")
        return c

    add("audit", "dataset-root", "manifest", more=("output",))
    add("compare-audits", "left", "right", more=("output",))
    add("score", "reference", "predictions")
    run = ("dataset-root", "manifest", "config", "output-root", "registry")
    add("run", *run, more=("split", "cache-root", "audit", "parent-run-id", "hypothesis-id"))
    add("final-evaluate", *run, "split", "commit", "config-hash", "split-hash", more=("cache-root", "audit"))
    add("summarize", "registry").add_argument("--limit", type=int, default=20)
    add("gallery", "dataset-root", "diagnostics", "output-dir")
    add("sweep", "root", "definition", "dataset-root", "manifest", "output-root", "registry", more=("cache-root", "output"))
    add("fingerprint", more=("config", "split"))
    add("group", "input-dir", "output-dir")
    add("benchmark", "dataset-root", "manifest", more=("split", "output"))
    return p


def main(argv: list[str] | None = None) -> Any:
    a = parser().parse_args(argv)
    if a.command == "fingerprint":
        if bool(a.config) == bool(a.split):
            raise SystemExit("give exactly one of --config and --split")
        out: Any = {"sha256": load_config(a.config).config_hash if a.config else canonical_hash(json.loads(Path(a.split).read_text("utf-8")))}
        print(canonical_json(out), end="")
        return out
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("pairgraph").getOrCreate()
    load = lambda path: json.loads(Path(path).read_text("utf-8"))

    def recorded():
        if not getattr(a, "audit", None):
            return None
        value = load(a.audit)
        if value.get("schema_version") != 1 or value.get("integrity_failures") or value.get("manifest_sha256") != lifecycle.file_hash(a.manifest):
            raise ValueError("the audit is of another schema or manifest, or reports failures")
        return spark.createDataFrame(list(value["image_sha256"].items()), "filename string, content_hash string")

    def evaluation(**more: Any) -> dict[str, Any]:
        o = lifecycle.run_evaluation(
            spark, dataset_root=a.dataset_root, manifest_path=a.manifest, config_path=a.config, output_root=a.output_root,
            registry_path=a.registry, split_path=a.split, cache_root=a.cache_root, recorded=recorded(), **more,
        )
        return {"run_id": o.run_id, "folder": str(o.folder), "metrics": o.metrics, "resources": o.resources}

    if a.command == "audit":
        out = lifecycle.audit_package(spark, a.dataset_root, a.manifest)
    elif a.command == "compare-audits":
        out = lifecycle.compare_packages(spark, load(a.left), load(a.right))
    elif a.command == "score":
        out = lifecycle.score_files(spark, a.reference, a.predictions)
    elif a.command == "run":
        out = evaluation(parent_run_id=a.parent_run_id, hypothesis_id=a.hypothesis_id)
    elif a.command == "final-evaluate":
        lifecycle.check_frozen(".", commit=a.commit, config_path=a.config, config_hash=a.config_hash, split=load(a.split), split_hash=a.split_hash)
        out = evaluation(allow_protected=True)
    elif a.command == "summarize":
        out = RunRegistry(spark, a.registry).recent(a.limit)
    elif a.command == "gallery":
        from pairgraph.plans.gallery import render_gallery
        from pairgraph.plans.image_runs import load_images
        from pairgraph.sources.tables import read_diagnostics

        out = {"index": str(render_gallery(load_images(spark, a.dataset_root, recursive=True), read_diagnostics(spark, a.diagnostics), a.output_dir))}
    elif a.command == "sweep":
        out = lifecycle.run_sweep(
            spark, load(a.definition), root=a.root, dataset_root=a.dataset_root, manifest_path=a.manifest, output_root=a.output_root,
            registry_path=a.registry, cache_root=a.cache_root,
        )
    elif a.command == "benchmark":
        out = lifecycle.benchmark(spark, dataset_root=a.dataset_root, manifest_path=a.manifest, split_path=a.split)
    else:
        from pairgraph.plans.image_runs import group_folder

        out = {"predictions": str(group_folder(spark, a.input_dir, a.output_dir))}
    if getattr(a, "output", None):
        write_json(a.output, out)
    print(canonical_json(out), end="")
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
