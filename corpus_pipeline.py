"""From raw documents to a training mix: five stages, each one of the operators in pairgraph.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet to the
shared folder and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairgraph.llm.common import table
from pairgraph.llm.decontaminate import drop_leaks
from pairgraph.llm.mixing import mix_sources
from pairgraph.llm.near_dup import drop_near_duplicates
from pairgraph.llm.quality_rules import keep_good
from pairgraph.llm.secret_scan import redact_secrets
from pairgraph.plans.store import discard, materialize, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or that are probably bad by the weighed votes, go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 the document of the smallest id stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item of the benchmark go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark. n_chars stays as the source gave it."""
    return redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with size, source_size, target, taken (words to take) and epochs.

    Columns of documents that are named like one of these come back with _in behind their names.
    """
    mixed = mix_sources(docs, carry=[c for c in docs.columns if c not in ("doc_id", "source")])
    return mixed.where("taken > 0").drop("sample_key")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
]

#: Near-duplicates and alignments have no SQL form; tests/llm/test_pipeline.py holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way goes once its result is written, and so does the
    result that it read."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            after = keep(materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-")))
        discard(docs)
        docs = after
    return docs
