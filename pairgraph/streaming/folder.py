"""A folder watched by Structured Streaming: each new batch of files groups the whole folder again.

Grouping looks at all images (the nearest neighbours of one depend on the others), so a batch triggers a run over
the complete folder; evidence of pairs that were measured before comes from the cache.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pairgraph.plans.config import Config, shipped_config
from pairgraph.plans.image_runs import load_images, run_classical
from pairgraph.plans.store import materialize
from pairgraph.sources.sinks import write_predictions


def watch_folder(spark: SparkSession, folder: str, output: str, checkpoint: str, *, config: Config | None = None, cache: str | None = None, once: bool = False) -> StreamingQuery:
    """Start the query; predictions are replaced as a whole after each batch."""
    settings = config or shipped_config()

    def regroup(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        images = materialize(load_images(spark, folder), "images")
        run = run_classical(images, settings, cache=cache)
        write_predictions(run.partition, images.select("filename"), output)

    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).load(f"{folder.rstrip('/')}/*").select("path", "length")
    writer = stream.writeStream.foreachBatch(regroup).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
