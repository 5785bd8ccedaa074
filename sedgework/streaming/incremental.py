"""Incremental refresh as a stream: each micro-batch of sightings is an idempotent batch of the manifest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sedgework.operators.incremental import Manifest

SCHEMA = "path string, size long, checksum string"


def refresh_stream(
    spark: SparkSession, source: str, root: str, process: Callable[[DataFrame], DataFrame], checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Process listings that arrive as Parquet files in ``source`` and stop when all are done.

    The identifier of a batch is that of the stream, which its checkpoint keeps, and
    the micro-batch's number. A batch that Spark repeats after a failure is found
    committed or overwrites its own leavings. A new checkpoint or another stream on
    the same root numbers anew under an identifier of its own: what it sees again is
    not pending, what it sees first is processed. So records are neither skipped nor
    repeated.
    """
    manifest = Manifest(spark, root)

    def each(batch: DataFrame, number: int) -> None:
        manifest.run(f"{stream_id(spark, checkpoint)}-{number:010d}", batch, process)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identifier that Spark wrote into a checkpoint when its stream first started."""
    lines = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").collect()
    return json.loads("".join(r.value for r in lines))["id"]
