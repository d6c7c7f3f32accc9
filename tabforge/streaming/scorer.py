"""Score a stream of raw answers with a fitted model.

Scoring is stateless, so the batch function runs unchanged on a streaming
DataFrame: file source -> serve_features -> model -> append sink, with a
checkpoint for exactly-once file output and an ``availableNow`` trigger for
catch-up runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tabforge.operators.scoring import CONTRACT, score_batch, serve_features


def stream_score(
    spark: SparkSession,
    model,
    source_dir: str,
    schema: T.StructType,
    sink_dir: str,
    checkpoint_dir: str,
    classes: Sequence[str],
    keep: Sequence[str] = ("row_id",),
    max_files_per_trigger: int | None = None,
):
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(source_dir)
    scored = score_batch(model, serve_features(raw, keep=keep), CONTRACT, classes, keep=keep)
    q = (
        scored.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q
