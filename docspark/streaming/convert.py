"""Conversion of document streams.

``convert`` is narrow and stateless, so a stream needs no watermark; documents
that arrive twice are dropped by id within one where asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.operators import convert as batch
from docspark.plans import render


def read(spark: SparkSession, path: str, schema: str = "doc_id bigint, adf string") -> DataFrame:
    """A stream of Parquet files of documents."""
    return spark.readStream.schema(schema).parquet(path)


def converted(stream: DataFrame, options: render.Options = render.Options(), hooks: batch.Hooks = batch.Hooks(), event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    if event_time:
        stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["doc_id"])
    return batch.convert(stream, options, hooks)


def write(results: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Exactly-once Parquet files; with available_now the query ends when the input is used up."""
    out = results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()
