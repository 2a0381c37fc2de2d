"""Streams into indices, and windows over streams.

Each micro-batch of operations is one bulk write.  A batch that is replayed after a failure is recognised by its id, so nothing is applied twice.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files, storage


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_bulk(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """NDJSON bulk bodies, a file each, as lines with their place."""
    return files.with_place(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


class _Once:
    """Remembers the last batch that was applied, beside the stream's checkpoint."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.path = spark, f"{checkpoint}/applied.json"

    def seen(self, batch: int) -> bool:
        return storage.exists(self.spark, self.path) and batch <= json.loads(storage.read_text(self.spark, self.path))["batch"]

    def mark(self, batch: int) -> None:
        storage.write_text(self.spark, self.path, json.dumps({"batch": batch}))


def into_index(stream: DataFrame, catalog, index: str, checkpoint: str, key: str, order: str | None = None, pipeline: str | None = None, available_now: bool = True):
    """Upserts the stream's rows into an index by key; of rows of one key in a batch, the last by order stays."""
    once = _Once(catalog.spark, checkpoint)

    def write(batch: DataFrame, n: int) -> None:
        if not once.seen(n):
            catalog.put(index, batch.withColumn("_id", F.col(f"`{key}`").cast("string")), pipeline, order)
            once.mark(n)

    return _start(stream, write, checkpoint, available_now)


def bulk_into(stream: DataFrame, catalog, schema: T.StructType, checkpoint: str, index: str | None = None, available_now: bool = True):
    """Applies the bulk operations of read_bulk's lines; bodies of a batch apply in the order of their files' names."""
    once = _Once(catalog.spark, checkpoint)

    def write(batch: DataFrame, n: int) -> None:
        if not once.seen(n):
            ops = files.bulk_operations(batch.withColumn("line", F.monotonically_increasing_id()), files.PLACE, schema, index)
            catalog.bulk(ops, None, most=None)
            once.mark(n)

    return _start(stream, write, checkpoint, available_now)


def _start(stream: DataFrame, write, checkpoint: str, available_now: bool):
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/stream")
    return (w.trigger(availableNow=True) if available_now else w).start()


def date_histogram(stream: DataFrame, time: str, interval: str, late: str = "10 minutes", by: str | None = None, value: str | None = None, slide: str | None = None) -> DataFrame:
    """key (epoch ms of the window's start), doc_count and, if value is named, sum_value, per tumbling or sliding window.

    In append and update mode, rows later than `late` are dropped and closed windows leave the state; complete mode keeps and updates all windows.
    """
    t = F.col(time).cast("timestamp")
    keyed = stream.withColumn(time, t).withWatermark(time, late)
    groups = [F.window(F.col(time), interval, slide) if slide else F.window(F.col(time), interval)] + ([F.col(by)] if by else [])
    found = keyed.groupBy(*groups).agg(F.count("*").alias("doc_count"), *([F.sum(value).alias("sum_value")] if value else []))
    return found.select(F.unix_millis("window.start").alias("key"), *([by] if by else []), "doc_count", *(["sum_value"] if value else []))
