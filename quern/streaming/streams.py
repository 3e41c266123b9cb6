"""Structured Streaming: newest versions, node liveness and ingestion, run over what is there (availableNow)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet file or folder as a stream. Files are picked by a pattern, as a stream's path must not be one file."""
    top, _, name = path.rpartition("/")
    at = f"{top}/{name[0]}[{name[1]}]{name[2:]}"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(at)


def drained(df: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs an aggregating stream to its end and returns its last row for each of keys.

    Each micro-batch writes the rows that it changed as a Parquet folder of its own, so neither the state nor all rows
    are rewritten or gathered, and a batch that runs again replaces itself. State and offsets are in the folder, too.
    """
    own = f"{folder}/stream-{uuid.uuid4().hex}"
    into_table(df, f"{own}/rows", f"{own}/offsets", mode="update")
    rows = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{own}/rows")
    others = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in others)).select(*df.columns)


def newest(log: DataFrame) -> DataFrame:
    """A stream of (seq, op, key, value) to the newest version of each key: state of one row a key."""
    return log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"), F.max_by("value", "seq").alias("value"))


def last_seen(beats: DataFrame) -> DataFrame:
    return beats.groupBy("node").agg(F.max("ts").alias("last_seen"))


def counted(events: DataFrame, delay: str, width: str) -> DataFrame:
    """Events by type in tumbling windows; rows later than `delay` are dropped, windows behind it are final."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def silent(beats: DataFrame, ttl: str, delay: str) -> DataFrame:
    """A stream of (node, ts) to (node, first_seen, offline_at, beats): a row each time a node has been silent for ttl.

    State is one open run of beats for each node; a run ends when the watermark, `delay` behind the newest beat, passes
    its last beat by ttl. Nodes that are still within ttl have no row yet.
    """
    runs = beats.withWatermark("ts", delay).groupBy("node", F.session_window("ts", ttl).alias("run")).agg(F.count("*").alias("beats"))
    return runs.select("node", F.col("run.start").alias("first_seen"), F.col("run.end").alias("offline_at"), "beats")


def into_table(df: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] = lambda x: x, mode: str = "append") -> None:
    """Group commit: each micro-batch is one atomic folder of Parquet files, batch=n."""
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: each(b).write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
