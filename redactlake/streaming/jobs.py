"""Structured Streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.session import work_folder
from redactlake.streaming import state


def _new_folder(spark: SparkSession, job: str) -> str:
    return f"{work_folder(spark)}/{job}-{uuid.uuid4().hex}"


# --- debounce ---------------------------------------------------------------
def debounce(stream: DataFrame, key: Sequence[str], ts: str, tie: str, gap: str, watermark: str) -> DataFrame:
    """Trailing-edge debounce of a stream: the last event once a key has been quiet for ``gap``.

    The watermark only bounds the state; it is ours, not part of the debounce rule.
    """
    others = [c for c in stream.columns if c not in key]
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(*key, F.session_window(ts, gap).alias("session"))
        .agg(F.max_by(F.struct(*others), F.struct(ts, tie)).alias("last"))
        .select(*key, "last.*")
    )


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored Parquet table, one file or a folder of files, as a stream."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if status.isDirectory():
        return source.parquet(path)
    folder, name = path.rsplit("/", 1)
    return source.option("pathGlobFilter", name).parquet(folder)


def run_debounce(spark: SparkSession, path: str, gap: str, watermark: str) -> DataFrame:
    """Debounce a stored event table, to the last session.

    A second run of the same query reads a marker event from after the end, which
    moves the watermark past the sessions that the table leaves open.
    """
    base = _new_folder(spark, "debounce")
    columns = ["user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")]
    stored = spark.read.parquet(path).select(*columns)
    marker = stored.agg(F.max("ts").alias("ts")).select(
        F.lit(None).cast(stored.schema["user_id"].dataType).alias("user_id"), F.lit(None).cast(stored.schema["event_id"].dataType).alias("event_id"),
        (F.col("ts") + F.expr(f"INTERVAL {gap}") + F.expr(f"INTERVAL {watermark}") + F.expr("INTERVAL 1 SECOND")).alias("ts"),
    )
    marker.limit(0).write.parquet(f"{base}/marker")

    def run() -> None:
        source = stream_table(spark, path).select(*columns).unionByName(spark.readStream.schema(stored.schema).parquet(f"{base}/marker"))
        out = debounce(source, ["user_id"], "ts", "event_id", gap, watermark)
        sink = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run()
    marker.write.mode("append").parquet(f"{base}/marker")
    run()
    return spark.read.schema(stored.schema).parquet(f"{base}/out").select("event_id", "user_id")


# --- redaction --------------------------------------------------------------
def run_redact_stream(spark: SparkSession, conversation_items: DataFrame) -> DataFrame:
    """Feed conversation turns through the stream as they would arrive, a few turns a file, and return the result."""
    base = _new_folder(spark, "redact")
    turn = F.col("turn").cast("bigint")
    events = conversation_items.select(
        F.col("conv_id").cast("string").alias("scope"), F.col("turn").cast("string").alias("item_id"), turn.alias("rev"), turn.alias("item_ord"),
        F.lit(state.PUT).alias("event"), "text",
    )
    for first, last in ((None, 1), (2, 4), (5, None)):
        part = events.filter(F.lit(True) if first is None else turn >= first).filter(F.lit(True) if last is None else turn <= last)
        part.write.mode("append").parquet(f"{base}/in")
        stream = state.redact_events(spark.readStream.schema(state.EVENTS).parquet(f"{base}/in"), salt="demo")
        state.start(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select("scope", "item_ord", "redacted")


def run_revisions(spark: SparkSession, revisions: Sequence[DataFrame], keep_texts: bool = True) -> DataFrame:
    """Feed revisions of scopes through the stream one after another; the records of all events."""
    base = _new_folder(spark, "revisions")
    records = None
    for events in revisions:
        events.write.mode("append").option("compression", "zstd").parquet(f"{base}/in")
        records = state.run_events(spark, f"{base}/in", base, salt="demo", keep_texts=keep_texts, files=1000)
    return records
