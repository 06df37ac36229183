"""Structured Streaming jobs: snapshot ingestion, de-duplication, watch steps and the outbox.

Each job is a plain DataFrame transformation between a source and a sink. Micro-batch sinks
write one folder per batch and overwrite it on replay, so running a batch again after a
failure gives the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import ingest_gate
from ..operators.versions import VECTOR, outbox_rows, watch_state, watch_steps

COMPACT_EVERY = 20
STATE_SCHEMA = "object_id STRING, version BIGINT, " + ", ".join(f"{c} STRING" for c in VECTOR) + ", decision STRING"


def _batch(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def ingest_stream(snapshots: DataFrame, path: str, checkpoint: str, now_ms: int) -> StreamingQuery:
    """Gate an unbounded snapshot feed; failed rows land beside the accepted ones."""
    gated = ingest_gate(snapshots, now_ms)
    lane = F.when(F.col("status") == "SOURCE_FAILURE", "failed").otherwise("accepted")
    return (
        gated.withColumn("lane", lane).writeStream.format("parquet").partitionBy("lane")
        .option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def _first_seen(rows: DataFrame, batch_id: int, path: str, key: str, time: str) -> DataFrame:
    """Rows of a micro-batch whose key neither the batch nor an earlier one has written.

    A replay carries the time of the first sending, so a batch is compared only with the days it
    touches itself, however late it comes.
    """
    rows = rows.dropDuplicates([key]).withColumn("day", F.to_date(time))
    if batch_id == 0:
        return rows
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    earlier = rows.sparkSession.read.schema(f"{key} STRING, day DATE, batch BIGINT").parquet(path)
    same_days = F.col("day").isNull() if first is None else F.col("day").between(first, last) | F.col("day").isNull()
    written = earlier.filter(same_days & (F.col("batch") < batch_id)).select(key)
    return rows.join(written, key, "left_anti")


def _deliver(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch by day; a batch run again overwrites its own partitions."""
    (
        rows.withColumn("batch", F.lit(batch_id)).hint("rebalance", "day").write.mode("overwrite").partitionBy("day", "batch")
        .option("partitionOverwriteMode", "dynamic").parquet(path)
    )


def dedupe_replay(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each event id once over all batches, whenever it comes; late events are kept.

    No watermark drops rows and no state grows: what was written is what was seen.
    """

    def once(batch: DataFrame, batch_id: int) -> None:
        _deliver(_first_seen(batch, batch_id, path, "event_id", "event_time"), batch_id, path)

    return (
        events.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_state(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """Latest state per object after the batches before `before`.

    Every batch writes the objects it touched, every twentieth all of them; so at most twenty
    folders are read.
    """
    if before == 0:
        return None
    last = before - 1
    folders = [_batch(path, b) for b in range(last - last % COMPACT_EVERY, before)]
    rows = spark.read.schema(STATE_SCHEMA).parquet(*folders)
    rest = [c for c in rows.columns if c != "object_id"]
    top = F.max_by(F.struct(*rest), F.col("version")).alias("s")
    return rows.groupBy("object_id").agg(top).select("object_id", "s.*")


def watch_stream(changes: DataFrame, path: str, state_path: str, checkpoint: str) -> StreamingQuery:
    """Turn a change stream into watch steps, carrying version and decision per object.

    Sequencing runs as ordered windows inside each micro-batch, which split a hot object over
    many tasks; between batches only one state row per object is kept.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = read_state(spark, state_path, batch_id)
        watch_steps(batch, state).write.mode("overwrite").parquet(_batch(path, batch_id))
        touched = watch_state(spark.read.parquet(_batch(path, batch_id)))
        if batch_id % COMPACT_EVERY == 0 and state is not None:
            touched = touched.unionByName(state.join(touched.select("object_id"), "object_id", "left_anti"))
        touched.write.mode("overwrite").parquet(_batch(state_path, batch_id))

    return (
        changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def outbox_sink(steps: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Two outbox rows per watch event, each id written once over all batches."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        rows = outbox_rows(batch).withColumn("sent", F.timestamp_millis("ts_ms"))
        _deliver(_first_seen(rows, batch_id, path, "outbox_id", "sent").drop("sent"), batch_id, path)

    return (
        steps.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def freshness_windows(readings: DataFrame, width: str = "1 hour") -> DataFrame:
    """Stale and failed share per source and tumbling window of (event_time, source, stale, failed) rows."""
    return readings.groupBy(F.window("event_time", width).alias("w"), "source").agg(
        F.count("*").alias("rows"), F.count_if("stale").alias("stale_rows"), F.count_if("failed").alias("failed_rows")
    ).select(F.unix_millis(F.col("w.start")).alias("window_start_ms"), "source", "rows", "stale_rows", "failed_rows")


def freshness_stream(readings: DataFrame, path: str, checkpoint: str, width: str = "1 hour") -> StreamingQuery:
    """Window counts of every micro-batch, to be added up by `read_freshness`; late rows count too."""

    def count(batch: DataFrame, batch_id: int) -> None:
        freshness_windows(batch, width).write.mode("overwrite").parquet(_batch(path, batch_id))

    return (
        readings.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_freshness(spark: SparkSession, path: str) -> DataFrame:
    """Counts per window and source over all batches."""
    counts = ["rows", "stale_rows", "failed_rows"]
    return spark.read.parquet(path).groupBy("window_start_ms", "source").agg(*[F.sum(c).alias(c) for c in counts])
