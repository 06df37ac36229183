"""Streaming jobs run over the whole tables until caught up; results are read back from their sinks."""

from pyspark.sql import functions as F

from ..fixed import NOW_MS
from ..operators.versions import outbox_rows, watch_steps
from ..session import scratch_path
from ..sources.bindings import StreamTables
from ..streaming import feeds
from .ingest_plans import GATE
from .registry import query
from .version_plans import WATCH


def _streams(t):
    return StreamTables(t.spark, t.folder)


def watched(t):
    """Watch steps written by the streaming job."""
    out, state, mark = (scratch_path(t.spark, label) for label in ("watch", "watch-state", "watch-mark"))
    feeds.watch_stream(_streams(t).changes.drop("ts"), out, state, mark).awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


@query("t1_watch_step", f"WITH {WATCH} SELECT * FROM steps")
def watch_step(t):
    return watched(t)


@query("t3_dedupe_replay", "SELECT event_id, object_id, change_type FROM b_changes")
def dedupe_replay(t):
    s = _streams(t)
    columns = ["event_id", "object_id", "change_type", F.col("ts").cast("timestamp").alias("event_time")]
    sent_twice = s.changes.select(*columns).unionByName(s.changes.select(*columns))
    out, mark = scratch_path(t.spark, "once"), scratch_path(t.spark, "once-mark")
    feeds.dedupe_replay(sent_twice, out, mark).awaitTermination()
    return t.spark.read.parquet(out).select("event_id", "object_id", "change_type")


@query("t5_outbox_sink", f"""WITH {WATCH}
SELECT watch_id || ':' || target AS outbox_id, watch_id, event_id, object_id, new_decision, severity, ts_ms, target
FROM steps, (VALUES ('WEBHOOK'), ('DISCORD')) v(target)""")
def outbox_sink(t):
    steps = scratch_path(t.spark, "steps")
    watch_steps(t.changes).write.parquet(steps)
    schema = t.spark.read.parquet(steps).schema
    out, mark = scratch_path(t.spark, "outbox"), scratch_path(t.spark, "outbox-mark")
    feeds.outbox_sink(t.spark.readStream.schema(schema).parquet(steps), out, mark).awaitTermination()
    return t.spark.read.parquet(out).drop("batch", "day")


@query("t5_outbox_rows", f"""WITH {WATCH}
SELECT watch_id || ':' || target AS outbox_id, watch_id, event_id, object_id, new_decision, severity, ts_ms, target
FROM steps, (VALUES ('WEBHOOK'), ('DISCORD')) v(target)""")
def outbox_batch(t):
    return outbox_rows(watch_steps(t.changes))


@query("t11_ingest_stream", f"""WITH {GATE}
SELECT snapshot_id, source_id, status, reason_code, CASE status WHEN 'SOURCE_FAILURE' THEN 'failed' ELSE 'accepted' END AS lane FROM gated""")
def ingest_stream(t):
    out, mark = scratch_path(t.spark, "gate"), scratch_path(t.spark, "gate-mark")
    feeds.ingest_stream(_streams(t).snapshots, out, mark, NOW_MS).awaitTermination()
    return t.spark.read.parquet(out).select("snapshot_id", "source_id", "status", "reason_code", "lane")
