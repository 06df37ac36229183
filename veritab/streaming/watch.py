"""Watch steps as a stream: versions by keyed state, then verification and policy of what was touched.

A change carries the collections that it replaces, in full; null carries a collection over and an empty
list clears it. The state of an object is its version, the last change applied and its collections,
each in a store of its own, so that a change writes only what it replaces. A micro-batch reads and
writes the state of the objects it touches and no other.

The stateful step only builds versions. Its rows, with the children that each version sees, are
written per micro-batch and go through the same verification, status and policy operators as a batch
of versions. The version before the first of a batch comes along, so that the previous decision is
found without a table of decisions.

A change at or before the last one applied is a replay and makes no version; a batch that runs again
overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import history
from ..operators.history import COLLECTIONS

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CHILD_FIELDS = {
    "claims": {"claim_id": "string", "property": "string", "state": "string", "evidence_refs": "array<string>", "attestation_refs": "array<string>"},
    "evidence": {
        "evidence_id": "string", "type": "string", "content_hash": "string", "observed_at": "long", "authority": "string", "freshness": "string",
    },
    "attestations": {"attestation_id": "string", "state": "string", "expires_at": "long", "attestor": "string", "signature": "string"},
    "exceptions": {"exception_id": "string", "type": "string"},
}
CHILD_TYPES = {c: "array<struct<" + ",".join(f"{n}:{t}" for n, t in fields.items()) + ">>" for c, fields in CHILD_FIELDS.items()}
CHANGE_SCHEMA = "object_id string, seq string, ts_ms long, change_type string, " + ", ".join(f"{c} {CHILD_TYPES[c]}" for c in COLLECTIONS)
VERSION_SCHEMA = "object_id string, version long, seq string, ts_ms long, change_type string, fresh boolean, " + ", ".join(f"{c} {CHILD_TYPES[c]}" for c in COLLECTIONS)
HEAD = ("version", "seq", "ts_ms", "change_type")

Version = Row("object_id", *HEAD, "fresh", *COLLECTIONS)


def nested_changes(changes: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Changes (object_id, seq, ts_ms, change_type, sets_<collection>) with the collections they replace inside, as CHANGE_SCHEMA.

    A list is as long as one change's collection.
    """
    keys = ["object_id", "seq"]
    out = changes
    for name, fields in CHILD_FIELDS.items():
        held = children[name].groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(f).cast(t).alias(f) for f, t in fields.items()]))).alias(name))
        empty = F.array().cast(CHILD_TYPES[name])
        out = out.join(held, keys, "left").withColumn(name, F.when(F.col(f"sets_{name}"), F.coalesce(name, empty)))
    return out.select(*keys, "ts_ms", "change_type", *COLLECTIONS)


class VersionKeeper(StatefulProcessor):
    """Turns the changes of an object into its versions."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "version long, seq string, ts_ms long, change_type string")
        self.parts = {c: handle.getValueState(c, f"rows {CHILD_TYPES[c]}") for c in COLLECTIONS}

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        head = tuple(self.head.get()) if self.head.exists() else (0, "", None, None)
        waiting = sorted((r for r in rows if r.seq > head[1]), key=lambda r: r.seq)
        if not waiting:
            return
        parts = {c: state.get()[0] if state.exists() else None for c, state in self.parts.items()}
        if head[0]:
            yield Version(key[0], *head, False, *parts.values())
        replaced = set()
        for change in waiting:
            if change.seq == head[1]:
                continue
            head = (head[0] + 1, change.seq, change.ts_ms, change.change_type)
            for name in COLLECTIONS:
                if change[name] is not None:
                    parts[name] = change[name]
                    replaced.add(name)
            yield Version(key[0], *head, True, *parts.values())
        self.head.update(head)
        for name in replaced:
            self.parts[name].update((parts[name],))

    def close(self) -> None:
        pass


def version_rows(changes: DataFrame) -> DataFrame:
    """The stateful step: versions of the objects that a micro-batch touches, as VERSION_SCHEMA."""
    return changes.groupBy("object_id").transformWithState(
        statefulProcessor=VersionKeeper(), outputStructType=VERSION_SCHEMA, outputMode="Append", timeMode="None"
    )


def step_events(versions: DataFrame, terms: tuple[DataFrame, ...], now_ms: int, **context: DataFrame | None) -> DataFrame:
    """Watch events of the new ones among `versions` (VERSION_SCHEMA), verified and judged under their mandates."""
    keyed = versions.withColumn("segment", F.col("version").cast("string"))
    parts = {c: keyed.select("object_id", F.col("segment").alias("version"), F.inline(c)) for c in COLLECTIONS}
    decided = history.keyed_decisions(keyed, parts, *terms, now_ms=now_ms, **context)
    judged = keyed.select("object_id", "segment", *HEAD, "fresh").join(decided, ["object_id", "segment"]).drop("segment")
    old = judged.filter("NOT fresh").select("object_id", "version")
    events = history.watch_events(judged)
    # a version that only came along is not a step of this batch
    return events.join(old.select("object_id", F.col("version").alias("new_version")).distinct(), ["object_id", "new_version"], "left_anti")


def watch_versions(
    changes: DataFrame, path: str, versions_path: str, checkpoint: str, terms: tuple[DataFrame, ...], now_ms: int, **context: DataFrame | None
) -> StreamingQuery:
    """Watch events of a stream of changes (CHANGE_SCHEMA), a folder per micro-batch; the versions behind them in another."""
    spark = changes.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{versions_path}/batch={batch_id}")
        versions = batch.sparkSession.read.schema(VERSION_SCHEMA).parquet(f"{versions_path}/batch={batch_id}")
        step_events(versions, terms, now_ms, **context).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        version_rows(changes).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
