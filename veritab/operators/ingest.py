"""Snapshot gate, registration defaults, external feed split and append-only versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import HEX_32_BYTES
from ..functions.expr import digest, empty_strings, ident, isin, trimmed, true


def gate_columns(now_ms: int) -> tuple[Column, Column]:
    """Status and reason of a snapshot row; the first failing rule gives the reason."""
    reason = (
        F.when(F.col("http_status") >= 400, "HTTP_FAILURE")
        .when(~true(F.col("content_hash").rlike(HEX_32_BYTES)), "MISSING_CONTENT_HASH")
        .when(F.coalesce(F.length(trimmed(F.col("body_storage_ref"))), F.lit(0)) == 0, "MISSING_BODY_STORAGE_REF")
        .when(F.col("fetched_at") > now_ms, "INVALID_FETCH_TIME")
    )
    stale = true(F.lit(now_ms) - F.col("observed_at") > F.col("max_age_ms"))
    status = F.when(reason.isNotNull(), "SOURCE_FAILURE").when(stale, "STALE").otherwise("INGESTED")
    return status, reason


def ingest_gate(snapshots: DataFrame, now_ms: int) -> DataFrame:
    """Every snapshot with `status` and `reason_code`; no row is lost."""
    status, reason = gate_columns(now_ms)
    return snapshots.withColumns({"status": status, "reason_code": reason})


def merged_metadata(base: Column, extra: Column) -> Column:
    """Two maps in one; the second wins on a shared key."""
    extra = F.coalesce(extra, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(extra), k))
    return F.map_concat(kept, extra)


def ingest_evidence(snapshots: DataFrame, now_ms: int) -> DataFrame:
    """Evidence rows of the snapshots that passed the gate, stale ones included.

    Input also carries evidence_id, type, authority, locator and a metadata map.
    """
    gated = ingest_gate(snapshots, now_ms).filter(F.col("status") != "SOURCE_FAILURE")
    base = F.create_map(
        F.lit("sourceId"), F.col("source_id"), F.lit("sourceUri"), F.col("uri"),
        F.lit("contentType"), F.col("content_type"), F.lit("bodyStorageRef"), F.col("body_storage_ref"),
        F.lit("extractionVersion"), F.col("extraction_version"),
    )
    return gated.select(
        "evidence_id", "type", F.col("snapshot_id").alias("source"), "content_hash", "observed_at",
        "fetched_at", "authority",
        F.when(F.col("status") == "STALE", "STALE").otherwise("FRESH").alias("freshness"),
        merged_metadata(base, F.col("metadata")).alias("metadata"), "locator",
    )


def register_snapshots(bodies: DataFrame) -> DataFrame:
    """Snapshot rows of raw bodies: digest, default id, storage ref and extraction version."""
    named = bodies.withColumn(
        "snapshot_id",
        F.coalesce("snapshot_id", ident("snapshot", F.col("source_id"), F.col("fetched_at"))),
    )
    return named.withColumns({
        "content_hash": digest(F.col("body")),
        "body_storage_ref": F.coalesce("body_storage_ref", ident("storage", F.col("snapshot_id"))),
        "extraction_version": F.coalesce("extraction_version", F.lit("v1")),
    }).drop("body")


def register_evidence(rows: DataFrame) -> DataFrame:
    """Evidence rows with defaults filled in."""
    return rows.withColumns({
        "evidence_id": F.coalesce("evidence_id", ident("evidence", F.col("source"), F.col("observed_at"))),
        "fetched_at": F.coalesce("fetched_at", "observed_at"),
        "freshness": F.coalesce("freshness", F.lit("FRESH")),
    })


def register_claims(rows: DataFrame) -> DataFrame:
    """Claim rows with defaults filled in."""
    return rows.withColumns({
        "claim_id": F.coalesce(
            "claim_id", ident("claim", F.col("subject"), F.col("property"), F.col("created_at"))
        ),
        "state": F.coalesce("state", F.lit("SOURCED")),
        "attestation_refs": F.coalesce("attestation_refs", empty_strings()),
    })


def raise_exceptions(issues: DataFrame, now_ms: int) -> DataFrame:
    """Open exception rows from issue rows."""
    at = F.lit(now_ms).cast("long")
    return issues.select(
        ident("exception", F.col("object_id"), F.lower("type"), at).alias("exception_id"),
        "object_id", "type", "severity", "affected_claims", "evidence_refs",
        at.alias("detected_at"), F.lit("OPEN").alias("status"),
    )


def _feed_ok() -> Column:
    return isin(F.col("status"), ["OK"]) & F.col("data").isNotNull()


def feed_failures(feed: DataFrame) -> DataFrame:
    """Blocking exceptions for feed rows that failed or came without data."""
    return feed.filter(~_feed_ok()).select(
        ident("exception", "external-feed", F.col("source_ref"), F.col("observed_at")).alias("exception_id"),
        F.lit("object:unresolved").alias("object_id"),
        F.lit("SOURCE_FAILURE").alias("type"), F.lit("BLOCKING").alias("severity"),
        F.col("observed_at").alias("detected_at"), F.lit("OPEN").alias("status"),
    )


def feed_evidence(feed: DataFrame) -> DataFrame:
    """Unverified evidence rows for feed rows with data, with a real content digest."""
    return feed.filter(_feed_ok()).select(
        ident("evidence", "feed", F.col("source_ref"), F.col("observed_at")).alias("evidence_id"),
        F.lit("API_RESPONSE").alias("type"), F.col("source_ref").alias("source"),
        "observed_at", F.col("observed_at").alias("fetched_at"),
        F.lit("REFERENCE_DATA").alias("authority"), F.lit("FRESH").alias("freshness"),
        digest(F.col("data")).alias("content_hash"),
    )


def version_append(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Outcome of saving a batch of versions into the store, in `seq` order.

    A new (object, version) is APPENDED; the same root again is UNCHANGED; another root is a
    VIOLATION, and the stored row stays.
    """
    key = ["object_id", "version"]
    first = batch.groupBy(*key).agg(F.min(F.struct("seq", "root")).alias("first"))
    kept = store.select(*key, F.col("root").alias("stored_root"))
    joined = batch.join(first, key).join(kept, key, "left")
    holds = F.coalesce("stored_root", F.col("first.root"))
    appended = F.col("stored_root").isNull() & (F.col("seq") == F.col("first.seq"))
    return joined.select(
        *key, "seq", "root",
        F.when(appended, "APPENDED").when(F.col("root") == holds, "UNCHANGED")
        .otherwise("VIOLATION").alias("outcome"),
    )


def attach_bodies(evidence: DataFrame, bodies: DataFrame) -> DataFrame:
    """Evidence with body text: the bodies table first, else the text kept in its metadata."""
    known = bodies.select("snapshot_id", F.col("body").alias("stored_body"))
    joined = evidence.join(known, F.col("source") == F.col("snapshot_id"), "left").drop("snapshot_id")
    return joined.withColumn("body", F.coalesce("stored_body", "raw_body")).drop("stored_body", "raw_body")
