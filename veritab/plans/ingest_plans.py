"""Snapshot gate, registration, external feed, versions and body scans."""

from pyspark.sql import functions as F

from ..fixed import NOW_MS
from ..operators import ingest as i
from ..session import scratch_path
from ..sources.store import read_json
from .registry import query

GATE = f"""gated AS (
  SELECT *, CASE WHEN reason_code IS NOT NULL THEN 'SOURCE_FAILURE'
                 WHEN {NOW_MS} - observed_at > max_age_ms THEN 'STALE' ELSE 'INGESTED' END AS status
  FROM (SELECT *, CASE WHEN http_status >= 400 THEN 'HTTP_FAILURE'
                       WHEN NOT regexp_matches(content_hash, '^0x[0-9a-fA-F]{{64}}$') THEN 'MISSING_CONTENT_HASH'
                       WHEN trim(body_storage_ref) = '' THEN 'MISSING_BODY_STORAGE_REF'
                       WHEN fetched_at > {NOW_MS} THEN 'INVALID_FETCH_TIME' END AS reason_code
        FROM b_snapshots) r)"""


@query("a1_ingest_gate", f"WITH {GATE} SELECT snapshot_id, source_id, status, reason_code FROM gated")
def ingest_gate(t):
    return i.ingest_gate(t.snapshots, NOW_MS).select("snapshot_id", "source_id", "status", "reason_code")


@query("a2_ingest_evidence", f"""WITH {GATE}
SELECT 'evidence:' || snapshot_id AS evidence_id, 'FILING' AS type, snapshot_id AS source, content_hash, observed_at,
       fetched_at, 'PRIMARY_SOURCE' AS authority, CASE status WHEN 'STALE' THEN 'STALE' ELSE 'FRESH' END AS freshness,
       locator, source_id AS meta_source, CASE WHEN locator IS NULL THEN uri ELSE note END AS meta_uri,
       body_storage_ref AS meta_body, extraction_version AS meta_extraction
FROM gated WHERE status <> 'SOURCE_FAILURE'""")
def ingest_evidence(t):
    extra = F.when(F.col("locator").isNotNull(), F.create_map(F.lit("sourceUri"), F.col("note")))
    fed = t.snapshots.withColumns({
        "evidence_id": F.concat(F.lit("evidence:"), "snapshot_id"), "type": F.lit("FILING"),
        "authority": F.lit("PRIMARY_SOURCE"), "metadata": extra,
    })
    meta = F.col("metadata")
    return i.ingest_evidence(fed, NOW_MS).select(
        "evidence_id", "type", "source", "content_hash", "observed_at", "fetched_at", "authority",
        "freshness", "locator", meta["sourceId"].alias("meta_source"), meta["sourceUri"].alias("meta_uri"),
        meta["bodyStorageRef"].alias("meta_body"), meta["extractionVersion"].alias("meta_extraction"),
    )


@query("a3_register_snapshots", f"""
SELECT CASE WHEN doc_id % 2 = 0 THEN snapshot_id ELSE 'snapshot:' || source || ':' || got_at END AS snapshot_id,
       source AS source_id, '0x' || sha256(body) AS content_hash, got_at AS fetched_at,
       'storage:' || CASE WHEN doc_id % 2 = 0 THEN snapshot_id ELSE 'snapshot:' || source || ':' || got_at END AS body_storage_ref,
       CASE WHEN lang = 'en' THEN 'v9' ELSE 'v1' END AS extraction_version
FROM (SELECT *, {NOW_MS} - doc_id * 1000 AS got_at FROM b_documents) b""")
def register_snapshots(t):
    raw = t.documents.select(
        F.when(F.col("doc_id") % 2 == 0, F.col("snapshot_id")).alias("snapshot_id"),
        F.col("source").alias("source_id"), "body", (F.lit(NOW_MS) - F.col("doc_id") * 1000).alias("fetched_at"),
        F.lit(None).cast("string").alias("body_storage_ref"),
        F.when(F.col("lang") == "en", "v9").alias("extraction_version"),
    )
    return i.register_snapshots(raw)


@query("a4_register_evidence", """
SELECT coalesce(CASE WHEN locator IS NULL THEN evidence_id END, 'evidence:' || source || ':' || observed_at) AS evidence_id,
       source, observed_at, coalesce(CASE WHEN authority <> 'DERIVED' THEN fetched_at END, observed_at) AS fetched_at,
       coalesce(freshness, 'FRESH') AS freshness FROM b_evidence""")
def register_evidence(t):
    raw = t.evidence.select(
        F.when(F.col("locator").isNull(), F.col("evidence_id")).alias("evidence_id"), "source", "observed_at",
        F.when(F.col("authority") != "DERIVED", F.col("fetched_at")).alias("fetched_at"), "freshness",
    )
    return i.register_evidence(raw)


@query("a5_register_claims", """
SELECT CASE WHEN property = 'nav' THEN claim_id ELSE 'claim:' || subject || ':' || property || ':' || created_at END AS claim_id,
       subject, property, created_at, CASE WHEN state = 'UNKNOWN' THEN 'SOURCED' ELSE state END AS state,
       CASE WHEN property = 'shareClass' THEN 0 ELSE len(attestation_refs) END AS attestations FROM b_claims""")
def register_claims(t):
    raw = t.claims.select(
        F.when(F.col("property") == "nav", F.col("claim_id")).alias("claim_id"), "subject", "property", "created_at",
        F.when(F.col("state") != "UNKNOWN", F.col("state")).alias("state"),
        F.when(F.col("property") != "shareClass", F.col("attestation_refs")).alias("attestation_refs"),
    )
    return i.register_claims(raw).withColumn("attestations", F.size("attestation_refs")).drop("attestation_refs")


@query("a6_raise_exceptions", f"""
SELECT 'exception:' || object_id || ':' || lower(type) || ':' || {NOW_MS} AS exception_id, object_id, type, severity,
       affected_claims[1] AS affected_claim, evidence_refs[1] AS evidence_ref, {NOW_MS} AS detected_at, 'OPEN' AS status
FROM b_exceptions""")
def raise_exceptions(t):
    raised = i.raise_exceptions(t.exceptions, NOW_MS)
    return raised.withColumns({
        "affected_claim": F.get("affected_claims", 0), "evidence_ref": F.get("evidence_refs", 0),
    }).drop("affected_claims", "evidence_refs")


@query("a7_external_feed_failures", """
SELECT 'exception:external-feed:' || source_ref || ':' || observed_at AS exception_id, 'object:unresolved' AS object_id,
       'SOURCE_FAILURE' AS type, 'BLOCKING' AS severity, observed_at AS detected_at, 'OPEN' AS status
FROM b_feed WHERE status <> 'OK' OR data IS NULL""")
def feed_failures(t):
    return i.feed_failures(t.feed)


@query("a7_external_feed_evidence", """
SELECT 'evidence:feed:' || source_ref || ':' || observed_at AS evidence_id, 'API_RESPONSE' AS type, source_ref AS source,
       observed_at, observed_at AS fetched_at, 'REFERENCE_DATA' AS authority, 'FRESH' AS freshness,
       '0x' || sha256(data) AS content_hash
FROM b_feed WHERE status = 'OK' AND data IS NOT NULL""")
def feed_evidence(t):
    return i.feed_evidence(t.feed)


APPEND = """
SELECT b.object_id, b.version, b.seq, b.root,
       CASE WHEN s.root IS NULL AND b.place = 1 THEN 'APPENDED' WHEN b.root = coalesce(s.root, b.first_root) THEN 'UNCHANGED'
            ELSE 'VIOLATION' END AS outcome
FROM (SELECT *, row_number() OVER w AS place, first_value(root) OVER w AS first_root FROM b_version_batch
      WINDOW w AS (PARTITION BY object_id, version ORDER BY seq)) b
LEFT JOIN b_stored_versions s ON b.object_id = s.object_id AND b.version = s.version"""


@query("a8_version_append", APPEND)
def version_append(t):
    return i.version_append(t.stored_versions, t.version_batch)


@query("a9_bodies_scan", """
SELECT evidence_id, sha256(body) AS body_digest, length(body) AS body_length FROM b_documents""")
def bodies_scan(t):
    inline = F.col("doc_id") % 5 == 1
    docs = t.documents
    evidence = docs.select(
        "evidence_id", F.col("snapshot_id").alias("source"), F.when(inline, F.col("body")).alias("raw_body")
    )
    bodies = docs.select("snapshot_id", F.when(~inline, F.col("body")).alias("body"))
    return i.attach_bodies(evidence, bodies).select(
        "evidence_id", F.sha2("body", 256).alias("body_digest"), F.length("body").alias("body_length")
    )


@query("a10_json_scan", "SELECT case_id, category, expected, predicted FROM b_cases")
def json_scan(t):
    path = scratch_path(t.spark, "json-cases")
    t.cases.write.json(path)
    schema = "case_id STRING, category STRING, expected BOOLEAN, predicted BOOLEAN"
    return read_json(t.spark, path, schema, multi_line=False)
