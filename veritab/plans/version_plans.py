"""Version chains and watch steps over whole tables."""

from pyspark.sql import functions as F

from ..fixed import NOW_MS
from ..operators import mandates, versions as v
from .registry import query

WATCH = """deltas AS (
  SELECT *, CASE change_type WHEN 'EVIDENCE_REVOKED' THEN 'REVOKED' WHEN 'SOURCE_UPDATED' THEN update_state END AS d_claim,
         CASE change_type WHEN 'EVIDENCE_STALE' THEN 'STALE' WHEN 'SOURCE_UPDATED' THEN 'FRESH' END AS d_fresh,
         CASE change_type WHEN 'ATTESTATION_REVOKED' THEN 'REVOKED' WHEN 'SOURCE_UPDATED' THEN 'ACTIVE' END AS d_att
  FROM b_changes),
vectors AS (
  SELECT *, row_number() OVER w AS step, coalesce(last_value(d_claim IGNORE NULLS) OVER w, 'SOURCED') AS claim_state,
         coalesce(last_value(d_fresh IGNORE NULLS) OVER w, 'FRESH') AS freshness,
         coalesce(last_value(d_att IGNORE NULLS) OVER w, 'ACTIVE') AS attestation_state
  FROM deltas WINDOW w AS (PARTITION BY object_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
decided_steps AS (SELECT *, CASE WHEN claim_state IN ('REVOKED', 'CONFLICTING') OR freshness = 'STALE' OR attestation_state = 'REVOKED' THEN 'BLOCK'
                                 WHEN claim_state IN ('INFERRED', 'UNKNOWN') THEN 'CONDITIONAL' ELSE 'ALLOW' END AS new_decision FROM vectors),
moves AS (SELECT *, lag(new_decision) OVER (PARTITION BY object_id ORDER BY ts_ms, seq) AS previous_decision FROM decided_steps),
steps AS (
  SELECT 'event:watch:' || object_id || ':v' || (step + 1) || ':' || ts_ms AS watch_id, event_id, object_id, change_type, correlation_id, ts_ms,
         step AS previous_version, step + 1 AS new_version, claim_state, freshness, attestation_state, previous_decision, new_decision,
         CASE WHEN new_decision = 'BLOCK' THEN 'CRITICAL' WHEN previous_decision <> new_decision THEN 'WARNING' ELSE 'INFO' END AS severity
  FROM moves)"""


def updates(t):
    """Objects with an exception get a review class; others with late lines keep theirs."""
    flagged = t.exceptions.filter("status <> 'SUPERSEDED'").select("object_id").distinct()
    return flagged.withColumn("primary_class", F.lit("REVIEW")).withColumn("confidence", F.lit(None).cast("double"))


@query("w1_next_version", f"""
SELECT o.object_id, 2 AS version, 'REVIEW' AS primary_class, o.confidence, o.created_at, {NOW_MS} AS updated_at,
       'UNRESOLVED' AS verification_status, 'edge:version:' || o.object_id || ':v1->v2' AS edge_id, o.object_id || ':v1' AS from_ref,
       o.object_id || ':v2' AS to_ref, 'SUPERSEDES' AS relation
FROM b_objects o WHERE o.object_id IN (SELECT object_id FROM b_exceptions WHERE status <> 'SUPERSEDED')""")
def next_version(t):
    rows = v.next_versions(t.objects, updates(t), ["primary_class", "confidence"], NOW_MS)
    return rows.drop("secondary", "claim_ref", "verifier_version")


@query("w1_next_children", """
SELECT object_id, claim_id, state FROM b_claims WHERE object_id NOT IN (SELECT object_id FROM b_exceptions WHERE status <> 'SUPERSEDED')
UNION ALL SELECT object_id, affected_claims[1], 'CONFLICTING' FROM b_exceptions WHERE status <> 'SUPERSEDED'""")
def next_children(t):
    replaced = t.exceptions.filter("status <> 'SUPERSEDED'").select("object_id", F.get("affected_claims", 0).alias("claim_id"), F.lit("CONFLICTING").alias("state"))
    return v.next_children(t.claims.select("object_id", "claim_id", "state"), replaced)


@query("w2_supersedes_edges", """
SELECT object_id, 'edge:version:' || object_id || ':v' || low || '->v' || version AS edge_id, object_id || ':v' || low AS from_ref,
       object_id || ':v' || version AS to_ref, 'SUPERSEDES' AS relation
FROM (SELECT *, lag(version) OVER (PARTITION BY object_id ORDER BY version) AS low
      FROM (SELECT DISTINCT object_id, version FROM b_version_batch) d) l WHERE low IS NOT NULL""")
def supersedes_edges(t):
    return v.supersedes_edges(t.version_batch)


# Incoming rows: evidence of one authority renewed, attested claims restated, all exceptions sent again.
@query("w3_material_change", """
WITH incoming AS (
  SELECT e.object_id, n.freshness IS DISTINCT FROM e.freshness OR n.content_hash IS DISTINCT FROM e.content_hash AS material
  FROM b_evidence e JOIN (SELECT evidence_id, object_id, CASE WHEN locator IS NULL THEN 'FRESH' ELSE freshness END AS freshness, content_hash
                          FROM b_evidence WHERE authority = 'MARKET_DATA') n ON e.object_id = n.object_id AND e.evidence_id = n.evidence_id
  UNION ALL
  SELECT object_id, state = 'SOURCED' FROM b_claims WHERE len(attestation_refs) > 0
  UNION ALL
  SELECT object_id, severity = 'INFO' FROM b_exceptions)
SELECT object_id, bool_or(material) AS material FROM incoming GROUP BY object_id""")
def material_change(t):
    evidence = t.evidence
    renewed = evidence.filter("authority = 'MARKET_DATA'").withColumn(
        "freshness", F.when(F.col("locator").isNull(), "FRESH").otherwise(F.col("freshness"))
    )
    claims = t.claims.withColumn("value_json", F.col("value_str"))
    restated = claims.filter(F.size("attestation_refs") > 0).withColumn(
        "state", F.when(F.col("state") == "SOURCED", "ATTESTED").otherwise(F.col("state"))
    )
    sent = t.exceptions.withColumn(
        "exception_id", F.when(F.col("severity") == "INFO", F.concat("exception_id", F.lit(":new"))).otherwise(F.col("exception_id"))
    )
    return v.material_change(evidence, renewed, claims, restated, t.exceptions, sent)


def steps(t):
    return v.watch_steps(t.changes)


@query("w4_decision_transitions", f"""WITH {WATCH}
SELECT object_id, 'mandate:watch' AS mandate_id, new_version AS version, previous_decision, new_decision FROM steps""")
def decision_transitions(t):
    decisions = steps(t).select(
        "object_id", F.lit("mandate:watch").alias("mandate_id"), F.col("new_version").alias("version"), F.col("new_decision").alias("decision")
    )
    return v.decision_transitions(decisions)


@query("w5_first_match", """
SELECT object_id, property, claim_id, state FROM b_claims
QUALIFY row_number() OVER (PARTITION BY object_id, property ORDER BY claim_id) = 1""")
def first_match(t):
    return mandates.first_claims(t.claims)


@query("t2_change_types", f"""WITH {WATCH}
SELECT event_id, change_type, d_claim AS claim_state, d_fresh AS freshness, d_att AS attestation_state FROM deltas""")
def change_types(t):
    return v.change_deltas(t.changes).select("event_id", "change_type", "claim_state", "freshness", "attestation_state")


@query("t4_notify_severity", f"""WITH {WATCH} SELECT watch_id, previous_decision, new_decision, severity FROM steps""")
def notify_severity(t):
    return steps(t).select("watch_id", "previous_decision", "new_decision", "severity")


@query("t1_watch_batch", f"WITH {WATCH} SELECT * FROM steps")
def watch_batch(t):
    return steps(t)
