"""Promotion outcomes and evaluation over whole tables."""

from ..fixed import NOW_MS
from ..operators import promote as p
from .registry import query

CLAIMS = """claim_outcomes AS (
  SELECT c.*, CASE WHEN reason_code IN ('REASON_EVIDENCE_MISSING', 'REASON_SOURCE_SNAPSHOT_NOT_FOUND', 'REASON_EVIDENCE_NOT_FOUND') THEN 'REJECT_UNSUPPORTED'
                   WHEN reason_code = 'REASON_EVIDENCE_STALE' THEN 'REQUIRE_REVIEW'
                   WHEN reason_code = 'REASON_GROUNDED_AUTHORITATIVE' THEN 'ACCEPT_AS_CANDIDATE' ELSE 'ACCEPT_AS_INFERRED' END AS outcome
  FROM (SELECT p.*, CASE WHEN len(p.source_refs) = 0 OR len(p.evidence_refs) = 0 THEN 'REASON_EVIDENCE_MISSING'
                         WHEN EXISTS (SELECT 1 FROM (SELECT unnest(p.source_refs) AS r) u WHERE r NOT IN (SELECT snapshot_id FROM b_snapshots))
                           THEN 'REASON_SOURCE_SNAPSHOT_NOT_FOUND'
                         WHEN e.evidence_id IS NULL THEN 'REASON_EVIDENCE_NOT_FOUND'
                         WHEN e.freshness = 'STALE' THEN 'REASON_EVIDENCE_STALE'
                         WHEN e.authority IN ('PRIMARY_SOURCE', 'REFERENCE_DATA', 'ONCHAIN_STATE', 'AUTHORIZED_ATTESTOR') THEN 'REASON_GROUNDED_AUTHORITATIVE'
                         ELSE 'REASON_INFERRED_NON_AUTHORITATIVE' END AS reason_code
        FROM b_proposed_claims p LEFT JOIN b_evidence e ON p.evidence_refs[1] = e.evidence_id) c)"""
RELATIONS = """relation_outcomes AS (
  SELECT r.*, CASE WHEN predicate = 'ECONOMICALLY_EQUIVALENT_TO' AND (NOT is_equivalent OR len(evidence_refs) = 0) THEN 'REJECT_POLICY'
                   WHEN len(evidence_refs) = 0 OR lost THEN 'REJECT_UNSUPPORTED' ELSE 'ACCEPT_AS_CANDIDATE' END AS outcome,
         CASE WHEN predicate = 'ECONOMICALLY_EQUIVALENT_TO' AND (NOT is_equivalent OR len(evidence_refs) = 0) THEN 'REASON_EQUIVALENCE_EVIDENCE_INSUFFICIENT'
              WHEN len(evidence_refs) = 0 THEN 'REASON_EVIDENCE_MISSING' WHEN lost THEN 'REASON_EVIDENCE_NOT_FOUND'
              ELSE 'REASON_RELATIONSHIP_GROUNDED' END AS reason_code
  FROM (SELECT b.*, b.relationship_id IN (SELECT relationship_id FROM (SELECT relationship_id, unnest(evidence_refs) AS ref FROM b_relationships) u
                                          WHERE ref NOT IN (SELECT evidence_id FROM b_evidence)) AS lost FROM b_relationships b) r)"""


def claims(t):
    return p.promote_claims(t.proposed_claims, t.snapshots, t.evidence)


def relationships(t):
    return p.promote_relationships(t.relationships, t.evidence)


@query("c16_proposal_source_check", """
SELECT id, NOT EXISTS (SELECT 1 FROM (SELECT unnest(p.source_refs) AS r) u WHERE r NOT IN (SELECT snapshot_id FROM b_snapshots)) AS sources_known
FROM b_proposed_claims p""")
def proposal_source_check(t):
    return p.proposal_source_check(t.proposed_claims, t.snapshots).select("id", "sources_known")


@query("o1_promote_claims", f"WITH {CLAIMS} SELECT id, proposal_id, outcome, reason_code, 'CLAIM' AS target_type FROM claim_outcomes")
def promote_claims(t):
    return claims(t).select("id", "proposal_id", "outcome", "reason_code", "target_type")


@query("o2_promote_relationships", f"WITH {RELATIONS} SELECT relationship_id, proposal_id, outcome, reason_code, 'RELATIONSHIP' AS target_type FROM relation_outcomes")
def promote_relationships(t):
    return relationships(t).select("relationship_id", "proposal_id", "outcome", "reason_code", "target_type")


@query("o3_canonical_claims", f"""WITH {CLAIMS}
SELECT id AS claim_id, subject, property, value_json, unit, CASE outcome WHEN 'ACCEPT_AS_CANDIDATE' THEN 'SOURCED' ELSE 'INFERRED' END AS state,
       confidence, {NOW_MS} AS created_at FROM claim_outcomes WHERE outcome LIKE 'ACCEPT%'""")
def canonical_claims(t):
    return p.canonical_claims(claims(t), NOW_MS).drop("source_refs", "evidence_refs", "attestation_refs")


@query("o3_canonical_relationships", f"""WITH {RELATIONS}
SELECT relationship_id, subject, predicate, object, 'SOURCED' AS state, confidence, {NOW_MS} AS observed_at
FROM relation_outcomes WHERE outcome LIKE 'ACCEPT%'""")
def canonical_relationships(t):
    return p.canonical_relationships(relationships(t), NOW_MS).drop("evidence_refs")


@query("d13_proposal_summary", f"""WITH {CLAIMS}, {RELATIONS}
SELECT proposal_id, count(*) FILTER (WHERE outcome LIKE 'ACCEPT%') AS accepted, count(*) FILTER (WHERE outcome LIKE 'REJECT%') AS rejected,
       count(*) FILTER (WHERE outcome = 'REQUIRE_REVIEW') AS review, count(*) FILTER (WHERE outcome = 'UNRESOLVED') AS unresolved
FROM (SELECT proposal_id, outcome FROM claim_outcomes UNION ALL SELECT proposal_id, outcome FROM relation_outcomes) u GROUP BY proposal_id""")
def proposal_summary(t):
    return p.proposal_summary(claims(t), relationships(t))


METRICS = """metrics AS (
  SELECT count(*) AS total_cases, sum(CAST(ok AS INT)) AS passed_cases,
         avg(CAST(ok AS INT)) FILTER (WHERE category = 'claim') AS claim_accuracy,
         avg(CAST(ok AS INT)) FILTER (WHERE category = 'rights') AS rights_accuracy,
         avg(CAST(ok AS INT)) FILTER (WHERE category = 'relationship') AS relationship_accuracy,
         avg(CAST(predicted AS INT)) FILTER (WHERE category = 'conflict' AND expected) AS conflict_recall,
         avg(CAST(expected AS INT)) FILTER (WHERE category = 'conflict' AND predicted) AS conflict_precision,
         count(*) FILTER (WHERE category = 'claim' AND predicted AND NOT expected) / count(*) AS unsupported_inference_rate,
         count(*) FILTER (WHERE category = 'relationship' AND predicted AND NOT expected)
           / count(*) FILTER (WHERE category = 'relationship') AS false_equivalence_rate,
         count(*) FILTER (WHERE must_block AND predicted) / count(*) AS false_allow_rate
  FROM (SELECT *, expected = predicted AS ok FROM b_cases) c)"""


@query("d14_eval_metrics", f"WITH {METRICS} SELECT * FROM metrics")
def eval_metrics(t):
    return p.eval_metrics(t.cases)


BOUNDS = """bounds AS (
  SELECT 'false_equivalence_rate' AS metric, 0.0 AS bound, false_equivalence_rate AS found, false_equivalence_rate > 0 AS missed FROM metrics
  UNION ALL SELECT 'false_allow_rate', 0.0, false_allow_rate, false_allow_rate > 0 FROM metrics
  UNION ALL SELECT 'unsupported_inference_rate', 0.0, unsupported_inference_rate, unsupported_inference_rate > 0 FROM metrics
  UNION ALL SELECT 'claim_accuracy', 0.95, claim_accuracy, claim_accuracy < 0.95 FROM metrics
  UNION ALL SELECT 'rights_accuracy', 0.95, rights_accuracy, rights_accuracy < 0.95 FROM metrics
  UNION ALL SELECT 'relationship_accuracy', 0.95, relationship_accuracy, relationship_accuracy < 0.95 FROM metrics
  UNION ALL SELECT 'conflict_recall', 0.95, conflict_recall, conflict_recall < 0.95 FROM metrics)"""


@query("d15_gate_violations", f"WITH {METRICS}, {BOUNDS} SELECT metric, CAST(bound AS DOUBLE) AS bound, found FROM bounds WHERE missed")
def gate_violations(t):
    return p.gate_violations(p.eval_metrics(t.cases))


@query("d15_promotion_gate", f"""WITH {METRICS}, {BOUNDS}
SELECT CASE WHEN (SELECT count(*) FROM bounds WHERE missed) = 0 THEN 'PASS' WHEN false_equivalence_rate > 0 OR false_allow_rate > 0
            THEN 'REDESIGN_REQUIRED' ELSE 'FAIL' END AS status, passed_cases / total_cases * 100 AS gate_score,
       (SELECT count(*) FROM bounds WHERE missed) AS violations FROM metrics""")
def promotion_gate(t):
    return p.promotion_gate(p.eval_metrics(t.cases))


@query("d16_run_telemetry", """
SELECT model_id, count(*) AS runs, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, avg(latency) AS mean_latency_ms,
       max(latency) AS max_latency_ms, quantile_disc(latency, 0.5) AS median_latency_ms, count(*) FILTER (WHERE status <> 'SUCCESS') AS rejected_runs
FROM (SELECT *, greatest(0, completed_at - started_at) AS latency FROM b_runs) r GROUP BY model_id""")
def run_telemetry(t):
    return p.run_telemetry(t.runs)
