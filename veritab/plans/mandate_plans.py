"""Policy checks and decisions of every order under its customer's mandate."""

from pyspark.sql import functions as F

from ..fixed import NOW_MS, POLICY_VERSION
from ..operators import mandates as m
from ..operators import status, verify
from .registry import query
from .status_plans import STATUS
from .verify_plans import CHECKS, all_checks

CASES = f"""{CHECKS}, {STATUS},
cases AS (SELECT a.object_id, a.version, a.mandate_id, a.mandate_version, o.primary_class, o.secondary, o.claim_ref,
                 o.object_id IS NOT NULL AS object_exists, m.mandate_id IS NOT NULL AS mandate_exists, s.status,
                 v.overall_status, m.allowed, m.prohibited, m.expires_at
          FROM b_assignments a
          LEFT JOIN b_objects o ON a.object_id = o.object_id AND a.version = o.version
          LEFT JOIN object_states s ON o.object_id = s.object_id
          LEFT JOIN statuses v ON o.object_id = v.object_id
          LEFT JOIN b_mandates m ON a.mandate_id = m.mandate_id AND a.mandate_version = m.version)"""
P = "SELECT object_id, version, mandate_id, mandate_version"
P1 = f"""{P}, 1 AS stage, 0 AS ord, 'rule:mandate:validity' AS rule_id,
  CASE WHEN NOT mandate_exists OR expires_at < {NOW_MS} THEN 'FAIL' ELSE 'PASS' END AS result,
  CASE WHEN NOT mandate_exists THEN 'MANDATE_NOT_FOUND' WHEN expires_at < {NOW_MS} THEN 'MANDATE_EXPIRED' ELSE 'MANDATE_ACTIVE' END AS reason_code,
  CAST(NULL AS VARCHAR) AS claim_id, false AS supports FROM cases"""
P2 = f"""{P}, 2 AS stage, 0 AS ord, 'rule:verification:status' AS rule_id, coalesce(overall_status, 'FAIL') AS result,
  CASE coalesce(overall_status, '') WHEN '' THEN 'VERIFICATION_NOT_FOUND' WHEN 'FAIL' THEN 'VERIFICATION_FAILED' WHEN 'UNRESOLVED' THEN 'VERIFICATION_UNRESOLVED'
       ELSE 'VERIFICATION_PASSED' END AS reason_code, CAST(NULL AS VARCHAR) AS claim_id, false AS supports FROM cases"""
P3 = f"""{P}, 3 AS stage, 0 AS ord, 'rule:object:state' AS rule_id,
  CASE status WHEN 'PARTIALLY_RESOLVED' THEN 'UNRESOLVED' WHEN 'RESOLVED' THEN 'PASS' ELSE 'FAIL' END AS result,
  CASE status WHEN 'PARTIALLY_RESOLVED' THEN 'OBJECT_PARTIALLY_RESOLVED' WHEN 'RESOLVED' THEN 'OBJECT_RESOLVED'
       ELSE CASE WHEN object_exists THEN coalesce('OBJECT_STATUS_' || status, 'OBJECT_STATUS_NOT_FOUND') ELSE 'OBJECT_NOT_FOUND' END END AS reason_code, CAST(NULL AS VARCHAR) AS claim_id, false AS supports FROM cases"""
P4 = f"""{P}, 4 AS stage, 0 AS ord, 'rule:asset-class:prohibited' AS rule_id,
  CASE WHEN list_contains(prohibited, primary_class) THEN 'FAIL' ELSE 'PASS' END AS result,
  CASE WHEN list_contains(prohibited, primary_class) THEN 'PROHIBITED_ASSET_CLASS' ELSE 'NOT_PROHIBITED' END AS reason_code,
  claim_ref AS claim_id, false AS supports FROM cases WHERE object_exists AND mandate_exists"""
P5 = f"""{P}, 5 AS stage, 0 AS ord, 'rule:asset-class:allowed' AS rule_id,
  CASE WHEN fits THEN 'PASS' ELSE 'FAIL' END AS result,
  CASE WHEN fits THEN 'ASSET_CLASS_ALLOWED' ELSE 'ASSET_CLASS_NOT_ALLOWED' END AS reason_code,
  claim_ref AS claim_id, fits AS supports
  FROM (SELECT *, list_contains(allowed, primary_class) OR list_has_any(allowed, secondary) AS fits
        FROM cases WHERE object_exists AND mandate_exists AND len(allowed) > 0) f"""
CLAIM_MATCH = """SELECT a.object_id, a.version, a.mandate_id, a.mandate_version, r.ord, r.property, r.required_state, c.claim_id, c.state
  FROM b_assignments a JOIN b_required_claims r ON a.mandate_id = r.mandate_id AND a.mandate_version = r.version
  LEFT JOIN (SELECT * FROM b_claims QUALIFY row_number() OVER (PARTITION BY object_id, property ORDER BY claim_id) = 1) c
    ON a.object_id = c.object_id AND r.property = c.property"""
P6 = f"""{P}, 6 AS stage, ord, 'rule:required-claim:' || property AS rule_id,
  CASE WHEN claim_id IS NULL THEN 'FAIL' WHEN state = required_state THEN 'PASS' WHEN state = 'INFERRED' THEN 'UNRESOLVED'
       ELSE 'FAIL' END AS result,
  CASE WHEN claim_id IS NULL THEN 'MISSING_REQUIRED_CLAIM_' || upper(property)
       WHEN state = required_state THEN 'REQUIRED_CLAIM_' || upper(property) || '_SATISFIED'
       ELSE 'CLAIM_STATE_MISMATCH_' || upper(property) END AS reason_code,
  claim_id, coalesce(state = required_state, false) AS supports FROM ({CLAIM_MATCH}) cm"""
P7 = f"""{P}, 7 AS stage, ord, 'rule:required-evidence:' || type AS rule_id,
  CASE WHEN NOT held OR NOT young THEN 'FAIL' ELSE 'PASS' END AS result,
  CASE WHEN NOT held THEN 'MISSING_REQUIRED_EVIDENCE_' || type WHEN NOT young THEN 'EVIDENCE_AGE_EXCEEDED_' || type
       ELSE 'REQUIRED_EVIDENCE_' || type || '_SATISFIED' END AS reason_code, CAST(NULL AS VARCHAR) AS claim_id, false AS supports
  FROM (SELECT a.object_id, a.version, a.mandate_id, a.mandate_version, r.ord, r.type, count(e.evidence_id) > 0 AS held,
               bool_and(coalesce({NOW_MS} - e.observed_at <= r.max_age_ms, true)) AS young
        FROM b_assignments a JOIN b_required_evidence r ON a.mandate_id = r.mandate_id AND a.mandate_version = r.version
        LEFT JOIN b_evidence e ON a.object_id = e.object_id AND r.type = e.type
        GROUP BY ALL) em"""
POLICY = f"""{CASES},
policy AS ({P1} UNION ALL {P2} UNION ALL {P3} UNION ALL {P4} UNION ALL {P5} UNION ALL {P6} UNION ALL {P7}),
decided AS (SELECT object_id, version, mandate_id, mandate_version,
                   CASE WHEN bool_or(result = 'FAIL') THEN 'BLOCK' WHEN bool_or(result = 'UNRESOLVED') THEN 'CONDITIONAL'
                        ELSE 'ALLOW' END AS decision
            FROM policy GROUP BY ALL)"""


def cases(t, receipts=None):
    if receipts is None:
        receipts = verify.receipt_status(t.objects, all_checks(t))
    statuses = status.object_status(t.objects, t.claims, t.exceptions)
    return m.policy_cases(t.objects, t.assignments, t.mandates, statuses, receipts)


def terms(t):
    """Assigned objects with mandate terms, for rules that need neither status nor verification."""
    objects = t.objects.select("object_id", "version", "primary_class", "secondary", "claim_ref")
    return m.object_x_mandate(objects, t.assignments, t.mandates)


def policy(t, receipts=None):
    return m.policy_checks(
        cases(t, receipts), t.assignments, t.required_claims, t.required_evidence, t.claims, t.evidence, NOW_MS
    )


@query("c9_object_x_mandate", """
SELECT a.object_id, a.version, a.mandate_id, a.mandate_version, o.object_id IS NOT NULL AS object_exists,
       m.mandate_id IS NOT NULL AS mandate_exists, o.primary_class, m.principal, m.objective, m.expires_at
FROM b_assignments a LEFT JOIN b_objects o ON a.object_id = o.object_id AND a.version = o.version
LEFT JOIN b_mandates m ON a.mandate_id = m.mandate_id AND a.mandate_version = m.version""")
def object_x_mandate(t):
    return m.object_x_mandate(t.objects, t.assignments, t.mandates).select(
        *m.KEYS, "object_exists", "mandate_exists", "primary_class", "principal", "objective", "expires_at"
    )


@query("c10_required_claim_match", CLAIM_MATCH)
def required_claim_match(t):
    return m.required_claim_match(t.assignments, t.required_claims, t.claims)


@query("c11_required_evidence_match", """
SELECT a.object_id, a.version, a.mandate_id, a.mandate_version, r.ord, r.type, r.max_age_ms, count(e.evidence_id) AS pieces,
       min(e.observed_at) AS oldest
FROM b_assignments a JOIN b_required_evidence r ON a.mandate_id = r.mandate_id AND a.mandate_version = r.version
LEFT JOIN b_evidence e ON a.object_id = e.object_id AND r.type = e.type GROUP BY ALL""")
def required_evidence_match(t):
    return m.required_evidence_match(t.assignments, t.required_evidence, t.evidence)


@query("p1_policy_mandate_validity", f"WITH {CASES} {P1}")
def policy_mandate_validity(t):
    return m.policy_mandate_validity(terms(t), NOW_MS)


@query("p2_policy_verification", f"WITH {CASES} {P2}")
def policy_verification(t):
    receipts = verify.receipt_status(t.objects, all_checks(t)).select(*m.OBJECT, "overall_status")
    return m.policy_verification(t.assignments.join(receipts, m.OBJECT, "left"))


@query("p3_policy_object_state", f"WITH {CASES} {P3}")
def policy_object_state(t):
    statuses = status.object_status(t.objects, t.claims, t.exceptions).select(*m.OBJECT, "status")
    return m.policy_object_state(terms(t).join(statuses, m.OBJECT, "left"))


@query("p4_policy_prohibited", f"WITH {CASES} {P4}")
def policy_prohibited(t):
    return m.policy_prohibited(terms(t))


@query("p5_policy_allowed", f"WITH {CASES} {P5}")
def policy_allowed(t):
    return m.policy_allowed(terms(t))


@query("p6_policy_required_claims", P6)
def policy_required_claims(t):
    return m.policy_required_claims(t.assignments, t.required_claims, t.claims)


@query("p7_policy_required_evidence", P7)
def policy_required_evidence(t):
    return m.policy_required_evidence(t.assignments, t.required_evidence, t.evidence, NOW_MS)


@query("d7_decisions", f"WITH {POLICY} SELECT * FROM decided")
def decisions(t):
    return m.decisions(policy(t))


REASONS = """
SELECT object_id, version, mandate_id, mandate_version, string_agg(reason_code, ',' ORDER BY stage, ord, rule_id) AS reason_codes
FROM (SELECT object_id, version, mandate_id, mandate_version, reason_code, min(stage) AS stage, min(ord) AS ord, min(rule_id) AS rule_id
      FROM policy GROUP BY object_id, version, mandate_id, mandate_version, reason_code) u GROUP BY ALL"""
SUPPORT = """
SELECT object_id, version, mandate_id, mandate_version, string_agg(claim_id, ',' ORDER BY stage, ord, rule_id) AS supporting_claims
FROM policy WHERE supports GROUP BY ALL"""


@query("d8_decision_receipts", f"""WITH {POLICY}
SELECT 'decision:' || d.mandate_id || ':v' || d.mandate_version || ':' || d.object_id || ':v' || d.version AS decision_id, d.object_id,
       d.version, d.mandate_id, d.mandate_version, d.decision, r.reason_codes, coalesce(s.supporting_claims, '') AS supporting_claims,
       'verification:' || d.object_id || ':v' || d.version AS verification_ref,
       '{POLICY_VERSION}' AS policy_version, {NOW_MS} AS created_at
FROM decided d JOIN ({REASONS}) r USING (object_id, version, mandate_id, mandate_version)
LEFT JOIN ({SUPPORT}) s USING (object_id, version, mandate_id, mandate_version)""")
def decision_receipts(t, receipts=None):
    decided = m.decision_receipts(policy(t, receipts), NOW_MS)
    return decided.withColumn("reason_codes", F.array_join("reason_codes", ",")).withColumn(
        "supporting_claims", F.array_join("supporting_claims", ",")
    )


@query("u1_distinct_reason_codes", f"WITH {POLICY} {REASONS}")
def distinct_reason_codes(t):
    return decision_receipts(t).select(*m.KEYS, "reason_codes")
