"""Conflicts over whole tables of claims."""

from ..operators import conflicts as c
from ..operators import extract
from .document_plans import ALL_TERMS, SPLIT
from .registry import query

VALUES = """vals AS (
  SELECT g.subject, g.property, g.claim_id,
         CASE g.value_kind WHEN 'number' THEN 'number' WHEN 'string' THEN 'string' ELSE 'other' END AS form,
         CASE g.value_kind WHEN 'number' THEN g.value_num END AS num,
         CASE g.value_kind WHEN 'number' THEN NULL WHEN 'string' THEN lower(trim(g.value_str)) ELSE g.value_json END AS txt,
         coalesce(e.freshness = 'STALE', false) AS stale, e.authority, g.evidence_refs
  FROM b_group_claims g LEFT JOIN b_evidence e ON g.evidence_refs[1] = e.evidence_id),
clashes AS (
  SELECT a.subject, a.property, a.claim_id AS claim_a, b.claim_id AS claim_b,
         CASE WHEN a.stale OR b.stale THEN 'STALE_SOURCE' WHEN a.property = 'shareClass' THEN 'SHARE_CLASS_MISMATCH'
              WHEN a.property IN ('economicIdentity', 'issuer') THEN 'REPRESENTATION_MISMATCH'
              WHEN a.authority IS DISTINCT FROM b.authority THEN 'UNKNOWN_AUTHORITY' ELSE 'EFFECTIVE_DATE_MISMATCH' END AS likely_cause
  FROM vals a JOIN vals b ON a.subject = b.subject AND a.property = b.property AND a.claim_id < b.claim_id
  WHERE a.form <> b.form OR abs(a.num - b.num) > 0.0001 OR a.txt <> b.txt)"""
GROUPS = """groups AS (
  SELECT v.subject, v.property, count(DISTINCT v.claim_id) AS claims, count(x.claim_a) > 0 AS conflicting
  FROM vals v LEFT JOIN (SELECT DISTINCT subject, property, claim_a FROM clashes) x
    ON v.subject = x.subject AND v.property = x.property AND v.claim_id = x.claim_a GROUP BY ALL)"""


@query("d5_conflict_groups", f"WITH {VALUES}, {GROUPS} SELECT * FROM groups")
def conflict_groups(t):
    return c.conflict_groups(t.group_claims)


# The smallest claim among the extreme ones of each bound that a claim contradicts.
WITNESSES = """bounds AS (
  SELECT subject, property, form, stale, authority, min(claim_id) AS any_id, min(num) AS low, max(num) AS high, min(txt) AS first, max(txt) AS last,
         arg_min(claim_id, (num, claim_id)) FILTER (WHERE num IS NOT NULL) AS low_id, arg_max(claim_id, (num, claim_id)) FILTER (WHERE num IS NOT NULL) AS high_id,
         arg_min(claim_id, (txt, claim_id)) FILTER (WHERE txt IS NOT NULL) AS first_id, arg_max(claim_id, (txt, claim_id)) FILTER (WHERE txt IS NOT NULL) AS last_id
  FROM sided GROUP BY ALL),
met AS (
  SELECT v.subject, v.property, v.claim_id, CASE WHEN b.form <> v.form THEN b.any_id WHEN b.high - v.num > 0.0001 THEN b.high_id
              WHEN v.num - b.low > 0.0001 THEN b.low_id WHEN b.first <> v.txt THEN b.first_id WHEN b.last <> v.txt THEN b.last_id END AS witness,
         CASE WHEN v.stale OR b.stale THEN 'STALE_SOURCE' WHEN v.property = 'shareClass' THEN 'SHARE_CLASS_MISMATCH'
              WHEN v.property IN ('economicIdentity', 'issuer') THEN 'REPRESENTATION_MISMATCH'
              WHEN v.authority IS DISTINCT FROM b.authority THEN 'UNKNOWN_AUTHORITY' ELSE 'EFFECTIVE_DATE_MISMATCH' END AS cause
  FROM sided v JOIN bounds b ON v.subject = b.subject AND v.property = b.property),
witnessed AS (SELECT subject, property, claim_id, cause, min(witness) AS witness FROM met WHERE witness IS NOT NULL GROUP BY ALL)"""


@query("c12_claim_pairs", f"""WITH {VALUES}, sided AS (SELECT * REPLACE (false AS stale, CAST(NULL AS VARCHAR) AS authority) FROM vals), {WITNESSES}
SELECT subject, property, claim_id, witness FROM witnessed""")
def claims_in_conflict(t):
    return c.claims_in_conflict(t.group_claims)


@query("x1_conflict_pairs", f"""WITH {VALUES}, sided AS (SELECT * FROM vals), {WITNESSES}
SELECT 'conflict:prop:' || w.subject || ':' || w.property || ':' || w.claim_id || ':' || w.cause AS conflict_id, w.subject, w.property,
       w.claim_id, w.witness, w.cause AS likely_cause, list_sort(list_distinct(list_concat(a.evidence_refs, b.evidence_refs))) AS evidence_refs,
       'BLOCKING' AS severity
FROM witnessed w JOIN vals a ON w.claim_id = a.claim_id AND w.subject = a.subject AND w.property = a.property
JOIN vals b ON w.witness = b.claim_id AND w.subject = b.subject AND w.property = b.property""")
def conflicts(t):
    return c.conflicts(t.group_claims, t.evidence)


@query("x1_conflict_profile", f"""WITH {VALUES}
SELECT subject, property, claim_a AS claim_id, likely_cause AS cause FROM clashes
UNION SELECT subject, property, claim_b, likely_cause FROM clashes""")
def conflict_profile(t):
    return c.conflict_profile(t.group_claims, t.evidence, refs=False).drop("witness")


@query("x2_conflict_issues", f"""WITH {VALUES}
SELECT DISTINCT 'issue:unresolved:' || subject || ':' || property || ':conflict' AS id, subject,
       'EVIDENCE_CONFLICT' AS issue_type, property AS dimension FROM clashes""")
def conflict_issues(t):
    return c.conflict_issues(c.conflict_groups(t.group_claims))


@query("x3_redemption_conflict", f"""WITH {SPLIT}, terms AS ({ALL_TERMS}),
placed AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY id) AS n FROM terms WHERE type = 'REDEMPTION')
SELECT 'conflict:prop:' || a.subject || ':redemptionWindow:' || a.id || ':' || b.id AS conflict_id, a.subject,
       a.redemption_window AS window_a, b.redemption_window AS window_b, 'SHARE_CLASS_MISMATCH' AS likely_cause, 'BLOCKING' AS severity
FROM placed a JOIN placed b ON a.subject = b.subject AND a.n = 1 AND b.n = 2
WHERE lower(a.redemption_window) <> lower(b.redemption_window)""")
def redemption_conflict(t):
    return c.redemption_conflict(extract.extract_terms(t.documents))
