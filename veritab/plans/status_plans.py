"""Object status, the evidence-first status and the exceptions it raises."""

from ..fixed import NOW_MS
from ..operators import status as s
from .registry import query

STATUS = """ranked AS (
  SELECT object_id, min(rank) AS rank FROM (
    SELECT object_id, CASE state WHEN 'REVOKED' THEN 1 WHEN 'CONFLICTING' THEN 2 WHEN 'STALE' THEN 3
                                 WHEN 'UNKNOWN' THEN 5 WHEN 'INFERRED' THEN 5 END AS rank FROM b_claims
    UNION ALL
    SELECT object_id, CASE type WHEN 'ATTESTATION_REVOKED' THEN 1 WHEN 'EVIDENCE_CONFLICT' THEN 2
                                WHEN 'EVIDENCE_STALE' THEN 3 WHEN 'EVIDENCE_MISSING' THEN 4
                                WHEN 'IDENTITY_AMBIGUOUS' THEN 4 WHEN 'RELATIONSHIP_AMBIGUOUS' THEN 4
                                WHEN 'UNSUPPORTED_REPRESENTATION' THEN 4 END FROM b_exceptions) u
  GROUP BY object_id),
object_states AS (
  SELECT o.object_id, o.version,
         CASE r.rank WHEN 1 THEN 'REVOKED' WHEN 2 THEN 'CONFLICTING' WHEN 3 THEN 'STALE'
              WHEN 4 THEN 'INSUFFICIENT_EVIDENCE' WHEN 5 THEN 'PARTIALLY_RESOLVED' ELSE 'RESOLVED' END AS status
  FROM b_objects o LEFT JOIN ranked r ON o.object_id = r.object_id)"""

EVIDENCE_STATE = """evidence_states AS (
  SELECT o.object_id, o.version,
         CASE WHEN s.first_stale IS NOT NULL THEN 'STALE' WHEN c.revoked THEN 'REVOKED'
              WHEN c.conflicting THEN 'CONFLICTING' ELSE 'RESOLVED' END AS status,
         s.first_stale,
         s.first_stale IS NOT NULL AND o.object_id NOT IN
           (SELECT object_id FROM b_exceptions WHERE type = 'EVIDENCE_STALE') AS raises_exception
  FROM b_objects o
  LEFT JOIN (SELECT object_id, min(evidence_id) AS first_stale FROM b_evidence WHERE freshness = 'STALE'
             GROUP BY object_id) s ON o.object_id = s.object_id
  LEFT JOIN (SELECT object_id, bool_or(state = 'REVOKED') AS revoked, bool_or(state = 'CONFLICTING') AS conflicting
             FROM b_claims GROUP BY object_id) c ON o.object_id = c.object_id)"""


@query("d3_object_status", f"WITH {STATUS} SELECT * FROM object_states")
def object_status(t):
    return s.object_status(t.objects, t.claims, t.exceptions)


@query("d4_evidence_state", f"WITH {EVIDENCE_STATE} SELECT * FROM evidence_states")
def evidence_state(t):
    return s.evidence_state(t.objects, t.evidence, t.claims, t.exceptions)


@query("d4_stale_exceptions", f"""WITH {EVIDENCE_STATE}
SELECT 'ex:stale:' || e.first_stale AS exception_id, e.object_id, e.first_stale AS evidence_id, c.claim_id,
       'EVIDENCE_STALE' AS type, 'BLOCKING' AS severity, 'OPEN' AS status, {NOW_MS} AS detected_at
FROM evidence_states e
LEFT JOIN (SELECT DISTINCT object_id, claim_id, unnest(evidence_refs) AS evidence_id FROM b_claims) c
  ON e.object_id = c.object_id AND e.first_stale = c.evidence_id
WHERE e.raises_exception""")
def stale_exceptions(t):
    states = s.evidence_state(t.objects, t.evidence, t.claims, t.exceptions)
    return s.stale_exceptions(states, t.claims, NOW_MS)
