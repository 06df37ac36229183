"""Checks and receipts over the whole order, line and supplier tables."""

from ..fixed import MAX_AGE_MS, NOW_MS, VERIFIER_VERSION
from ..operators import verify as v
from .registry import query

# Shared pieces of the oracle SQL.
REFS = "refs AS (SELECT object_id, claim_id, unnest(evidence_refs) AS evidence_id FROM b_claims)"
JOINED = f"""{REFS},
joined AS (SELECT r.*, e.evidence_id IS NOT NULL AS found, e.authority, e.content_hash, e.freshness, e.observed_at
           FROM refs r LEFT JOIN b_evidence e ON r.object_id = e.object_id AND r.evidence_id = e.evidence_id)"""

STATE_SQL = """
SELECT object_id, claim_id,
       'check:' || claim_id || CASE state WHEN 'REVOKED' THEN ':claim-state' WHEN 'INFERRED' THEN ':inference-boundary'
                                          ELSE ':claim-conflict' END AS check_id,
       CASE state WHEN 'REVOKED' THEN 'CLAIM_STATE' WHEN 'INFERRED' THEN 'INFERENCE_BOUNDARY'
                  ELSE 'EVIDENCE_CONFLICT' END AS check_type,
       CASE state WHEN 'INFERRED' THEN 'UNRESOLVED' ELSE 'FAIL' END AS result, CAST(NULL AS VARCHAR) AS ref
FROM b_claims WHERE state IN ('REVOKED', 'INFERRED', 'CONFLICTING')"""
PRESENCE_SQL = """
SELECT object_id, claim_id, 'check:' || claim_id || ':evidence-presence' AS check_id,
       'EVIDENCE_PRESENCE' AS check_type, 'FAIL' AS result, CAST(NULL AS VARCHAR) AS ref
FROM b_claims WHERE len(evidence_refs) = 0"""
REFERENCE_SQL = """
SELECT object_id, claim_id, 'check:' || claim_id || ':evidence:' || evidence_id AS check_id,
       'EVIDENCE_REFERENCE' AS check_type, 'FAIL' AS result, evidence_id AS ref FROM joined WHERE NOT found"""
AUTHORITY_SQL = """
SELECT object_id, claim_id, 'check:' || claim_id || ':authority-boundary:' || evidence_id AS check_id,
       'AUTHORITY_BOUNDARY' AS check_type, 'UNRESOLVED' AS result, evidence_id AS ref
FROM joined WHERE authority = 'AI_INFERENCE'"""
CONTENT_SQL = """
SELECT j.object_id, j.claim_id, 'check:' || j.claim_id || ':content-hash:' || j.evidence_id AS check_id,
       'CONTENT_HASH' AS check_type,
       CASE WHEN '0x' || sha256(c.content) = lower(j.content_hash) THEN 'PASS' ELSE 'FAIL' END AS result,
       j.evidence_id AS ref
FROM joined j JOIN b_contents c ON j.object_id = c.object_id AND j.evidence_id = c.evidence_id WHERE j.found AND c.content IS NOT NULL"""
FRESH_SQL = f"""
SELECT object_id, claim_id,
       'check:' || claim_id || CASE WHEN old THEN ':freshness:' ELSE ':evidence:' END || evidence_id AS check_id,
       CASE WHEN old THEN 'FRESHNESS' ELSE 'EVIDENCE_AVAILABLE' END AS check_type,
       CASE WHEN old THEN 'FAIL' ELSE 'PASS' END AS result, evidence_id AS ref
FROM (SELECT *, coalesce(freshness = 'STALE', false) OR {NOW_MS} - observed_at > {MAX_AGE_MS} AS old
      FROM joined WHERE found) f"""
ATTEST_SQL = f"""
SELECT object_id, claim_id, 'check:' || claim_id || ':' || kind || ':' || attestation_id AS check_id,
       CASE kind WHEN 'attestation-presence' THEN 'ATTESTATION_PRESENCE' WHEN 'attestation' THEN 'ATTESTATION_REVOCATION'
            WHEN 'attestation-expiry' THEN 'ATTESTATION_EXPIRY' WHEN 'attestor-authority' THEN 'ATTESTOR_AUTHORITY'
            WHEN 'attestation-valid' THEN 'ATTESTATION_VALID' ELSE 'ATTESTATION_SIGNATURE' END AS check_type,
       CASE WHEN kind = 'attestation-valid' OR (kind = 'attestation-signature' AND ok) THEN 'PASS' ELSE 'FAIL' END AS result,
       attestation_id AS ref
FROM (SELECT c.object_id, c.claim_id, c.attestation_id,
             coalesce(a.signature IN (SELECT signature FROM b_signatures WHERE valid), false) AS ok,
             CASE WHEN a.attestation_id IS NULL THEN 'attestation-presence'
                  WHEN a.state = 'REVOKED' THEN 'attestation'
                  WHEN a.expires_at <> 0 AND {NOW_MS} > a.expires_at THEN 'attestation-expiry'
                  WHEN lower(a.attestor) NOT IN (SELECT attestor FROM b_attestors) THEN 'attestor-authority'
                  WHEN a.signature IN (SELECT signature FROM b_signatures) THEN 'attestation-signature'
                  WHEN regexp_matches(a.signature, '^0x[0-9a-fA-F]{{130}}$') THEN 'attestation-valid'
                  ELSE 'attestation-signature' END AS kind
      FROM (SELECT object_id, claim_id, unnest(attestation_refs) AS attestation_id
            FROM b_claims WHERE len(evidence_refs) > 0) c
      LEFT JOIN b_attestations a ON c.object_id = a.object_id AND c.attestation_id = a.attestation_id) k"""
CHECKS = f"""{JOINED},
checks AS ({STATE_SQL} UNION ALL {PRESENCE_SQL} UNION ALL {REFERENCE_SQL} UNION ALL {AUTHORITY_SQL}
           UNION ALL {CONTENT_SQL} UNION ALL {FRESH_SQL} UNION ALL {ATTEST_SQL}),
rolled AS (SELECT object_id, count(*) FILTER (WHERE result = 'PASS') AS passed,
                  count(*) FILTER (WHERE result = 'FAIL') AS failed,
                  count(*) FILTER (WHERE result = 'UNRESOLVED') AS unresolved,
                  CASE WHEN bool_or(result = 'FAIL') THEN 'FAIL' WHEN bool_or(result = 'UNRESOLVED') THEN 'UNRESOLVED'
                       ELSE 'PASS' END AS overall_status
           FROM checks GROUP BY object_id),
statuses AS (SELECT o.object_id, o.version, coalesce(r.overall_status, 'PASS') AS overall_status,
                    coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(unresolved, 0) AS unresolved
             FROM b_objects o LEFT JOIN rolled r ON o.object_id = r.object_id)"""


def all_checks(t):
    signatures = t.signatures
    return v.verify_claims(
        t.claims, t.evidence, t.attestations, NOW_MS, MAX_AGE_MS, contents=t.contents,
        attestors=t.attestors,
        valid_signatures=signatures.filter("valid"), invalid_signatures=signatures.filter("NOT valid"),
    )


@query("v1_check_claim_state", STATE_SQL)
def check_claim_state(t):
    return v.check_claim_state(t.claims)


@query("v2_check_evidence_presence", PRESENCE_SQL)
def check_evidence_presence(t):
    return v.check_evidence_presence(t.claims)


@query("v3_check_evidence_reference", f"WITH {JOINED} {REFERENCE_SQL}")
def check_evidence_reference(t):
    return v.check_evidence_reference(t.claims, t.evidence)


@query("v4_check_authority", f"WITH {JOINED} {AUTHORITY_SQL}")
def check_authority(t):
    return v.check_authority(t.claims, t.evidence)


@query("v5_check_content_hash", f"WITH {JOINED} {CONTENT_SQL}")
def check_content_hash(t):
    return v.check_content_hash(t.claims, t.evidence, t.contents)


@query("v6_check_freshness", f"WITH {JOINED} {FRESH_SQL}")
def check_freshness(t):
    return v.check_freshness(t.claims, t.evidence, NOW_MS, MAX_AGE_MS)


@query("v7_check_attestations", ATTEST_SQL)
def check_attestations(t):
    signatures = t.signatures
    return v.check_attestations(
        t.claims, t.attestations, NOW_MS, attestors=t.attestors,
        valid_signatures=signatures.filter("valid"), invalid_signatures=signatures.filter("NOT valid"),
    )


@query("v8_verify_claims", f"WITH {CHECKS} SELECT *, '{VERIFIER_VERSION}' AS rule_version FROM checks")
def verify_claims(t):
    return all_checks(t)


@query("d1_receipt_status", f"WITH {CHECKS} SELECT object_id, version, overall_status FROM statuses")
def receipt_status(t):
    return v.receipt_status(t.objects, all_checks(t))


@query("d6_receipt_counts", f"WITH {CHECKS} SELECT * FROM rolled")
def receipt_counts(t):
    return v.receipt_counts(all_checks(t))
