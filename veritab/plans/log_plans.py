"""Replay of the commitment log over the whole event table."""

from ..fixed import ZERO_ROOT
from ..operators import commitlog as c
from .registry import query

# Only calls of a sender that holds the role at the time, while the log is not paused, reach the folds.
JUDGED = """judged AS (
  SELECT c.*, EXISTS (SELECT 1 FROM b_roles r WHERE r.sender = c.sender AND r.role = c.role AND r.role_from <= c.seq AND c.seq < r.role_to) AS authorised,
         EXISTS (SELECT 1 FROM b_pauses p WHERE p.pause_from <= c.seq AND c.seq < p.pause_to) AS paused
  FROM (SELECT *, CASE WHEN call IN ('attest', 'revoke') THEN 'attestor' ELSE 'publisher' END AS role FROM b_commit_calls) c)"""

# Version reached before each call, walking every object's calls in order.
REPLAY = f"""{JUDGED},
log AS (SELECT * FROM judged WHERE authorised AND NOT paused),
ops AS (
  SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY seq) AS n,
         CASE WHEN object_root = '{ZERO_ROOT}' OR evidence_root = '{ZERO_ROOT}' THEN NULL WHEN call = 'register' THEN 0 ELSE expected_version END AS needs
  FROM log WHERE call IN ('register', 'update')),
walk AS (
  SELECT object_id, seq, n, CAST(0 AS BIGINT) AS version_before, CASE WHEN needs = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS version_after FROM ops WHERE n = 1
  UNION ALL
  SELECT o.object_id, o.seq, o.n, w.version_after, CASE WHEN o.needs = w.version_after THEN w.version_after + 1 ELSE w.version_after END
  FROM walk w JOIN ops o ON o.object_id = w.object_id AND o.n = w.n + 1),
outcomes AS (
  SELECT o.object_id, o.seq, o.call, o.expected_version, o.object_root, o.evidence_root, w.version_before,
         CASE WHEN o.needs IS NULL THEN 'InvalidRoot' WHEN o.needs = w.version_before THEN 'ACCEPTED'
              WHEN o.call = 'register' THEN 'ObjectAlreadyRegistered' WHEN w.version_before = 0 THEN 'ObjectNotFound'
              ELSE 'InvalidExpectedVersion' END AS outcome
  FROM ops o JOIN walk w ON o.object_id = w.object_id AND o.seq = w.seq)"""


def accepted_calls(t):
    return c.authorised_calls(t.commit_calls, t.roles, t.pauses)


@query("t6_commitment_outcomes", f"WITH RECURSIVE {REPLAY} SELECT * FROM outcomes")
def commitment_outcomes(t):
    return c.commitment_outcomes(accepted_calls(t))


@query("t6_commitment_fold", f"""WITH RECURSIVE {REPLAY}
SELECT object_id, object_root, evidence_root, version_before + 1 AS version, seq AS updated_seq FROM outcomes WHERE outcome = 'ACCEPTED'
QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY seq DESC) = 1""")
def commitment_fold(t):
    return c.commitment_fold(c.commitment_outcomes(accepted_calls(t)))


REGISTERED = """registered AS (SELECT object_id, min(seq) AS since FROM outcomes WHERE outcome = 'ACCEPTED' GROUP BY object_id)"""


def registered(t):
    return c.registrations(c.commitment_outcomes(accepted_calls(t)))


@query("t7_attestation_fold", f"""WITH RECURSIVE {REPLAY}, {REGISTERED},
logged AS (
  SELECT l.*, last_value(CASE WHEN call = 'attest' AND seq > since THEN attestation_hash END IGNORE NULLS)
                OVER (PARTITION BY l.object_id, claim_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_hash,
         max(CASE WHEN call = 'attest' AND seq > since THEN seq END) OVER (PARTITION BY l.object_id, claim_id) AS last_seq
  FROM log l JOIN registered r ON l.object_id = r.object_id WHERE call IN ('attest', 'revoke'))
SELECT object_id, claim_id, max(CASE WHEN seq = last_seq THEN attestation_hash END) AS attestation_hash, max(last_seq) AS attested_seq,
       bool_or(call = 'revoke' AND attestation_hash = current_hash AND seq > last_seq) AS revoked
FROM logged WHERE last_seq IS NOT NULL GROUP BY object_id, claim_id""")
def attestation_fold(t):
    return c.attestation_fold(accepted_calls(t), registered(t))


@query("t8_representation_log", f"""WITH RECURSIVE {REPLAY}, {REGISTERED}
SELECT l.object_id, representation_id, object_root AS relationship_hash, seq FROM log l
JOIN registered r ON l.object_id = r.object_id AND l.seq > r.since WHERE object_root <> '{ZERO_ROOT}'
QUALIFY row_number() OVER (PARTITION BY l.object_id, representation_id ORDER BY seq DESC) = 1""")
def representation_log(t):
    return c.representation_log(accepted_calls(t), registered(t))


@query("t9_event_history", f"""WITH RECURSIVE {REPLAY}
SELECT object_id, seq, CASE call WHEN 'register' THEN 'ObjectRegistered' ELSE 'ObjectUpdated' END AS event_name, version_before + 1 AS version,
       object_root, evidence_root FROM outcomes WHERE outcome = 'ACCEPTED'""")
def event_history(t):
    return c.event_history(c.commitment_outcomes(accepted_calls(t)))


@query("t10_publisher_filter", f"WITH {JUDGED} SELECT seq, call, sender, role, authorised, paused, authorised AND NOT paused AS kept FROM judged")
def publisher_filter(t):
    return c.publisher_filter(t.commit_calls, t.roles, t.pauses)
