"""Digests over whole tables."""

from pyspark.sql import functions as F

from .. import fixed as X
from ..fixed import NOW_MS
from ..functions.canonical import canonical
from ..functions.ordered import RUN_LIMIT
from ..operators import digests as g
from ..operators import lineage, status, verify
from ..operators.refs import crowded
from .lineage_plans import receipts
from .mandate_plans import POLICY, REASONS, decision_receipts
from .registry import query
from .verify_plans import all_checks

EMPTY = f"'0x' || sha256('{X.TREE_DOMAIN}|')"


def tree(name: str, leaves: str, keys: str) -> str:
    """Recursive layers of digest trees over `leaves(keys, leaf)`; roots are rows with n = 1."""
    return f"""{name} AS (
  SELECT {keys}, 0 AS lvl, leaf, row_number() OVER (PARTITION BY {keys} ORDER BY leaf) AS rn, count(*) OVER (PARTITION BY {keys}) AS n
  FROM {leaves}
  UNION ALL
  SELECT {keys}, lvl + 1, leaf, row_number() OVER (PARTITION BY {keys} ORDER BY leaf), (n + 1) // 2
  FROM (SELECT {keys}, lvl, n, '0x' || sha256('{X.TREE_DOMAIN}|' || min(leaf) || '|' || max(leaf)) AS leaf
        FROM {name} WHERE n > 1 GROUP BY {keys}, lvl, n, (rn - 1) // 2) pairs)"""


def q(expr: str) -> str:
    """JSON text of a plain string expression."""
    return f"coalesce('\"' || {expr} || '\"', 'null')"


def refs(expr: str) -> str:
    return f"CASE WHEN len({expr}) = 0 THEN '[]' ELSE '[\"' || array_to_string({expr}, '\",\"') || '\"]' END"


LEAVES = f"""leaves AS (
  SELECT object_id, evidence_id, '0x' || sha256(
    '{{"authority":' || {q('authority')} || ',"contentHash":' || {q('content_hash')} || ',"domain":"{X.LEAF_DOMAIN}","fetchedAt":' || fetched_at
    || ',"freshness":' || {q("coalesce(freshness, 'UNKNOWN')")} || ',"hashingVersion":"{X.HASHING_VERSION}","id":' || {q('evidence_id')}
    || ',"locator":' || {q('locator')} || ',"metadata":' || metadata_json || ',"observedAt":' || observed_at || ',"source":' || {q('source')}
    || ',"type":' || {q('type')} || '}}') AS leaf
  FROM b_evidence)"""
ROOTS = f"""{tree('layers', 'leaves', 'object_id')},
roots AS (SELECT o.object_id, o.version, coalesce(c.n, 0) AS leaf_count, coalesce(r.leaf, {EMPTY}) AS evidence_root
          FROM b_objects o LEFT JOIN (SELECT object_id, leaf FROM layers WHERE n = 1) r ON o.object_id = r.object_id
          LEFT JOIN (SELECT object_id, count(*) AS n FROM leaves GROUP BY object_id) c ON o.object_id = c.object_id)"""
ITEMS = f"""items AS (
  SELECT object_id, 'claims' AS collection, claim_id AS item_id,
    '{{"attestationRefs":' || {refs('attestation_refs')} || ',"createdAt":' || created_at || ',"evidenceRefs":' || {refs('evidence_refs')}
    || ',"id":' || {q('claim_id')} || ',"property":' || {q('property')} || ',"sourceRefs":' || {refs('source_refs')} || ',"state":' || {q('state')}
    || ',"subject":' || {q('subject')} || ',"unit":' || {q('unit')} || ',"value":'
    || CASE value_kind WHEN 'number' THEN CAST(CAST(floor(value_num * 1000000 + 0.5) AS BIGINT) AS VARCHAR) ELSE {q('value_str')} END || '}}' AS json
  FROM b_claims
  UNION ALL SELECT object_id, 'attestations', attestation_id,
    '{{"attestor":' || {q('attestor')} || ',"claimRef":' || {q('claim_ref')} || ',"expiresAt":' || coalesce(CAST(expires_at AS VARCHAR), 'null')
    || ',"id":' || {q('attestation_id')} || ',"issuedAt":' || issued_at || ',"signature":' || {q('signature')} || ',"state":' || {q('state')} || '}}' FROM b_attestations
  UNION ALL SELECT object_id, 'exceptions', exception_id,
    '{{"affectedClaims":' || {refs('affected_claims')} || ',"detectedAt":' || detected_at || ',"evidence":' || {refs('evidence_refs')} || ',"id":' || {q('exception_id')}
    || ',"severity":' || {q('severity')} || ',"status":' || {q('status')} || ',"type":' || {q('type')} || '}}' FROM b_exceptions
  UNION ALL SELECT object_id, 'edges', edge_id,
    '{{"from":' || {q('from_ref')} || ',"id":' || {q('edge_id')} || ',"relation":' || {q('relation')} || ',"to":' || {q('to_ref')} || '}}' FROM b_edges),
item_leaves AS (SELECT object_id, collection, '0x' || sha256(json) AS leaf FROM items)"""


def child(name: str) -> str:
    return f"coalesce(max(CASE WHEN collection = '{name}' THEN leaf END), {EMPTY}) AS {name}"


OBJECT_ROOTS = f"""{ITEMS}, {tree('item_layers', 'item_leaves', 'object_id, collection')},
children AS (SELECT o.object_id, {child('claims')}, {child('attestations')}, {child('exceptions')}, {child('edges')}
             FROM b_objects o LEFT JOIN (SELECT * FROM item_layers WHERE n = 1) l ON o.object_id = l.object_id GROUP BY o.object_id),
object_roots AS (
  SELECT o.object_id, o.version, r.evidence_root, '0x' || sha256(
    '{{"attestations":' || {q('attestations')} || ',"claimRef":' || {q('claim_ref')} || ',"claims":' || {q('claims')} || ',"domain":"{X.OBJECT_DOMAIN}","edges":' || {q('edges')}
    || ',"evidence":' || {q('evidence_root')} || ',"exceptions":' || {q('exceptions')} || ',"hashingVersion":"{X.HASHING_VERSION}","id":' || {q('o.object_id')}
    || ',"primary":' || {q('primary_class')} || ',"secondary":' || {refs('secondary')} || ',"status":' || {q('s.status')}
    || ',"verification":' || {q('v.overall_status')} || ',"version":' || o.version || '}}') AS object_root
  FROM b_objects o JOIN children c ON o.object_id = c.object_id JOIN roots r ON o.object_id = r.object_id
  JOIN object_states s ON o.object_id = s.object_id JOIN statuses v ON o.object_id = v.object_id)"""


def valued_claims(t):
    """Claims with canonical value text: numbers in millionths."""
    millionths = F.floor(F.col("value_num") * 1000000 + 0.5).cast("string")
    return t.claims.withColumn(
        "value_json",
        F.when(F.col("value_kind") == "number", millionths).otherwise(F.concat(F.lit('"'), "value_str", F.lit('"'))),
    )


def items(t):
    return g.child_items(*children(t))


def children(t):
    return valued_claims(t), t.attestations, t.exceptions, t.edges


def roots(t):
    return g.evidence_roots(t.objects, t.evidence)


# The bound documents have a fixed set of keys, written here in sorted order.
CANONICAL = """
SELECT 'object:' || o_orderkey AS object_id,
       '{"claims":[{"id":"c1","state":"SOURCED"},{"id":"c2","state":"' || CASE o_orderpriority WHEN '5-LOW' THEN 'GUESSED' ELSE 'VERIFIED' END
       || '"}]' || CASE WHEN o_custkey % 19 = 0 THEN ',"comment":"x"' ELSE '' END
       || CASE WHEN o_totalprice < 20000 THEN '' WHEN o_totalprice < 40000 THEN ',"evidence":[{"id":"e1","type":"RUMOUR"}]'
               ELSE ',"evidence":[{"id":"e1","type":"FILING"}]' END
       || ',"id":"' || CASE WHEN o_orderkey % 61 = 0 THEN '' ELSE 'object:' || o_orderkey END
       || '","status":"' || CASE WHEN o_orderstatus = 'F' THEN 'RESOLVED' WHEN o_orderstatus = 'O' THEN 'STALE'
                                 WHEN o_totalprice > 400000 THEN 'OPEN' ELSE 'REVOKED' END || '"'
       || CASE WHEN o_custkey % 19 = 0 THEN ',"tags":[]' ELSE '' END || ',"version":' || (o_orderkey % 40) || '}' AS canonical
FROM orders"""


@query("m1_canonical_json", CANONICAL)
def canonical_json(t):
    """Canonical text of object documents."""
    return t.object_documents.select("object_id", canonical(F.col("json")).alias("canonical"))


@query("m2_evidence_leaves", f"WITH {LEAVES} SELECT * FROM leaves")
def evidence_leaves(t):
    return g.evidence_leaves(t.evidence)


@query("s2_sorted_leaves", f"""WITH {LEAVES}
SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY leaf, evidence_id) AS place FROM leaves""")
def sorted_leaves(t):
    return g.sorted_leaves(g.evidence_leaves(t.evidence))


@query("m3_evidence_root", f"WITH RECURSIVE {LEAVES}, {ROOTS} SELECT * FROM roots")
def evidence_root(t):
    return roots(t)


def object_roots(t, receipts=None):
    if receipts is None:
        receipts = verify.receipt_status(t.objects, all_checks(t))
    return g.object_roots(
        t.objects, status.object_status(t.objects, t.claims, t.exceptions), receipts, items(t), roots(t)
    )


@query("m4_object_root", f"WITH RECURSIVE {POLICY}, {LEAVES}, {ROOTS}, {OBJECT_ROOTS} SELECT * FROM object_roots")
def object_root(t):
    return object_roots(t)


# Replay after a year: fresh evidence of unknown age has gone stale, so some roots differ.
@query("m5_root_replay", f"""WITH RECURSIVE {LEAVES}, {ROOTS},
later AS (SELECT object_id, CASE WHEN evidence_id IN (SELECT evidence_id FROM b_evidence WHERE authority = 'DERIVED')
                                 THEN '0x' || sha256(leaf) ELSE leaf END AS leaf FROM leaves),
{tree('later_layers', 'later', 'object_id')}
SELECT r.object_id, r.version, r.evidence_root AS stored_root, coalesce(l.leaf, {EMPTY}) AS replayed_root,
       r.evidence_root = coalesce(l.leaf, {EMPTY}) AS matches
FROM roots r LEFT JOIN (SELECT object_id, leaf FROM later_layers WHERE n = 1) l ON r.object_id = l.object_id""")
def root_replay(t):
    derived = t.evidence.filter("authority = 'DERIVED'").select("object_id", "evidence_id", F.lit(True).alias("changed"))
    leaves = g.evidence_leaves(t.evidence).join(derived, ["object_id", "evidence_id"], "left")
    later = leaves.withColumn("leaf", F.when(F.col("changed"), g.digest(F.col("leaf"))).otherwise(F.col("leaf")))
    replayed = t.objects.select("object_id", "version").join(g.tree_roots(later, ["object_id"]), "object_id", "left")
    return g.root_replay(roots(t), replayed.withColumn("evidence_root", F.coalesce("root", g.empty_root())))


@query("d2_verification_receipts", f"""WITH RECURSIVE {POLICY}, {LEAVES}, {ROOTS}
SELECT 'verification:' || s.object_id || ':v' || s.version AS receipt_id, s.object_id, s.version, '{X.VERIFIER_VERSION}' AS verifier_version,
       s.overall_status, s.passed, s.failed, s.unresolved, r.evidence_root, {NOW_MS} AS created_at
FROM statuses s JOIN roots r ON s.object_id = r.object_id""")
def verification_receipts(t):
    return verify.verification_receipts(t.objects, all_checks(t), roots(t), NOW_MS)


@query("d12_assemble_sections", f"""WITH {ITEMS}
SELECT object_id, collection, section, count(*) AS items, min(item_id) AS first_id, max(item_id) AS last_id,
       sha256(string_agg(json, ',' ORDER BY item_id)) AS content
FROM (SELECT *, (row_number() OVER (PARTITION BY object_id, collection ORDER BY item_id) - 1) // {g.SECTION_SIZE} AS section FROM items)
GROUP BY object_id, collection, section""")
def assemble_sections(t):
    held = children(t)
    listed = not crowded(held, g.LIST_LIMIT)
    parts = g.children_apart(*held, deal=listed or not crowded(held))
    return g.assemble_sections(parts, limit=None if listed else RUN_LIMIT).select(
        "object_id", "collection", F.col("section").cast("long").alias("section"), F.size("items").alias("items"),
        F.col("items")[0]["item_id"].alias("first_id"), F.element_at("items", -1)["item_id"].alias("last_id"),
        F.sha2(F.array_join(F.col("items.json"), ","), 256).alias("content"),
    )


@query("d12_object_headers", f"""WITH {POLICY}
SELECT o.object_id, o.version, o.primary_class, s.status, 'UNRESOLVED' AS verification_status, 'pending' AS verifier_version
FROM b_objects o JOIN object_states s ON o.object_id = s.object_id""")
def object_headers(t):
    headers = g.object_headers(t.objects, status.object_status(t.objects, t.claims, t.exceptions))
    return headers.select("object_id", "version", "primary_class", "status", "verification_status", "verifier_version")


@query("d18_inspector_rows", f"""WITH RECURSIVE {POLICY}, {LEAVES}, {ROOTS}, {OBJECT_ROOTS}, reasons AS ({REASONS})
SELECT o.object_id, o.version, o.primary_class, array_to_string(o.secondary, ',') AS secondary, s.status,
       'verification:' || o.object_id || ':v' || o.version AS receipt_id, '{X.VERIFIER_VERSION}' AS verifier_version, v.overall_status,
       v.passed, v.failed, v.unresolved, x.evidence_root, x.object_root, d.mandate_id,
       'decision:' || d.mandate_id || ':v' || d.mandate_version || ':' || d.object_id || ':v' || d.version AS decision_id, d.decision, r.reason_codes
FROM b_objects o JOIN object_states s ON o.object_id = s.object_id JOIN statuses v ON o.object_id = v.object_id
JOIN object_roots x ON o.object_id = x.object_id LEFT JOIN decided d ON o.object_id = d.object_id AND o.version = d.version
LEFT JOIN reasons r ON d.object_id = r.object_id AND d.version = r.version AND d.mandate_id = r.mandate_id AND d.mandate_version = r.mandate_version""")
def inspector_rows(t):
    held = receipts(t)
    rows = lineage.inspector_rows(
        t.objects, status.object_status(t.objects, t.claims, t.exceptions),
        held.join(object_roots(t, held), ["object_id", "version"]), decision_receipts(t, held),
    )
    return rows.withColumn("secondary", F.array_join("secondary", ","))


@query("s1_sort_by_id", """
SELECT object_id, claim_id, row_number() OVER (PARTITION BY object_id ORDER BY claim_id) AS place FROM b_claims""")
def sort_by_id(t):
    return g.row_numbers(t.claims.select("object_id", "claim_id"), ["object_id"], ["claim_id"], out="place")


def millionths(expr: str) -> str:
    return f"CAST(round({expr} * 1000000) AS BIGINT)"


PROPOSALS = f"""
proposal_leaves AS (
  SELECT proposal_id, 'claim' AS kind, '0x' || sha256('{{"confidence":' || {millionths('confidence')} || ',"evidenceRefs":' || {refs('evidence_refs')}
    || ',"id":' || {q('id')} || ',"isDirect":' || is_direct || ',"kind":"claim","property":' || {q('property')}
    || ',"sourceRefs":' || {refs('source_refs')} || ',"subject":' || {q('subject')} || ',"unit":' || {q('unit')} || ',"value":' || value_json || '}}') AS leaf FROM b_proposed_claims
  UNION ALL SELECT proposal_id, 'relationship', '0x' || sha256('{{"confidence":' || {millionths('confidence')} || ',"evidenceRefs":' || {refs('evidence_refs')}
    || ',"id":' || {q('relationship_id')} || ',"isEquivalent":' || is_equivalent || ',"kind":"relationship","object":'
    || {q('object')} || ',"predicate":' || {q('predicate')} || ',"state":' || {q('state')} || ',"subject":' || {q('subject')} || '}}') FROM b_relationships
  UNION ALL SELECT proposal_id, 'right', '0x' || sha256('{{"confidence":' || {millionths('confidence')} || ',"holderType":' || {q('holder_type')} || ',"id":' || {q('id')}
    || ',"kind":"right","rightType":' || {q('right_type')} || ',"subject":' || {q('subject')} || ',"terms":' || {q('terms')}
    || ',"transferability":' || {q('transferability')} || '}}') FROM b_drafts
  UNION ALL SELECT proposal_id, 'restriction', '0x' || sha256('{{"id":' || {q('id')} || ',"kind":"restriction","restrictionType":' || {q('restriction_type')}
    || ',"subject":' || {q('subject')} || ',"terms":' || {q('terms')} || '}}') FROM b_drafts
  UNION ALL SELECT proposal_id, 'conflict', '0x' || sha256('{{"id":' || {q('conflict_id')} || ',"kind":"conflict","likelyCause":' || {q('likely_cause')}
    || ',"property":' || {q('property')} || ',"severity":' || {q('severity')} || ',"subject":' || {q('subject')} || '}}') FROM b_drafts
  UNION ALL SELECT proposal_id, 'issue', '0x' || sha256('{{"id":' || {q('issue_id')} || ',"issueType":' || {q('issue_type')}
    || ',"kind":"issue","subject":' || {q('subject')} || '}}') FROM b_drafts),
{tree('proposal_layers', 'proposal_leaves', 'proposal_id')},
proposal_headers AS (SELECT proposal_id, max(run_id) AS run_id, max(prompt_version) AS prompt_version, max(schema_version) AS schema_version FROM b_drafts GROUP BY proposal_id),
hashed AS (SELECT l.proposal_id, '0x' || sha256('{{"domain":"{X.PROPOSAL_DOMAIN}","items":' || {q('leaf')} || ',"promptVersion":' || {q('prompt_version')}
             || ',"proposalId":' || {q('l.proposal_id')} || ',"runId":' || {q('run_id')} || ',"schemaVersion":' || {q('schema_version')} || '}}') AS proposal_hash
           FROM proposal_layers l LEFT JOIN proposal_headers p ON l.proposal_id = p.proposal_id WHERE n = 1)"""


def proposals(t):
    headers = t.drafts.groupBy("proposal_id").agg(*[F.max(c).alias(c) for c in g.HEADER])
    return g.draft_proposals(t.proposed_claims, t.relationships, t.drafts, headers)


@query("o5_draft_proposals", f"""WITH RECURSIVE {PROPOSALS}
SELECT l.proposal_id, count(*) FILTER (WHERE kind = 'claim') AS claims, count(*) FILTER (WHERE kind = 'relationship') AS relationships,
       count(*) FILTER (WHERE kind NOT IN ('claim', 'relationship')) AS others,
       min(h.proposal_hash) AS proposal_hash FROM proposal_leaves l JOIN hashed h ON l.proposal_id = h.proposal_id GROUP BY l.proposal_id""")
def draft_proposals(t):
    return proposals(t)


# The received hash of proposals with an overconfident item is upper-cased, so it no longer agrees.
@query("o4_proposal_integrity", f"""WITH RECURSIVE {PROPOSALS},
received AS (SELECT proposal_id, CASE WHEN proposal_id IN (SELECT proposal_id FROM b_proposed_claims WHERE confidence > 1)
                                      THEN upper(proposal_hash) ELSE proposal_hash END AS proposal_hash FROM hashed)
SELECT r.proposal_id, r.proposal_hash, h.proposal_hash AS expected_hash, r.proposal_hash = h.proposal_hash AS intact
FROM received r JOIN hashed h ON r.proposal_id = h.proposal_id""")
def proposal_integrity(t):
    drafts = proposals(t)
    loud = t.proposed_claims.filter("confidence > 1").select("proposal_id").distinct().withColumn("loud", F.lit(True))
    received = drafts.join(loud, "proposal_id", "left").withColumn(
        "proposal_hash", F.when(F.col("loud"), F.upper("proposal_hash")).otherwise(F.col("proposal_hash"))
    )
    return g.proposal_integrity(received, drafts)
