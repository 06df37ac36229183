"""Conformance of every entity: violation rows over whole tables."""

from pyspark.sql import functions as F

from .. import fixed as X
from ..operators import conformance as q
from ..operators import nested
from .registry import query


def text(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def empty(field: str) -> tuple[str, str, str]:
    return ("non_empty", field, f"{field} IS NULL OR {field} = ''")


def outside(field: str, values) -> tuple[str, str, str]:
    return ("member", field, f"{field} IS NULL OR {field} NOT IN ({text(values)})")


def low(field: str, bound: int = 0) -> tuple[str, str, str]:
    return (f"at_least_{bound}", field, f"{field} < {bound}")


def items(field: str) -> tuple[str, str, str]:
    return ("non_empty_items", field, f"list_contains({field}, '')")


def pattern(field: str, regex: str) -> tuple[str, str, str]:
    return ("pattern", field, f"NOT regexp_matches({field}, '{regex}')")


def unit(field: str) -> tuple[str, str, str]:
    return ("unit_range", field, f"{field} < 0 OR {field} > 1")


def missing(field: str) -> tuple[str, str, str]:
    return ("required", field, f"{field} IS NULL")


def sql(entity: str, source: str, row_id: str, *rules: tuple[str, str, str]) -> str:
    """One SELECT per rule that can fail on the table."""
    return " UNION ALL ".join(
        f"SELECT '{entity}' AS entity, {row_id} AS row_id, '{rule}' AS rule, '{field}' AS field FROM {source} WHERE {bad}"
        for rule, field, bad in rules
    )


@query("q1_dq_claims", sql("claim", "b_claims", "claim_id", empty("claim_id"), empty("property"),
                           outside("state", X.CLAIM_STATES), unit("confidence"), low("observed_at"),
                           low("created_at"), items("evidence_refs"))
       + " UNION ALL SELECT 'proposed', id, 'unit_range', 'confidence' FROM b_proposed_claims WHERE confidence > 1")
def dq_claims(t):
    proposed = q.violations(t.proposed_claims, "proposed", "id", [q.unit_range_if_given("confidence")])
    return q.violations(t.claims, "claim", "claim_id", q.CLAIM_RULES).unionByName(proposed)


@query("q2_dq_evidence", sql("evidence", "b_evidence", "evidence_id", outside("type", X.EVIDENCE_TYPES), empty("source"),
                             pattern("content_hash", X.HEX), low("observed_at"), outside("authority", X.EVIDENCE_AUTHORITIES),
                             ("member", "freshness", f"freshness NOT IN ({text(X.FRESHNESS)})"))
       + " UNION ALL SELECT 'snapshot', snapshot_id, 'pattern', 'content_hash' FROM b_snapshots WHERE content_hash = '0x'")
def dq_evidence(t):
    hashes = q.violations(t.snapshots, "snapshot", "snapshot_id", [q.matches("content_hash", X.HEX)])
    return q.violations(t.evidence, "evidence", "evidence_id", q.EVIDENCE_RULES).unionByName(hashes)


@query("q3_dq_attestations", sql("attestation", "b_attestations", "attestation_id", empty("schema_name"),
                                 pattern("evidence_root", X.HEX), pattern("signature", X.HEX), low("issued_at"),
                                 outside("state", X.ATTESTATION_STATES)))
def dq_attestations(t):
    return q.violations(t.attestations, "attestation", "attestation_id", q.ATTESTATION_RULES)


@query("q4_dq_relationships", sql("relationship", "b_relationships", "relationship_id", outside("predicate", X.PREDICATES),
                                  empty("object"), outside("state", X.CLAIM_STATES), unit("confidence"), low("valid_from")))
def dq_relationships(t):
    return q.violations(t.relationships, "relationship", "relationship_id", q.RELATIONSHIP_RULES)


@query("q5_dq_representations", sql("representation", "b_profiles", "id", outside("environment", X.ENVIRONMENTS),
                                    outside("status", X.REPRESENTATION_STATUSES),
                                    ("member_items", "identifiers", f"scheme NOT IN ({text(X.IDENTIFIER_SCHEMES)})"),
                                    ("non_empty_items", "identifiers", "cusip IS NULL")))
def dq_representations(t):
    identifier = F.struct("scheme", F.col("cusip").alias("value"))
    profiles = t.profiles.withColumn("identifiers", F.array(identifier))
    return q.violations(profiles, "representation", "id", q.REPRESENTATION_RULES)


@query("q6_dq_parties_rights",
       sql("party", "b_parties", "id", empty("role"), empty("name"), items("claim_refs")) + " UNION ALL "
       + sql("right", "(SELECT * FROM b_terms WHERE kind = 'right') r", "id", empty("type"), ("non_empty", "holder", "holder = ''"), missing("terms")) + " UNION ALL "
       + sql("obligation", "(SELECT * FROM b_terms WHERE kind = 'obligation') o", "id", empty("type"), ("non_empty", "holder", "holder = ''"), missing("terms")) + " UNION ALL "
       + sql("restriction", "b_scopes", "id", empty("scope"), items("evidence_refs")) + " UNION ALL "
       + sql("state", "b_economics", "object_id", low("as_of"), missing("state_values")))
def dq_parties_rights(t):
    terms = t.terms
    return (
        q.violations(t.parties, "party", "id", q.PARTY_RULES)
        .unionByName(q.violations(terms.filter("kind = 'right'"), "right", "id", q.TERM_RULES))
        .unionByName(q.violations(terms.filter("kind = 'obligation'"), "obligation", "id", q.TERM_RULES))
        .unionByName(q.violations(t.scopes, "restriction", "id", q.RESTRICTION_RULES))
        .unionByName(q.violations(t.economics, "state", "object_id", q.ECONOMICS_RULES))
    )


# Edges and exceptions of the tables are clean, so their copies get blank relations and statuses.
@query("q7_dq_provenance_exceptions", """
SELECT 'edge' AS entity, edge_id AS row_id, 'non_empty' AS rule, 'relation' AS field FROM b_edges WHERE to_ref LIKE 'evidence:elsewhere:%'
UNION ALL SELECT 'exception', exception_id, 'member', 'status' FROM b_exceptions WHERE severity = 'INFO'
UNION ALL SELECT 'exception', exception_id, 'member', 'type' FROM b_exceptions WHERE type = 'SOURCE_FAILURE'""")
def dq_provenance_exceptions(t):
    edges = t.edges.withColumn("relation", F.when(F.col("to_ref").startswith("evidence:elsewhere:"), "").otherwise(F.col("relation")))
    exceptions = t.exceptions.withColumns({
        "status": F.when(F.col("severity") == "INFO", "NOTED").otherwise(F.col("status")),
        "type": F.when(F.col("type") == "SOURCE_FAILURE", "BROKEN").otherwise(F.col("type")),
    })
    return q.violations(edges, "edge", "edge_id", q.EDGE_RULES).unionByName(
        q.violations(exceptions, "exception", "exception_id", q.EXCEPTION_RULES)
    )


@query("q8_dq_checks", sql("check", "b_reported_checks", "check_id", empty("check_type"), outside("result", X.OUTCOMES),
                           empty("rule_version"), low("timestamp")))
def dq_checks(t):
    return q.violations(t.reported_checks, "check", "check_id", q.CHECK_RULES)


@query("q9_dq_objects", f"""
WITH parsed AS (SELECT object_id, json, json_extract_string(json, '$.id') AS id, CAST(json_extract_string(json, '$.version') AS BIGINT) AS version,
                       json_extract_string(json, '$.status') AS status FROM b_object_documents)
{sql("object", "parsed", "object_id", empty("id"), low("version", 1), outside("status", X.OBJECT_STATES),
     ("required", "evidence", "json_extract(json, '$.evidence') IS NULL"),
     ("member_items", "claims", f"len(list_filter(CAST(json_extract_string(json, '$.claims[*].state') AS VARCHAR[]), lambda s: s NOT IN ({text(X.CLAIM_STATES)}))) > 0"),
     ("member_items", "evidence", f"len(list_filter(CAST(json_extract_string(json, '$.evidence[*].type') AS VARCHAR[]), lambda s: s NOT IN ({text(X.EVIDENCE_TYPES)}))) > 0"))}
UNION ALL SELECT 'object', object_id, 'unknown_key', k FROM (SELECT object_id, unnest(json_keys(json)) AS k FROM b_object_documents) u
WHERE k NOT IN ({text(q.OBJECT_KEYS)})""")
def dq_objects(t):
    return q.dq_objects(t.object_documents)


def _nested_sql(table: str, schema: nested.Node) -> str:
    """Every node of every document beside the schema's places: DuckDB lays documents out as rows, where the operator walks them."""
    rows = []
    for path, node in nested.places(schema):
        kind, rule, args = "ANY", "", ""
        if isinstance(node, nested.Record) or isinstance(node, nested.Free) and node.only_object:
            kind = "OBJECT"
        elif isinstance(node, nested.Items):
            kind = "ARRAY"
        elif isinstance(node, nested.Text):
            kind = "VARCHAR"
            rule = "member" if node.among is not None else "pattern" if node.pattern else "non_empty" if node.filled else ""
            args = "|".join(node.among or ()) or node.pattern or ""
        elif isinstance(node, nested.Number):
            kind, rule, args = "NUMBER", "range" if node.high is not None else nested.low_rule(node), f"{node.low:g}|{node.high if node.high is not None else 1e300:g}"
        key = path.rpartition(".")[2] if not path.endswith("[]") else ""
        parent = path.rpartition(".")[0] if key else ""
        rows.append(f"('{path}', '{kind}', '{rule}', '{args}', {isinstance(node, nested.Number) and node.whole}, {isinstance(node, nested.Record)}, '{parent}', '{key}')")
    needed = [f"('{path}', '{key}')" for path, node in nested.places(schema) if isinstance(node, nested.Record) for key in node.required]
    return f"""
WITH place(pattern, kind, rule, args, whole, record, parent, key) AS (VALUES {", ".join(rows)}),
needed(pattern, key) AS (VALUES {", ".join(needed)}),
node AS (SELECT object_id, t.id, t.parent, t.key, t.type, t.fullkey AS path, regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS pattern, t.value ->> '$' AS text
         FROM {table}, json_tree(json) t),
met AS (SELECT n.*, p.kind, p.rule, p.args, p.whole,
               CASE p.kind WHEN 'ANY' THEN true WHEN 'NUMBER' THEN n.type IN ('BIGINT', 'UBIGINT', 'DOUBLE') ELSE n.type = p.kind END AS fits,
               TRY_CAST(CASE WHEN n.type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN n.text END AS DOUBLE) AS number
        FROM node n JOIN place p ON n.pattern = p.pattern)
SELECT object_id AS row_id, 'type' AS rule, path FROM met WHERE NOT fits
UNION ALL SELECT object_id, rule, path FROM met WHERE fits AND (
    rule = 'non_empty' AND text = '' OR rule = 'member' AND NOT list_contains(string_split(args, '|'), text) OR rule = 'pattern' AND NOT regexp_matches(text, args)
    OR kind = 'NUMBER' AND (number < CAST(split_part(args, '|', 1) AS DOUBLE) OR number > CAST(split_part(args, '|', 2) AS DOUBLE)))
UNION ALL SELECT object_id, 'whole', path FROM met WHERE fits AND whole AND number <> floor(number)
UNION ALL SELECT c.object_id, 'unknown_key', c.path FROM node c JOIN met m ON m.object_id = c.object_id AND m.id = c.parent
    WHERE m.type = 'OBJECT' AND m.pattern IN (SELECT pattern FROM place WHERE record) AND c.pattern NOT IN (SELECT pattern FROM place)
UNION ALL SELECT m.object_id, 'required', m.path || '.' || k.key FROM met m JOIN needed k ON k.pattern = m.pattern
    LEFT JOIN node c ON c.object_id = m.object_id AND c.parent = m.id AND c.key = k.key WHERE m.type = 'OBJECT' AND c.id IS NULL"""


@query("q9_nested_objects", _nested_sql("b_whole_documents", nested.OBJECT))
def nested_objects(t):
    return nested.object_violations(t.whole_documents)


@query("q10_dq_snapshots", sql("snapshot", "b_snapshots", "snapshot_id", ("pattern", "uri", "uri NOT LIKE '%://%'"),
                               empty("content_type"), pattern("content_hash", X.HEX), low("fetched_at")))
def dq_snapshots(t):
    return q.violations(t.snapshots, "snapshot", "snapshot_id", q.SNAPSHOT_RULES)


# Mandates get bounds shifted by table values so that some of them break a rule.
@query("q11_dq_mandates", """
SELECT 'mandate' AS entity, mandate_id AS row_id, 'at_least_1' AS rule, 'version' AS field FROM b_mandates WHERE min_yield_bps < 10
UNION ALL SELECT 'mandate', mandate_id, 'required', 'allowed' FROM b_mandates WHERE len(allowed) = 0
UNION ALL SELECT 'required_claim', mandate_id, 'member', 'required_state' FROM b_required_claims WHERE required_state = 'ATTESTED'
UNION ALL SELECT 'required_evidence', mandate_id, 'at_least_0', 'max_age_ms' FROM b_required_evidence WHERE max_age_ms < 150000000000""")
def dq_mandates(t):
    mandates = t.mandates.withColumns({
        "version": F.when(F.col("min_yield_bps") < 10, 0).otherwise(F.col("version")),
        "allowed": F.when(F.size("allowed") > 0, F.col("allowed")),
    })
    claims = t.required_claims.withColumn(
        "required_state", F.when(F.col("required_state") == "ATTESTED", "SWORN").otherwise(F.col("required_state"))
    )
    evidence = t.required_evidence.withColumn("max_age_ms", F.col("max_age_ms") - 150000000000)
    return (
        q.violations(mandates, "mandate", "mandate_id", q.MANDATE_RULES)
        .unionByName(q.violations(claims, "required_claim", "mandate_id", q.REQUIRED_CLAIM_RULES))
        .unionByName(q.violations(evidence, "required_evidence", "mandate_id", q.REQUIRED_EVIDENCE_RULES))
    )


@query("q12_dq_proposals",
       sql("claim", "b_proposed_claims", "id", unit("confidence"), items("source_refs")) + " UNION ALL "
       + sql("right", "b_drafts", "id", outside("holder_type", X.HOLDER_TYPES), outside("right_type", X.RIGHT_TYPES), empty("terms"),
             outside("transferability", X.TRANSFERABILITY), unit("confidence")) + " UNION ALL "
       + sql("restriction", "b_drafts", "id", outside("restriction_type", X.RESTRICTION_TYPES), unit("confidence")) + " UNION ALL "
       + sql("relationship", "b_relationships", "relationship_id", outside("predicate", X.PREDICATES), empty("object"), unit("confidence")) + " UNION ALL "
       + sql("conflict", "b_drafts", "conflict_id", empty("property"), outside("likely_cause", X.CONFLICT_CAUSES), outside("severity", X.SEVERITIES)) + " UNION ALL "
       + sql("issue", "b_drafts", "issue_id", outside("issue_type", X.EXCEPTION_TYPES)) + " UNION ALL "
       + sql("proposal", "b_drafts", "id", empty("run_id"), pattern("proposal_hash", X.HEX_32_BYTES), low("created_at")))
def dq_proposals(t):
    drafts = t.drafts
    return (
        q.violations(t.proposed_claims, "claim", "id", q.PROPOSED_CLAIM_RULES)
        .unionByName(q.violations(drafts, "right", "id", q.PROPOSED_RIGHT_RULES))
        .unionByName(q.violations(drafts, "restriction", "id", q.PROPOSED_RESTRICTION_RULES))
        .unionByName(q.violations(t.relationships, "relationship", "relationship_id", q.PROPOSED_RELATIONSHIP_RULES))
        .unionByName(q.violations(drafts, "conflict", "conflict_id", q.PROPOSED_CONFLICT_RULES))
        .unionByName(q.violations(drafts, "issue", "issue_id", q.PROPOSED_ISSUE_RULES))
        .unionByName(q.violations(drafts, "proposal", "id", q.PROPOSAL_RULES))
    )


@query("q13_dq_runs", sql("run", "(SELECT *, completed_at - started_at AS latency_ms FROM b_runs) r", "run_id",
                          outside("status", X.RUN_STATUSES), low("input_tokens"), low("latency_ms")))
def dq_runs(t):
    runs = t.runs.withColumn("latency_ms", F.col("completed_at") - F.col("started_at"))
    return q.violations(runs, "run", "run_id", q.RUN_RULES)


@query("q14_dq_networks", sql("network", "b_profiles", "id", ("member", "chain_id", "chain_id NOT IN (1952, 196)")))
def dq_networks(t):
    return q.violations(t.profiles, "network", "id", q.NETWORK_RULES)
