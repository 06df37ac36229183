"""Schema conformance as violation rows, with a clean / quarantine split.

A rule is (name, field, function giving the condition that marks a bad row). Each entity is read once: the rules
of a row become an array of structs, nulls are dropped and the rest is exploded.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions.expr import fan_out, isin, true


class Rule(NamedTuple):
    rule: str
    field: str
    failed: Callable[[], Column]


def filled(field: str) -> Rule:
    return Rule("non_empty", field, lambda: F.coalesce(F.length(field), F.lit(0)) == 0)


def filled_if_given(field: str) -> Rule:
    return Rule("non_empty", field, lambda: true(F.length(field) == 0))


def required(field: str) -> Rule:
    return Rule("required", field, lambda: F.col(field).isNull())


def member(field: str, values: list) -> Rule:
    return Rule("member", field, lambda: ~isin(F.col(field), values))


def member_if_given(field: str, values: list) -> Rule:
    return Rule("member", field, lambda: F.col(field).isNotNull() & ~isin(F.col(field), values))


def matches(field: str, pattern: str) -> Rule:
    return Rule("pattern", field, lambda: ~true(F.col(field).rlike(pattern)))


def matches_if_given(field: str, pattern: str) -> Rule:
    return Rule("pattern", field, lambda: true(~F.col(field).rlike(pattern)))


def at_least(field: str, bound: int) -> Rule:
    return Rule(f"at_least_{bound}", field, lambda: ~true(F.col(field) >= bound))


def at_least_if_given(field: str, bound: int) -> Rule:
    return Rule(f"at_least_{bound}", field, lambda: true(F.col(field) < bound))


def unit_range(field: str) -> Rule:
    return Rule("unit_range", field, lambda: ~true((F.col(field) >= 0) & (F.col(field) <= 1)))


def unit_range_if_given(field: str) -> Rule:
    return Rule("unit_range", field, lambda: true((F.col(field) < 0) | (F.col(field) > 1)))


def filled_refs(field: str) -> Rule:
    return Rule(
        "non_empty_items", field,
        lambda: F.col(field).isNull() | F.exists(field, lambda r: F.coalesce(F.length(r), F.lit(0)) == 0),
    )


def violations(df: DataFrame, entity: str, row_id: str, rules: list[Rule]) -> DataFrame:
    """(entity, row_id, rule, field), one row per broken rule."""
    broken = [
        F.when(r.failed(), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.field).alias("field"))) for r in rules
    ]
    return df.select(F.col(row_id).alias("row_id"), fan_out(*broken).alias("v")).select(
        F.lit(entity).alias("entity"), "row_id", "v.*"
    )


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Clean rows and quarantined rows; together they are the input."""
    bad = rules[0].failed()
    for rule in rules[1:]:
        bad = bad | rule.failed()
    return df.filter(~bad), df.filter(bad)


def unknown_keys(df: DataFrame, entity: str, row_id: str, json: str, known: list[str]) -> DataFrame:
    """Keys of JSON documents that the schema does not know."""
    keys = F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in known]))
    return df.select(F.col(row_id).alias("row_id"), F.explode(keys).alias("field")).select(
        F.lit(entity).alias("entity"), "row_id", F.lit("unknown_key").alias("rule"), "field"
    )


CLAIM_RULES = [
    filled("claim_id"), filled("subject"), filled("property"), member("state", X.CLAIM_STATES),
    filled_refs("source_refs"), filled_refs("evidence_refs"), filled_refs("attestation_refs"),
    unit_range_if_given("confidence"), at_least_if_given("observed_at", 0),
    at_least_if_given("expires_at", 0), at_least("created_at", 0),
]
EVIDENCE_RULES = [
    filled("evidence_id"), member("type", X.EVIDENCE_TYPES), filled("source"),
    matches("content_hash", X.HEX), at_least("observed_at", 0), at_least("fetched_at", 0),
    member("authority", X.EVIDENCE_AUTHORITIES), member_if_given("freshness", X.FRESHNESS),
]
ATTESTATION_RULES = [
    filled("attestation_id"), filled("subject"), filled("claim_ref"), filled("schema_name"),
    filled("attestor"), matches_if_given("evidence_root", X.HEX), matches("signature", X.HEX),
    at_least("issued_at", 0), at_least_if_given("expires_at", 0), at_least_if_given("revoked_at", 0),
    member("state", X.ATTESTATION_STATES),
]
RELATIONSHIP_RULES = [
    filled("relationship_id"), filled("subject"), member("predicate", X.PREDICATES), filled("object"),
    member("state", X.CLAIM_STATES), filled_refs("evidence_refs"), unit_range_if_given("confidence"),
    at_least_if_given("observed_at", 0), at_least_if_given("valid_from", 0), at_least_if_given("valid_until", 0),
]
REPRESENTATION_RULES = [
    filled("id"), member("environment", X.ENVIRONMENTS), member("status", X.REPRESENTATION_STATUSES),
    filled("relationship"), filled_refs("evidence_refs"),
    Rule("member_items", "identifiers", lambda: F.exists("identifiers", lambda i: ~isin(i["scheme"], X.IDENTIFIER_SCHEMES))),
    Rule("non_empty_items", "identifiers", lambda: F.exists("identifiers", lambda i: F.coalesce(F.length(i["value"]), F.lit(0)) == 0)),
]
PARTY_RULES = [filled("id"), filled("role"), filled("name"), filled_refs("claim_refs")]
TERM_RULES = [filled("id"), filled("type"), filled_if_given("holder"), required("terms"), filled_refs("claim_refs")]
RESTRICTION_RULES = [filled("id"), filled("type"), filled("scope"), filled_refs("claim_refs"), filled_refs("evidence_refs")]
ECONOMICS_RULES = [at_least("as_of", 0), required("state_values"), filled_refs("claim_refs")]
EDGE_RULES = [filled("edge_id"), filled("from_ref"), filled("to_ref"), filled("relation")]
EXCEPTION_RULES = [
    filled("exception_id"), filled("object_id"), member("type", X.EXCEPTION_TYPES),
    member("severity", X.SEVERITIES), filled_refs("affected_claims"), filled_refs("evidence_refs"),
    at_least("detected_at", 0), member("status", X.EXCEPTION_STATUSES),
]
CHECK_RULES = [
    filled("check_id"), filled("check_type"), filled("subject"), member("result", X.OUTCOMES),
    filled_refs("evidence_refs"), filled("rule_version"), at_least("timestamp", 0),
]
SNAPSHOT_RULES = [
    filled("snapshot_id"), filled("source_id"), matches("uri", X.URL), filled("content_type"),
    matches("content_hash", X.HEX), at_least("fetched_at", 0), filled("body_storage_ref"),
]
MANDATE_RULES = [
    filled("mandate_id"), at_least("version", 1), filled("principal"), filled("objective"),
    required("allowed"), required("prohibited"), required("jurisdictions"),
    at_least_if_given("max_evidence_age_ms", 0), at_least_if_given("expires_at", 0),
]
REQUIRED_CLAIM_RULES = [filled("property"), member("required_state", X.CLAIM_STATES)]
REQUIRED_EVIDENCE_RULES = [member("type", X.EVIDENCE_TYPES), at_least_if_given("max_age_ms", 0)]
PROPOSED_CLAIM_RULES = [
    filled("id"), filled("subject"), filled("property"), unit_range("confidence"), required("is_direct"),
    filled_refs("source_refs"), filled_refs("evidence_refs"),
]
PROPOSED_RIGHT_RULES = [
    filled("id"), filled("subject"), member("holder_type", X.HOLDER_TYPES), member("right_type", X.RIGHT_TYPES),
    filled("terms"), member("transferability", X.TRANSFERABILITY), unit_range("confidence"),
]
PROPOSED_RESTRICTION_RULES = [
    filled("id"), filled("subject"), member("restriction_type", X.RESTRICTION_TYPES), unit_range("confidence"),
]
PROPOSED_RELATIONSHIP_RULES = [
    filled("relationship_id"), filled("subject"), member("predicate", X.PREDICATES), filled("object"),
    unit_range("confidence"), filled_refs("evidence_refs"),
]
PROPOSED_CONFLICT_RULES = [
    filled("conflict_id"), filled("subject"), filled("property"), member("likely_cause", X.CONFLICT_CAUSES),
    member("severity", X.SEVERITIES),
]
PROPOSED_ISSUE_RULES = [filled("issue_id"), filled("subject"), member("issue_type", X.EXCEPTION_TYPES)]
PROPOSAL_RULES = [
    filled("proposal_id"), filled("run_id"), filled("prompt_version"), filled("schema_version"),
    matches("proposal_hash", X.HEX_32_BYTES), at_least("created_at", 0),
]
RUN_RULES = [
    filled("run_id"), filled("model_id"), member("status", X.RUN_STATUSES), at_least("input_tokens", 0),
    at_least("output_tokens", 0), at_least("started_at", 0), at_least("completed_at", 0), at_least("latency_ms", 0),
]
NETWORK_RULES = [member("chain_id", X.VALID_CHAIN_IDS)]
OBJECT_KEYS = (
    "id version classification identifiers representations relationships parties rights obligations "
    "restrictions economics claims evidence attestations exceptions provenance status verification"
).split()
OBJECT_SCHEMA = (
    "id STRING, version BIGINT, status STRING, claims ARRAY<STRUCT<id: STRING, state: STRING, confidence: DOUBLE>>, "
    "evidence ARRAY<STRUCT<id: STRING, type: STRING>>"
)
OBJECT_RULES = [
    filled("id"), at_least("version", 1), member("status", X.OBJECT_STATES), required("claims"), required("evidence"),
    Rule("member_items", "claims", lambda: F.exists("claims", lambda c: ~isin(c["state"], X.CLAIM_STATES))),
    Rule("member_items", "evidence", lambda: F.exists("evidence", lambda e: ~isin(e["type"], X.EVIDENCE_TYPES))),
]


def dq_objects(documents: DataFrame) -> DataFrame:
    """Nested object documents (object_id, json): own fields, nested items and unknown keys."""
    parsed = documents.select("object_id", F.from_json("json", OBJECT_SCHEMA).alias("o")).select("object_id", "o.*")
    return violations(parsed, "object", "object_id", OBJECT_RULES).unionByName(
        unknown_keys(documents, "object", "object_id", "json", OBJECT_KEYS)
    )
