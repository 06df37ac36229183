"""Policy evaluation of objects under mandates.

Which object version is judged under which mandate version is an input table (`assignments`), so
the work is one row per assignment and every join is an equi-join; mandates may be as many as their
principals. All stages keep every assignment: an object, status, receipt or mandate that does not
exist is a failed check of its own, never a missing row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import POLICY_VERSION
from ..functions.expr import by_rank, true
from . import refs
from .refs import by_object, dealt

DECISIONS = ["ALLOW", "CONDITIONAL", "BLOCK"]
KEYS = ["object_id", "version", "mandate_id", "mandate_version"]
OBJECT, MANDATE = ["object_id", "version"], ["mandate_id", "mandate_version"]


def object_x_mandate(objects: DataFrame, assignments: DataFrame, mandates: DataFrame, deal: bool | None = None) -> DataFrame:
    """Each assignment with its object and the terms of its mandate, and whether either exists.

    `deal` tells whether rows are to be dealt by object, which is found out where it is not given.
    """
    terms = mandates.withColumnRenamed("version", "mandate_version").withColumn("mandate_exists", F.lit(True))
    held = objects.withColumn("object_exists", F.lit(True))
    # the mandates first, so that rows dealt by object after them meet all that is kept by object
    termed = assignments.join(terms, MANDATE, "left")
    rows = by_object(termed, assignments, objects) if deal is None else dealt(termed) if deal else termed
    return rows.join(held, OBJECT, "left").withColumns({
        "object_exists": true(F.col("object_exists")), "mandate_exists": true(F.col("mandate_exists")),
    })


def policy_cases(
    objects: DataFrame, assignments: DataFrame, mandates: DataFrame, statuses: DataFrame, receipts: DataFrame, deal: bool | None = None
) -> DataFrame:
    """Assigned objects with mandate terms, object status and verification result."""
    status = statuses.select(*OBJECT, "status")
    receipt = receipts.select(*OBJECT, "overall_status")
    judged = objects.select(*OBJECT, "primary_class", "secondary", "claim_ref")
    return object_x_mandate(judged, assignments, mandates, deal).join(status, OBJECT, "left").join(receipt, OBJECT, "left")


def _row(stage: int, rule: Column | str, result: Column | str, code: Column | str,
         claim: Column | None = None, supports: bool = False) -> Column:
    def lit(x):
        return F.lit(x) if isinstance(x, str) else x

    claim = F.lit(None).cast("string") if claim is None else claim
    return F.struct(
        F.lit(stage).alias("stage"), F.lit(0).alias("ord"), lit(rule).alias("rule_id"),
        lit(result).alias("result"), lit(code).alias("reason_code"), claim.alias("claim_id"),
        F.lit(supports).alias("supports"),
    )


def _validity(now_ms: int) -> Column:
    rule = "rule:mandate:validity"
    expired = true(F.lit(now_ms) > F.col("expires_at"))
    return F.when(~F.col("mandate_exists"), _row(1, rule, "FAIL", "MANDATE_NOT_FOUND")).when(expired, _row(1, rule, "FAIL", "MANDATE_EXPIRED")).otherwise(
        _row(1, rule, "PASS", "MANDATE_ACTIVE")
    )


def _verification() -> Column:
    rule, status = "rule:verification:status", F.col("overall_status")
    return (
        F.when(status.isNull(), _row(2, rule, "FAIL", "VERIFICATION_NOT_FOUND"))
        .when(status == "FAIL", _row(2, rule, "FAIL", "VERIFICATION_FAILED"))
        .when(status == "UNRESOLVED", _row(2, rule, "UNRESOLVED", "VERIFICATION_UNRESOLVED"))
        .otherwise(_row(2, rule, "PASS", "VERIFICATION_PASSED"))
    )


def _object_state() -> Column:
    rule, status = "rule:object:state", F.col("status")
    bad = status.isin("REVOKED", "CONFLICTING", "INSUFFICIENT_EVIDENCE", "STALE")
    return (
        F.when(~F.col("object_exists"), _row(3, rule, "FAIL", "OBJECT_NOT_FOUND"))
        .when(status.isNull(), _row(3, rule, "FAIL", "OBJECT_STATUS_NOT_FOUND"))
        .when(bad, _row(3, rule, "FAIL", F.concat(F.lit("OBJECT_STATUS_"), status)))
        .when(status == "PARTIALLY_RESOLVED", _row(3, rule, "UNRESOLVED", "OBJECT_PARTIALLY_RESOLVED"))
        .otherwise(_row(3, rule, "PASS", "OBJECT_RESOLVED"))
    )


def _prohibited() -> Column:
    rule, claim = "rule:asset-class:prohibited", F.col("claim_ref")
    hit = true(F.array_contains("prohibited", F.col("primary_class")))
    return F.when(
        F.col("object_exists") & F.col("mandate_exists"),
        F.when(hit, _row(4, rule, "FAIL", "PROHIBITED_ASSET_CLASS", claim)).otherwise(
            _row(4, rule, "PASS", "NOT_PROHIBITED", claim)
        ),
    )


def _allowed() -> Column:
    rule, claim = "rule:asset-class:allowed", F.col("claim_ref")
    classes = F.array_append(F.col("secondary"), F.col("primary_class"))
    fits = true(F.arrays_overlap("allowed", classes))
    return F.when(
        F.col("object_exists") & F.col("mandate_exists") & (F.size("allowed") > 0),
        F.when(fits, _row(5, rule, "PASS", "ASSET_CLASS_ALLOWED", claim, True)).otherwise(
            _row(5, rule, "FAIL", "ASSET_CLASS_NOT_ALLOWED", claim)
        ),
    )


def _unfold(cases: DataFrame, *rows: Column) -> DataFrame:
    return cases.select(*KEYS, F.explode(F.array(*rows)).alias("c")).filter(F.col("c").isNotNull()).select(*KEYS, "c.*")


def policy_mandate_validity(cases: DataFrame, now_ms: int) -> DataFrame:
    """A mandate that does not exist or is past its expiry fails; an expiry of 0 is a time like any other."""
    return _unfold(cases, _validity(now_ms))


def policy_verification(cases: DataFrame) -> DataFrame:
    """The verification result as a policy check; its checks stay keyed by object."""
    return _unfold(cases, _verification())


def policy_object_state(cases: DataFrame) -> DataFrame:
    """Absent objects and bad states fail, a partly resolved object stays open, anything else passes."""
    return _unfold(cases, _object_state())


def policy_prohibited(cases: DataFrame) -> DataFrame:
    """The primary class must not be prohibited; nothing is said where object or mandate are absent."""
    return _unfold(cases, _prohibited())


def policy_allowed(cases: DataFrame) -> DataFrame:
    """With a non-empty allow list, primary or a secondary class must be on it."""
    return _unfold(cases, _allowed())


def first_claims(claims: DataFrame, by: Sequence[str] = refs.OBJECT) -> DataFrame:
    """The first claim in id order of each (object, property)."""
    first = F.min(F.struct("claim_id", "state")).alias("first")
    return claims.groupBy(*by, "property").agg(first).select(*by, "property", "first.*")


def required_claim_match(assignments: DataFrame, required: DataFrame, claims: DataFrame, by: Sequence[str] = refs.OBJECT) -> DataFrame:
    """Each required property of an assignment with the claim that answers it, if any."""
    wanted = assignments.join(required.withColumnRenamed("version", "mandate_version"), MANDATE)
    return wanted.join(first_claims(claims, by), [*by, "property"], "left")


def policy_required_claims(assignments: DataFrame, required: DataFrame, claims: DataFrame, by: Sequence[str] = refs.OBJECT) -> DataFrame:
    """The answering claim must be in exactly the required state."""
    m = required_claim_match(assignments, required, claims, by)
    name = F.upper("property")
    missing, same = F.col("claim_id").isNull(), F.col("state") == F.col("required_state")
    result = (
        F.when(missing, "FAIL").when(same, "PASS")
        .when(F.col("state") == "INFERRED", "UNRESOLVED").otherwise("FAIL")
    )
    code = (
        F.when(missing, F.concat(F.lit("MISSING_REQUIRED_CLAIM_"), name))
        .when(same, F.concat(F.lit("REQUIRED_CLAIM_"), name, F.lit("_SATISFIED")))
        .otherwise(F.concat(F.lit("CLAIM_STATE_MISMATCH_"), name))
    )
    return m.select(
        *KEYS, F.lit(6).alias("stage"), "ord",
        F.concat(F.lit("rule:required-claim:"), "property").alias("rule_id"),
        result.alias("result"), code.alias("reason_code"), "claim_id", true(same).alias("supports"),
    )


def required_evidence_match(assignments: DataFrame, required: DataFrame, evidence: DataFrame, by: Sequence[str] = refs.OBJECT) -> DataFrame:
    """Each required type with how many pieces answer it and the oldest one's time."""
    wanted = assignments.join(required.withColumnRenamed("version", "mandate_version"), MANDATE)
    held = evidence.groupBy(*by, "type").agg(
        F.count("*").alias("pieces"), F.min("observed_at").alias("oldest")
    )
    return wanted.join(held, [*by, "type"], "left").withColumn(
        "pieces", F.coalesce("pieces", F.lit(0))
    )


def policy_required_evidence(
    assignments: DataFrame, required: DataFrame, evidence: DataFrame, now_ms: int, by: Sequence[str] = refs.OBJECT
) -> DataFrame:
    """All evidence of a required type must be young enough, so the oldest decides."""
    m = required_evidence_match(assignments, required, evidence, by)
    kind, none = F.col("type"), F.col("pieces") == 0
    old = true(F.lit(now_ms) - F.col("oldest") > F.col("max_age_ms"))
    code = (
        F.when(none, F.concat(F.lit("MISSING_REQUIRED_EVIDENCE_"), kind))
        .when(old, F.concat(F.lit("EVIDENCE_AGE_EXCEEDED_"), kind))
        .otherwise(F.concat(F.lit("REQUIRED_EVIDENCE_"), kind, F.lit("_SATISFIED")))
    )
    return m.select(
        *KEYS, F.lit(7).alias("stage"), "ord",
        F.concat(F.lit("rule:required-evidence:"), kind).alias("rule_id"),
        F.when(none | old, "FAIL").otherwise("PASS").alias("result"), code.alias("reason_code"),
        F.lit(None).cast("string").alias("claim_id"), F.lit(False).alias("supports"),
    )


def policy_checks(
    cases: DataFrame, assignments: DataFrame, required_claims: DataFrame, required_evidence: DataFrame,
    claims: DataFrame, evidence: DataFrame, now_ms: int, by: Sequence[str] = refs.OBJECT,
) -> DataFrame:
    """All policy checks of all assignments, with their place in the rule order.

    Claims and evidence belong to what the columns `by` name: an object, whatever its version, or a version of it.
    """
    direct = _unfold(cases, _validity(now_ms), _verification(), _object_state(), _prohibited(), _allowed())
    return (
        direct
        .unionByName(policy_required_claims(assignments, required_claims, claims, by))
        .unionByName(policy_required_evidence(assignments, required_evidence, evidence, now_ms, by))
    )


def _decision() -> Column:
    result = F.col("result")
    rank = F.max(F.when(result == "FAIL", 3).when(result == "UNRESOLVED", 2).otherwise(1))
    return by_rank(rank, DECISIONS)


def decisions(checks: DataFrame) -> DataFrame:
    """Any failure blocks, else anything unresolved makes it conditional, else it is allowed."""
    return checks.groupBy(*KEYS).agg(_decision().alias("decision"))


def decision_receipts(checks: DataFrame, now_ms: int) -> DataFrame:
    """Decision with distinct reason codes and supporting claims in rule order.

    The collected lists are as long as one mandate's list of rules.
    """
    place = F.struct("stage", "ord", "rule_id", "reason_code").alias("p")
    support = F.when(F.col("supports"), F.struct("stage", "ord", "rule_id", "claim_id"))
    # dealt before they are collected: lists built ahead of the shuffle would be sorted to disk
    grouped = checks.repartition(*KEYS).groupBy(*KEYS).agg(
        _decision().alias("decision"),
        F.array_sort(F.collect_list(place)).alias("places"),
        F.array_sort(F.collect_list(support)).alias("supported"),
    )
    version = F.col("version").cast("string")
    return grouped.select(
        F.concat(
            F.lit("decision:"), "mandate_id", F.lit(":v"), F.col("mandate_version").cast("string"), F.lit(":"), "object_id", F.lit(":v"), version
        ).alias("decision_id"),
        *KEYS, "decision",
        F.array_distinct(F.col("places.reason_code")).alias("reason_codes"),
        F.array_distinct(F.col("supported.claim_id")).alias("supporting_claims"),
        F.concat(F.lit("verification:"), "object_id", F.lit(":v"), version).alias("verification_ref"),
        F.lit(POLICY_VERSION).alias("policy_version"),
        F.lit(now_ms).cast("long").alias("created_at"),
    )
