"""Verification checks and receipts.

Checks come from two passes: over claim x evidence, and over claim x attestation.
A claim without evidence gets no attestation checks. Receipts roll checks up per object.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import SIGNATURE, VERIFIER_VERSION
from ..functions.expr import by_rank, digest_bytes, ident, packed, true
from .refs import OBJECT, cited, crowded, dealt, join_evidence, resolve_attestations, resolve_evidence

SEVERITY = ["PASS", "UNRESOLVED", "FAIL"]
CHECK_COLUMNS = ["object_id", "claim_id", "check_id", "check_type", "result", "ref"]


# (kind, type, result, whether the id names a ref) of every check. Rows carry a check's place in this list
# until they are read, so that ids and types are written only where someone asks for them.
RULES = [
    ("claim-state", "CLAIM_STATE", "FAIL", False),
    ("inference-boundary", "INFERENCE_BOUNDARY", "UNRESOLVED", False),
    ("claim-conflict", "EVIDENCE_CONFLICT", "FAIL", False),
    ("evidence-presence", "EVIDENCE_PRESENCE", "FAIL", False),
    ("evidence", "EVIDENCE_REFERENCE", "FAIL", True),
    ("authority-boundary", "AUTHORITY_BOUNDARY", "UNRESOLVED", True),
    ("content-hash", "CONTENT_HASH", "PASS", True),
    ("content-hash", "CONTENT_HASH", "FAIL", True),
    ("freshness", "FRESHNESS", "FAIL", True),
    ("evidence", "EVIDENCE_AVAILABLE", "PASS", True),
    ("attestation-presence", "ATTESTATION_PRESENCE", "FAIL", True),
    ("attestation", "ATTESTATION_REVOCATION", "FAIL", True),
    ("attestation-expiry", "ATTESTATION_EXPIRY", "FAIL", True),
    ("attestor-authority", "ATTESTOR_AUTHORITY", "FAIL", True),
    ("attestation-signature", "ATTESTATION_SIGNATURE", "FAIL", True),
    ("attestation-signature", "ATTESTATION_SIGNATURE", "PASS", True),
    ("attestation-valid", "ATTESTATION_VALID", "PASS", True),
]


def _check(check_type: str, result: str) -> Column:
    """The place of a check in the list of rules."""
    return F.lit(next(i for i, rule in enumerate(RULES) if rule[1:3] == (check_type, result)))


def _written(df: DataFrame, ref: str | None = None, by: Sequence[str] = OBJECT) -> DataFrame:
    """Rows (object_id, claim_id, rule, ref column) as checks."""
    kind, check_type, result, named = (F.get(F.array(*[F.lit(rule[i]) for rule in RULES]), F.col("rule")) for i in range(4))
    none = F.lit(None).cast("string")
    about = none if ref is None else F.when(named, F.col(ref))
    bare = ident("check", F.col("claim_id"), kind)
    return df.select(
        *by, "claim_id", (bare if ref is None else F.when(named, ident("check", F.col("claim_id"), kind, F.col(ref))).otherwise(bare)).alias("check_id"),
        check_type.alias("check_type"), result.alias("result"), about.alias("ref"),
    )


def _unfold(df: DataFrame, *checks: Column, ref: str | None = None, by: Sequence[str] = OBJECT) -> DataFrame:
    rows = df.select(*by, "claim_id", *([ref] if ref else []), F.explode(F.array(*checks)).alias("rule"))
    return _written(rows.filter(F.col("rule").isNotNull()), ref, by)


def check_claim_state(claims: DataFrame) -> DataFrame:
    """Checks that follow from the claim's own state."""
    return _unfold(claims, _state_check())


def _state_check() -> Column:
    state = F.col("state")
    return (
        F.when(state == "REVOKED", _check("CLAIM_STATE", "FAIL"))
        .when(state == "INFERRED", _check("INFERENCE_BOUNDARY", "UNRESOLVED"))
        .when(state == "CONFLICTING", _check("EVIDENCE_CONFLICT", "FAIL"))
    )


def _presence_check() -> Column:
    return F.when(F.col("bare"), _check("EVIDENCE_PRESENCE", "FAIL"))


def check_evidence_presence(claims: DataFrame) -> DataFrame:
    """A claim that names no evidence fails."""
    return _unfold(claims.withColumn("bare", F.size("evidence_refs") == 0), _presence_check())


def _reference_check() -> Column:
    return F.when(~F.col("found"), _check("EVIDENCE_REFERENCE", "FAIL"))


def check_evidence_reference(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """An evidence ref that resolves to nothing fails."""
    return _unfold(resolve_evidence(claims, evidence.select("object_id", "evidence_id")), _reference_check(), ref="evidence_id")


def _inferred() -> Column:
    return (F.col("authority") == "AI_INFERENCE").alias("inferred")


def _authority_check() -> Column:
    return F.when(F.col("inferred"), _check("AUTHORITY_BOUNDARY", "UNRESOLVED"))


def check_authority(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence inferred by a model cannot verify a claim."""
    side = evidence.select("object_id", "evidence_id", _inferred())
    return _unfold(resolve_evidence(claims, side), _authority_check(), ref="evidence_id")


def with_body_check(evidence: DataFrame, contents: DataFrame | None, deal: bool = False) -> DataFrame:
    """Add whether the stored body has the recorded digest, null where no body is known; hashes and bodies stay behind.

    Bodies are hashed before the join, never shuffled. With `deal` evidence is dealt by object for it, which
    serves later joins on the object too.
    """
    if contents is None:
        return evidence.drop("content_hash").withColumn("same_body", F.lit(None).cast("boolean"))
    body = F.unhex(F.sha2(F.col("content"), 256))
    hashed = contents.select("object_id", "evidence_id", body.alias("body_bytes"))
    short = evidence.withColumn("hash_bytes", digest_bytes(F.lower("content_hash"))).drop("content_hash")
    same = F.when(F.col("body_bytes").isNotNull(), true(F.col("body_bytes") == F.col("hash_bytes")))
    joined = join_evidence(dealt(short) if deal else short, hashed)
    return joined.withColumn("same_body", same).drop("hash_bytes", "body_bytes")


def _content_check() -> Column:
    same = F.col("same_body")
    return F.when(
        F.col("found") & same.isNotNull(),
        F.when(same, _check("CONTENT_HASH", "PASS")).otherwise(_check("CONTENT_HASH", "FAIL")),
    )


def check_content_hash(claims: DataFrame, evidence: DataFrame, contents: DataFrame) -> DataFrame:
    """Where the body is known, its digest must equal the recorded hash."""
    side = with_body_check(evidence.select("object_id", "evidence_id", "content_hash"), contents)
    return _unfold(resolve_evidence(claims, side), _content_check(), ref="evidence_id")


def _stale(now_ms: int, max_age_ms: int | None) -> Column:
    stale = F.col("freshness") == "STALE"
    if max_age_ms is not None:
        stale = true(stale) | (F.lit(now_ms) - F.col("observed_at") > max_age_ms)
    return true(stale).alias("stale")


def _freshness_check() -> Column:
    return F.when(
        F.col("found"),
        F.when(F.col("stale"), _check("FRESHNESS", "FAIL")).otherwise(_check("EVIDENCE_AVAILABLE", "PASS")),
    )


def check_freshness(
    claims: DataFrame, evidence: DataFrame, now_ms: int, max_age_ms: int | None = None
) -> DataFrame:
    """Exactly one row per resolved ref: stale, too old, or available."""
    side = evidence.select("object_id", "evidence_id", _stale(now_ms, max_age_ms))
    return _unfold(resolve_evidence(claims, side), _freshness_check(), ref="evidence_id")


def _marked(df: DataFrame, side: DataFrame | None, key: str, flag: str) -> DataFrame:
    if side is None:
        return df.withColumn(flag, F.lit(False))
    listed = side.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(listed, key, "left").withColumn(flag, true(F.col(flag)))


def judge_attestations(
    attestations: DataFrame,
    now_ms: int,
    attestors: DataFrame | None = None,
    valid_signatures: DataFrame | None = None,
    invalid_signatures: DataFrame | None = None,
    revoked: DataFrame | None = None,
    by: Sequence[str] = OBJECT,
) -> DataFrame:
    """(by, attestation_id, rule): the check of every attestation for a claim that names it. An expiry of 0 is none.

    What a row tells by itself is settled before it moves, and signatures move in short form.
    """
    expired = (F.col("expires_at") != 0) & (F.lit(now_ms) > F.col("expires_at"))
    short = packed(F.col("signature")).alias("signature")
    side = attestations.select(
        *by, "attestation_id", (F.col("state") == "REVOKED").alias("is_revoked"), true(expired).alias("expired"), "attestor",
        F.col("signature").rlike(SIGNATURE).alias("signed"), short,
    )
    side = _marked(side, revoked, "attestation_id", "listed_revoked")
    side = _marked(side, None if valid_signatures is None else valid_signatures.select(short), "signature", "good_signature")
    side = _marked(side, None if invalid_signatures is None else invalid_signatures.select(short), "signature", "bad_signature")
    # the signature itself is needed no further
    side = side.drop("signature")
    if attestors is None:
        side = side.withColumn("trusted", F.lit(True))
    else:
        registry = attestors.select(F.lower("attestor").alias("folded"))
        side = _marked(side.withColumn("folded", F.lower("attestor")), registry, "folded", "trusted")
    decided = (
        F.when(F.col("is_revoked") | F.col("listed_revoked"), _check("ATTESTATION_REVOCATION", "FAIL"))
        .when(F.col("expired"), _check("ATTESTATION_EXPIRY", "FAIL"))
        .when(~F.col("trusted"), _check("ATTESTOR_AUTHORITY", "FAIL"))
        .when(F.col("bad_signature"), _check("ATTESTATION_SIGNATURE", "FAIL"))
        .when(F.col("good_signature"), _check("ATTESTATION_SIGNATURE", "PASS"))
        .when(F.col("signed"), _check("ATTESTATION_VALID", "PASS"))
        .otherwise(_check("ATTESTATION_SIGNATURE", "FAIL"))
    )
    return side.select(*by, "attestation_id", decided.alias("rule"))


def check_attestations(
    claims: DataFrame, attestations: DataFrame, now_ms: int, by: Sequence[str] = OBJECT, **attestation_context: DataFrame | None
) -> DataFrame:
    """One check per attestation ref; the first failing rule decides. Attestations may be judged already."""
    judged = "rule" in attestations.columns
    side = attestations if judged else judge_attestations(attestations, now_ms, by=by, **attestation_context)
    rows = resolve_attestations(claims.filter(F.size("evidence_refs") > 0), side, by=by)
    rule = F.when(F.col("found"), F.col("rule")).otherwise(_check("ATTESTATION_PRESENCE", "FAIL"))
    return _written(rows.select(*by, "claim_id", "attestation_id", rule.alias("rule")), "attestation_id", by)


def verify_claims(
    claims: DataFrame,
    evidence: DataFrame,
    attestations: DataFrame,
    now_ms: int,
    max_age_ms: int | None = None,
    contents: DataFrame | None = None,
    by: Sequence[str] = OBJECT,
    deal: bool | None = None,
    **attestation_context: DataFrame | None,
) -> DataFrame:
    """All checks of all claims, with the rule version.

    Rows are told apart by the columns `by`, the object and what else names a version of it. `deal` tells whether they are
    to be dealt by object, which is found out where it is not given; rows that lie by object already need not be.
    """
    # dealt by object, so that one deal serves the joins here and roll-ups per object
    if deal is None:
        deal = not crowded((claims, evidence))
    # authority and age are judged where evidence lies, and only the answers move
    side = with_body_check(
        evidence.select(*by, "evidence_id", _inferred(), "content_hash", _stale(now_ms, max_age_ms)), contents, deal
    )
    # One pass over claims: checks on the claim itself ride on its first evidence ref.
    # Whether it is the first, and whether there is none, are settled here, so that the list does not travel.
    refs = claims.select(
        *by, "claim_id", "state", (F.size("evidence_refs") == 0).alias("bare"), F.posexplode_outer("evidence_refs").alias("pos", "evidence_id")
    ).withColumn("leads", F.coalesce("pos", F.lit(0)) == 0).drop("pos")
    rows = cited(dealt(refs) if deal else refs, side, deal and contents is None, by)
    leads, cites = F.col("leads"), F.col("evidence_id").isNotNull()
    per_evidence = _unfold(
        rows,
        *[F.when(leads, check) for check in (_state_check(), _presence_check())],
        *[
            F.when(cites, check)
            for check in (F.coalesce(_reference_check(), _freshness_check()), _authority_check(), _content_check())
        ],
        ref="evidence_id", by=by,
    )
    per_attestation = check_attestations(claims, attestations, now_ms, by, **attestation_context)
    checks = per_evidence.unionByName(per_attestation)
    return checks.withColumn("rule_version", F.lit(VERIFIER_VERSION))


def worst(result: Column) -> Column:
    """Aggregate: the worst result of a group; PASS when there is none."""
    rank = F.max(F.when(result == "FAIL", 3).when(result == "UNRESOLVED", 2).otherwise(1))
    return by_rank(F.coalesce(rank, F.lit(1)), SEVERITY)


def receipt_counts(checks: DataFrame, by: Sequence[str] = OBJECT) -> DataFrame:
    """Numbers of passed, failed and unresolved checks per object, and the worst result."""
    return checks.groupBy(*by).agg(
        F.count_if(F.col("result") == "PASS").alias("passed"),
        F.count_if(F.col("result") == "FAIL").alias("failed"),
        F.count_if(F.col("result") == "UNRESOLVED").alias("unresolved"),
        worst(F.col("result")).alias("overall_status"),
    )


def receipt_status(objects: DataFrame, checks: DataFrame, by: Sequence[str] = OBJECT) -> DataFrame:
    """Overall status of every object; an object without checks passes."""
    rolled = checks.groupBy(*by).agg(worst(F.col("result")).alias("overall_status"))
    return objects.select("object_id", "version").join(rolled, [*by], "left").withColumn(
        "overall_status", F.coalesce("overall_status", F.lit("PASS"))
    )


def verification_receipts(
    objects: DataFrame, checks: DataFrame, roots: DataFrame | None, now_ms: int
) -> DataFrame:
    """One receipt per object version; checks stay in their own table, keyed by object."""
    rolled = objects.select("object_id", "version").join(receipt_counts(checks), "object_id", "left")
    if roots is not None:
        rolled = rolled.join(roots.select("object_id", "evidence_root"), "object_id", "left")
    zero = F.lit(0)
    return rolled.select(
        F.concat(F.lit("verification:"), "object_id", F.lit(":v"), F.col("version").cast("string")).alias(
            "receipt_id"
        ),
        "object_id", "version",
        F.lit(VERIFIER_VERSION).alias("verifier_version"),
        F.coalesce("overall_status", F.lit("PASS")).alias("overall_status"),
        F.coalesce("passed", zero).alias("passed"),
        F.coalesce("failed", zero).alias("failed"),
        F.coalesce("unresolved", zero).alias("unresolved"),
        *([F.col("evidence_root")] if roots is not None else []),
        F.lit(now_ms).cast("long").alias("created_at"),
    )
