"""Object status from claim states, exceptions and evidence freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import by_rank, ident, isin
from .refs import OBJECT, claim_refs

PRECEDENCE = ["REVOKED", "CONFLICTING", "STALE", "INSUFFICIENT_EVIDENCE", "PARTIALLY_RESOLVED", "RESOLVED"]
GAPS = ["EVIDENCE_MISSING", "IDENTITY_AMBIGUOUS", "RELATIONSHIP_AMBIGUOUS", "UNSUPPORTED_REPRESENTATION"]


def object_status(
    objects: DataFrame, claims: DataFrame, exceptions: DataFrame, open_only: bool = False, by: Sequence[str] = OBJECT
) -> DataFrame:
    """Worst signal per object from claim states or exception types.

    Exceptions count whatever their own status is, unless `open_only` is set.
    """
    state, kind = F.col("state"), F.col("type")
    from_claims = claims.select(
        *by,
        F.when(state == "REVOKED", 1).when(state == "CONFLICTING", 2).when(state == "STALE", 3)
        .when(state.isin("UNKNOWN", "INFERRED"), 5).alias("rank"),
    )
    if open_only:
        exceptions = exceptions.filter(F.col("status") == "OPEN")
    from_exceptions = exceptions.select(
        *by,
        F.when(kind == "ATTESTATION_REVOKED", 1).when(kind == "EVIDENCE_CONFLICT", 2)
        .when(kind == "EVIDENCE_STALE", 3).when(isin(kind, GAPS), 4).alias("rank"),
    )
    ranked = from_claims.unionByName(from_exceptions).groupBy(*by).agg(F.min("rank").alias("rank"))
    return objects.join(ranked, [*by], "left").select(
        "object_id", "version", by_rank(F.coalesce("rank", F.lit(6)), PRECEDENCE).alias("status")
    )


def evidence_state(
    objects: DataFrame, evidence: DataFrame, claims: DataFrame, exceptions: DataFrame
) -> DataFrame:
    """The other precedence: stale evidence, then revoked, then conflicting claims.

    `first_stale` is the stale evidence with the lowest id; `raises_exception` tells whether a
    staleness exception is due because the object has none yet.
    """
    stale = evidence.filter(F.col("freshness") == "STALE").groupBy("object_id").agg(
        F.min("evidence_id").alias("first_stale")
    )
    flags = claims.groupBy("object_id").agg(
        F.bool_or(F.col("state") == "REVOKED").alias("revoked"),
        F.bool_or(F.col("state") == "CONFLICTING").alias("conflicting"),
    )
    known = exceptions.filter(F.col("type") == "EVIDENCE_STALE").select("object_id").distinct()
    joined = (
        objects.select("object_id", "version")
        .join(stale, "object_id", "left").join(flags, "object_id", "left")
        .join(known.withColumn("has_exception", F.lit(True)), "object_id", "left")
    )
    return joined.select(
        "object_id", "version",
        F.when(F.col("first_stale").isNotNull(), "STALE").when(F.col("revoked"), "REVOKED")
        .when(F.col("conflicting"), "CONFLICTING").otherwise("RESOLVED").alias("status"),
        "first_stale",
        (F.col("first_stale").isNotNull() & F.col("has_exception").isNull()).alias("raises_exception"),
    )


def stale_exceptions(states: DataFrame, claims: DataFrame, now_ms: int) -> DataFrame:
    """Exception rows due from `evidence_state`, one row per affected claim (null when none)."""
    due = states.filter("raises_exception").select("object_id", F.col("first_stale").alias("evidence_id"))
    affected = claim_refs(claims, "evidence_refs", "evidence_id").distinct()
    return due.join(affected, ["object_id", "evidence_id"], "left").select(
        ident("ex", "stale", F.col("evidence_id")).alias("exception_id"),
        "object_id", "evidence_id", "claim_id",
        F.lit("EVIDENCE_STALE").alias("type"), F.lit("BLOCKING").alias("severity"),
        F.lit("OPEN").alias("status"), F.lit(now_ms).cast("long").alias("detected_at"),
    )
