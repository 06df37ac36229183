"""Promotion of proposals by evidence authority, and evaluation of labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import AUTHORITATIVE, GATE_THRESHOLDS
from ..functions.expr import isin, true

REJECTED = ["REJECT_UNSUPPORTED", "REJECT_CONFLICTING", "REJECT_POLICY"]
ACCEPTED = ["ACCEPT_AS_CANDIDATE", "ACCEPT_AS_INFERRED"]


def _unknown_refs(rows: DataFrame, key: str, refs: str, known: DataFrame, known_id: str, flag: str) -> DataFrame:
    """Ids of rows with a ref that is not known."""
    exploded = rows.select(key, F.explode(refs).alias("ref"))
    side = known.select(F.col(known_id).alias("ref"))
    return exploded.join(side, "ref", "left_anti").select(key).distinct().withColumn(flag, F.lit(True))


def proposal_source_check(proposed: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Proposed claims with a flag telling whether every source ref is known."""
    unknown = _unknown_refs(proposed, "id", "source_refs", snapshots, "snapshot_id", "unknown_source")
    return proposed.join(unknown, "id", "left").withColumn(
        "sources_known", F.col("unknown_source").isNull()
    ).drop("unknown_source")


def promote_claims(proposed: DataFrame, snapshots: DataFrame, evidence: DataFrame) -> DataFrame:
    """Outcome of each proposed claim; the first failing rule decides, confidence plays no part."""
    first = evidence.select(
        F.col("evidence_id").alias("first_ref"), "authority", "freshness", F.lit(True).alias("held")
    )
    rows = proposal_source_check(proposed, snapshots).withColumn("first_ref", F.get("evidence_refs", 0)).join(
        first, "first_ref", "left"
    )
    bare = (F.size("source_refs") == 0) | (F.size("evidence_refs") == 0)
    unheld, stale = F.col("held").isNull(), true(F.col("freshness") == "STALE")
    known = F.col("sources_known")
    strong = isin(F.col("authority"), AUTHORITATIVE)
    outcome = (
        F.when(bare | ~known | unheld, "REJECT_UNSUPPORTED").when(stale, "REQUIRE_REVIEW")
        .when(strong, "ACCEPT_AS_CANDIDATE").otherwise("ACCEPT_AS_INFERRED")
    )
    reason = (
        F.when(bare, "REASON_EVIDENCE_MISSING").when(~known, "REASON_SOURCE_SNAPSHOT_NOT_FOUND")
        .when(unheld, "REASON_EVIDENCE_NOT_FOUND").when(stale, "REASON_EVIDENCE_STALE")
        .when(strong, "REASON_GROUNDED_AUTHORITATIVE").otherwise("REASON_INFERRED_NON_AUTHORITATIVE")
    )
    return rows.select(
        *proposed.columns, F.lit("CLAIM").alias("target_type"), outcome.alias("outcome"), reason.alias("reason_code")
    )


def promote_relationships(proposed: DataFrame, evidence: DataFrame) -> DataFrame:
    """Outcome of each proposed relationship; equivalence needs proof and evidence."""
    unknown = _unknown_refs(proposed, "relationship_id", "evidence_refs", evidence, "evidence_id", "unknown_evidence")
    rows = proposed.join(unknown, "relationship_id", "left")
    bare = F.size("evidence_refs") == 0
    claimed = F.col("predicate") == "ECONOMICALLY_EQUIVALENT_TO"
    unproven = claimed & (~true(F.col("is_equivalent")) | bare)
    lost = F.col("unknown_evidence").isNotNull()
    outcome = F.when(unproven, "REJECT_POLICY").when(bare | lost, "REJECT_UNSUPPORTED").otherwise("ACCEPT_AS_CANDIDATE")
    reason = (
        F.when(unproven, "REASON_EQUIVALENCE_EVIDENCE_INSUFFICIENT").when(bare, "REASON_EVIDENCE_MISSING")
        .when(lost, "REASON_EVIDENCE_NOT_FOUND").otherwise("REASON_RELATIONSHIP_GROUNDED")
    )
    return rows.select(
        *proposed.columns, F.lit("RELATIONSHIP").alias("target_type"), outcome.alias("outcome"), reason.alias("reason_code")
    )


def _promoted_state() -> Column:
    return F.when(F.col("outcome") == "ACCEPT_AS_CANDIDATE", "SOURCED").otherwise("INFERRED")


def canonical_claims(promoted: DataFrame, now_ms: int) -> DataFrame:
    """Claims of accepted proposals: sourced or inferred, never verified."""
    return promoted.filter(F.col("outcome").isin(ACCEPTED)).select(
        F.col("id").alias("claim_id"), "subject", "property", "value_json", "unit", _promoted_state().alias("state"),
        "source_refs", "evidence_refs", F.array().cast("array<string>").alias("attestation_refs"), "confidence",
        F.lit(now_ms).cast("long").alias("created_at"),
    )


def canonical_relationships(promoted: DataFrame, now_ms: int) -> DataFrame:
    """Relationships of accepted proposals."""
    return promoted.filter(F.col("outcome").isin(ACCEPTED)).select(
        "relationship_id", "subject", "predicate", "object", _promoted_state().alias("state"), "evidence_refs",
        "confidence", F.lit(now_ms).cast("long").alias("observed_at"),
    )


def proposal_summary(claims: DataFrame, relationships: DataFrame) -> DataFrame:
    """Accepted, rejected, reviewed and unresolved counts per proposal."""
    decided = claims.select("proposal_id", "outcome").unionByName(relationships.select("proposal_id", "outcome"))
    outcome = F.col("outcome")
    accepted, rejected, review = outcome.isin(ACCEPTED), outcome.isin(REJECTED), outcome == "REQUIRE_REVIEW"
    return decided.groupBy("proposal_id").agg(
        F.count_if(accepted).alias("accepted"), F.count_if(rejected).alias("rejected"),
        F.count_if(review).alias("review"), F.count_if(~accepted & ~rejected & ~review).alias("unresolved"),
    )


def eval_metrics(cases: DataFrame) -> DataFrame:
    """Accuracy per category and error rates, in one pass over labelled cases.

    Cases are (category, expected, predicted, must_block). Precision and false allows come
    from the labels.
    """
    hit = F.col("expected") == F.col("predicted")

    def of(category: str) -> Column:
        return F.col("category") == category

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(1.0))

    total = F.count("*")
    conflict = of("conflict")
    wrong_yes = F.col("predicted") & ~F.col("expected")
    return cases.agg(
        total.alias("total_cases"), F.count_if(hit).alias("passed_cases"),
        share(F.count_if(of("claim") & hit), F.count_if(of("claim"))).alias("claim_accuracy"),
        share(F.count_if(of("rights") & hit), F.count_if(of("rights"))).alias("rights_accuracy"),
        share(F.count_if(of("relationship") & hit), F.count_if(of("relationship"))).alias("relationship_accuracy"),
        share(F.count_if(conflict & F.col("expected") & F.col("predicted")), F.count_if(conflict & F.col("expected"))).alias("conflict_recall"),
        share(F.count_if(conflict & F.col("expected") & F.col("predicted")), F.count_if(conflict & F.col("predicted"))).alias("conflict_precision"),
        (F.count_if(of("claim") & wrong_yes) / F.greatest(total, F.lit(1))).alias("unsupported_inference_rate"),
        (F.count_if(of("relationship") & wrong_yes) / F.greatest(F.count_if(of("relationship")), F.lit(1))).alias("false_equivalence_rate"),
        (F.count_if(F.col("must_block") & F.col("predicted")) / F.greatest(total, F.lit(1))).alias("false_allow_rate"),
    )


def gate_violations(metrics: DataFrame) -> DataFrame:
    """One row per threshold a metrics row misses."""
    missed = [
        F.when(
            (F.col(name) > bound) if kind == "max" else (F.col(name) < bound),
            F.struct(F.lit(name).alias("metric"), F.lit(bound).alias("bound"), F.col(name).alias("found")),
        )
        for name, bound, kind in GATE_THRESHOLDS
    ]
    return metrics.select(F.explode(F.array_compact(F.array(*missed))).alias("m")).select("m.*")


def promotion_gate(metrics: DataFrame) -> DataFrame:
    """Status and score of a metrics row; false equivalences or allows call for a redesign."""
    misses = [
        (F.col(name) > bound) if kind == "max" else (F.col(name) < bound) for name, bound, kind in GATE_THRESHOLDS
    ]
    count = sum((m.cast("int") for m in misses[1:]), misses[0].cast("int"))
    grave = (F.col("false_equivalence_rate") > 0) | (F.col("false_allow_rate") > 0)
    return metrics.select(
        F.when(count == 0, "PASS").when(grave, "REDESIGN_REQUIRED").otherwise("FAIL").alias("status"),
        (F.col("passed_cases") / F.greatest("total_cases", F.lit(1)) * 100).alias("gate_score"), count.alias("violations"),
    )


def run_receipts(runs: DataFrame) -> DataFrame:
    """Latency, never negative, and total tokens of each run."""
    return runs.withColumns({
        "latency_ms": F.greatest(F.lit(0), F.col("completed_at") - F.col("started_at")),
        "total_tokens": F.col("input_tokens") + F.col("output_tokens"),
    })


def run_telemetry(runs: DataFrame) -> DataFrame:
    """Runs, tokens and latency per model."""
    return run_receipts(runs).groupBy("model_id").agg(
        F.count("*").alias("runs"), F.sum("total_tokens").alias("total_tokens"),
        F.avg("latency_ms").alias("mean_latency_ms"), F.max("latency_ms").alias("max_latency_ms"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)").cast("long").alias("median_latency_ms"),
        F.count_if(F.col("status") != "SUCCESS").alias("rejected_runs"),
    )
