"""Relationships between pairs of representations.

Which pairs to judge is an input table (a_id, b_id), as callers name them; two equi-joins
bring in the profiles. Pairing every member of a block with every other would grow with the
square of the block, so it is not done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import fan_out, ident, true

BRIDGED = "BRIDGED_REPRESENTATION_OF"


def representation_pairs(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requested pairs, once each, with both profiles as structs `a` and `b`."""

    def side(name: str) -> DataFrame:
        return profiles.select(F.col("id").alias(f"{name}_id"), F.struct(*profiles.columns).alias(name))

    return pairs.select("a_id", "b_id").distinct().join(side("a"), "a_id").join(side("b"), "b_id")


def parent_link(profiles: DataFrame) -> DataFrame:
    """Pairs (either way round) in which one is the bridged child of the other."""
    children = profiles.filter(F.col("relationship") == BRIDGED).select(
        F.col("id").alias("child"), F.col("parent").alias("id")
    )
    linked = children.join(profiles.select("id"), "id").select(F.col("id").alias("parent"), "child")
    down = linked.select(F.col("parent").alias("a_id"), F.col("child").alias("b_id"))
    up = linked.select(F.col("child").alias("a_id"), F.col("parent").alias("b_id"))
    return down.unionByName(up)


def ref_union() -> Column:
    """Evidence of both sides, each ref once."""
    return F.array_union("a.evidence_refs", "b.evidence_refs")


def _both(field: str) -> Column:
    return (F.length(f"a.{field}") > 0) & (F.length(f"b.{field}") > 0)


def _same(field: str, fold: bool = True) -> Column:
    a, b = F.col(f"a.{field}"), F.col(f"b.{field}")
    return true(_both(field) & ((F.lower(a) == F.lower(b)) if fold else (a == b)))


def _different(field: str) -> Column:
    return true(_both(field) & (F.lower(f"a.{field}") != F.lower(f"b.{field}")))


def _same_fund() -> Column:
    return _same("issuer") | _same("cusip", fold=False)


def _bridge() -> Column:
    return true(F.length("a.bridge_mechanism") > 0) | true(F.length("b.bridge_mechanism") > 0)


def _relation(name: str, predicate: str, confidence: float, equivalent: bool) -> Column:
    return F.struct(
        ident("rel", "prop", F.col("a_id"), name, F.col("b_id")).alias("id"), F.lit(predicate).alias("predicate"),
        F.lit(confidence).alias("confidence"), F.lit(equivalent).alias("is_equivalent"),
    )


def bridged() -> list[Column]:
    return [
        F.when(_bridge(), _relation("bridged", BRIDGED, 0.98, True)),
        F.when(
            _bridge() & _same_fund() & ~_different("share_class"),
            _relation("equiv", "ECONOMICALLY_EQUIVALENT_TO", 0.99, True),
        ),
    ]


def wrapped() -> list[Column]:
    either = true(F.col("a.is_wrapped")) | true(F.col("b.is_wrapped"))
    return [F.when(either, _relation("wrapped", "WRAPPED_REPRESENTATION_OF", 0.98, True))]


def share_class() -> list[Column]:
    apart = _same_fund() & _different("share_class")
    return [
        F.when(apart, _relation("shareClass", "SHARE_CLASS_OF", 0.96, False)),
        F.when(apart, _relation("similar", "SIMILAR_EXPOSURE_TO", 0.95, False)),
    ]


def similar_exposure() -> list[Column]:
    return [
        F.when(
            _different("issuer") & _same("asset_class"), _relation("similar", "SIMILAR_EXPOSURE_TO", 0.92, False)
        )
    ]


def _rows(paired: DataFrame, relations: list[Column]) -> DataFrame:
    return paired.select("a_id", "b_id", ref_union().alias("evidence_refs"), fan_out(*relations).alias("r")).select(
        "r.id", F.col("a_id").alias("subject"), "r.predicate", F.col("b_id").alias("object"),
        "r.confidence", "r.is_equivalent", "evidence_refs",
    )


def rel_bridged(paired: DataFrame) -> DataFrame:
    return _rows(paired, bridged())


def rel_wrapped(paired: DataFrame) -> DataFrame:
    return _rows(paired, wrapped())


def rel_share_class(paired: DataFrame) -> DataFrame:
    return _rows(paired, share_class())


def rel_similar_exposure(paired: DataFrame) -> DataFrame:
    return _rows(paired, similar_exposure())


def classify_relationships(paired: DataFrame) -> DataFrame:
    """All proposed relationships; one that two rules give under the same id comes once."""
    apart = _same_fund() & _different("share_class")
    exposure = [F.when(~apart, rule) for rule in similar_exposure()]
    return _rows(paired, bridged() + wrapped() + share_class() + exposure)


def _issue(name: str, kind: str) -> Column:
    return F.struct(
        ident("issue", "unresolved", F.col("a_id"), F.col("b_id"), name).alias("id"),
        F.lit(kind).alias("issue_type"), F.lit(name).alias("dimension"),
    )


def _issue_rows(paired: DataFrame, *issues: Column) -> DataFrame:
    return paired.select(F.col("a_id").alias("subject"), fan_out(*issues).alias("i")).select("subject", "i.*")


def _gap() -> Column:
    def named(side: str) -> Column:
        return F.length(F.concat_ws("", f"{side}.cusip", f"{side}.isin", f"{side}.issuer")) > 0

    return F.when(~named("a") | ~named("b"), _issue("identifiers", "IDENTITY_AMBIGUOUS"))


def _collision() -> Column:
    return F.when(_same("ticker") & _different("issuer"), _issue("tickerCollision", "RELATIONSHIP_AMBIGUOUS"))


def rel_identifier_gap(paired: DataFrame) -> DataFrame:
    """Pairs in which a side has no cusip, isin or issuer."""
    return _issue_rows(paired, _gap())


def rel_ticker_collision(paired: DataFrame) -> DataFrame:
    """Pairs sharing a ticker under different issuers."""
    return _issue_rows(paired, _collision())


def relationship_issues(paired: DataFrame) -> DataFrame:
    return _issue_rows(paired, _gap(), _collision())


def semantic_compare(paired: DataFrame) -> DataFrame:
    """Equivalent, similar or merely representing, with the differences found.

    A bridged parent link settles it unless the share classes differ.
    """

    def child_of(child: str, parent: str) -> Column:
        return true((F.col(f"{child}.parent") == F.col(f"{parent}.id")) & (F.col(f"{child}.relationship") == BRIDGED))

    def differs(field: str) -> Column:
        return true(_both(field) & (F.col(f"a.{field}") != F.col(f"b.{field}")))

    classes = true(F.col("a.share_class") != F.col("b.share_class"))
    reasons = F.array_compact(F.array(
        F.when(classes, "share_class"), F.when(differs("issuer"), "issuer"),
        F.when(differs("redemption_terms"), "redemption_terms"),
    ))
    linked = (child_of("b", "a") | child_of("a", "b")) & ~classes
    relation = (
        F.when(linked, "ECONOMICALLY_EQUIVALENT_TO").when(F.size(reasons) > 0, "SIMILAR_EXPOSURE_TO")
        .otherwise("REPRESENTS")
    )
    return paired.select(
        "a_id", "b_id", relation.alias("relationship"), linked.alias("is_equivalent"),
        F.when(linked, F.array().cast("array<string>")).otherwise(reasons).alias("differences"),
    )
