"""Reference resolution: claims to evidence, attestations, snapshots and edges.

All joins are equi-joins on ids. Rows are dealt by object before them, so that one deal serves all joins
and groups of an object. The looked-up side is unique on its id, so a hot id on the other side is
spread by the adaptive skew join where an object is too large to be dealt whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import true
from ..functions.ordered import RUN_LIMIT

CROWD_BUCKETS = 1 << 16
OBJECT = ("object_id",)


def crowd(df: DataFrame) -> int:
    """At least the rows of the largest object: those of the fullest of a fixed number of buckets of objects."""
    bucket = F.pmod(F.xxhash64("object_id"), F.lit(CROWD_BUCKETS))
    return df.groupBy(bucket.alias("bucket")).count().agg(F.max("count")).first()[0] or 0


def crowded(sources: Iterable[DataFrame], limit: int = RUN_LIMIT) -> bool:
    """Whether some object may have more than `limit` rows in the sources together."""
    ids = [s.select("object_id") for s in sources]
    return any(s.isStreaming for s in ids) or crowd(reduce(DataFrame.union, ids)) > limit


def by_object(rows: DataFrame, *sources: DataFrame, limit: int = RUN_LIMIT) -> DataFrame:
    """The rows dealt by object: their joins and groups on the object and further keys need no deal of their own.

    Rows of an object that lie together in the input stay together, which packs better than rows dealt by
    id. Where an object has more than `limit` rows in the sources of the joins, the joins spread it instead.
    """
    return rows if crowded(sources, limit) else dealt(rows)


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt by object."""
    # by default Spark deals both sides of a join again unless they are dealt by all of its keys
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    plain_unions(rows.sparkSession)
    return rows.repartition("object_id")


def plain_unions(spark: SparkSession) -> None:
    """Groups of a union are dealt again, however its parts lie.

    Spark 4.1 takes a union of parts dealt alike as dealt, but adaptive plans may then put the parts behind each other, and
    joins above fail ("Can't zip RDDs with unequal numbers of partitions").
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def claim_refs(claims: DataFrame, refs: str, out: str, *carry: str) -> DataFrame:
    """One row per (claim, ref) of an array column."""
    return claims.select("object_id", "claim_id", *carry, F.explode(refs).alias(out))


def resolve_evidence(claims: DataFrame, evidence: DataFrame, *carry: str, held: Iterable[DataFrame] | None = None) -> DataFrame:
    """Claim x evidence ref with the evidence columns; `found` is false when it dangles.

    `held` are the tables that tell how crowded objects are, where the evidence comes out of a join.
    """
    refs = claim_refs(claims, "evidence_refs", "evidence_id", *carry)
    deal = not crowded(held or (claims, evidence))
    return cited(dealt(refs) if deal else refs, evidence, deal)


def cited(refs: DataFrame, evidence: DataFrame, deal: bool = False, by: Sequence[str] = OBJECT) -> DataFrame:
    """Cited rows with the evidence columns; `found` is false where the reference dangles.

    With `deal` evidence is dealt by object as the refs are, before the hash that it is sorted by is added.
    """
    side = evidence.withColumn("found", F.lit(True))
    return join_evidence(refs, dealt(side) if deal else side, by).withColumn("found", true(F.col("found")))


def join_evidence(rows: DataFrame, side: DataFrame, by: Sequence[str] = OBJECT) -> DataFrame:
    """Left join on object and evidence id. Ids begin alike, so both sides are sorted by a hash of the key first."""
    key = [*by, "evidence_id"]
    place = F.xxhash64(*key)
    return rows.withColumn("place", place).join(side.withColumn("place", place), ["place", *key], "left").drop("place")


def resolve_attestations(claims: DataFrame, attestations: DataFrame, *carry: str, by: Sequence[str] = OBJECT) -> DataFrame:
    """Claim x attestation ref with the attestation columns."""
    refs = claim_refs(claims, "attestation_refs", "attestation_id", *by[1:], *carry)
    side = attestations.withColumn("found", F.lit(True))
    return refs.join(side, [*by, "attestation_id"], "left").withColumn(
        "found", true(F.col("found"))
    )


def orphan_evidence_refs(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct evidence refs of an object that resolve to nothing."""
    refs = claim_refs(claims, "evidence_refs", "evidence_id").drop("claim_id").distinct()
    return refs.join(evidence, ["object_id", "evidence_id"], "left_anti")


def resolve_snapshot_strict(evidence: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Evidence with the snapshot whose id its source names."""
    side = snapshots.select(
        F.col("snapshot_id").alias("source"), F.col("source_id").alias("snapshot_source_id"),
        F.col("content_hash").alias("snapshot_hash"), F.lit(True).alias("resolved"),
    )
    return evidence.join(side, "source", "left").withColumn("resolved", true(F.col("resolved")))


def resolve_snapshot_loose(evidence: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Evidence with a snapshot found by id, else the first one of that source id.

    Both lookups are one unique table, so a source that much evidence names is split by one join.
    """
    by_id = snapshots.select(F.col("snapshot_id").alias("source"), F.struct(F.lit(0).alias("rank"), "snapshot_id").alias("found"))
    by_source = snapshots.select(F.col("source_id").alias("source"), F.struct(F.lit(1).alias("rank"), "snapshot_id").alias("found"))
    lookup = by_id.unionByName(by_source).groupBy("source").agg(F.min("found").alias("found"))
    return evidence.join(lookup, "source", "left").withColumn("snapshot_id", F.col("found.snapshot_id")).drop("found")


def orphan_sources(evidence: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Distinct sources that are neither a snapshot id nor a source id."""
    known = snapshots.select(F.col("snapshot_id").alias("source"))
    groups = snapshots.select(F.col("source_id").alias("source"))
    return (
        evidence.select("source").distinct()
        .join(known, "source", "left_anti").join(groups, "source", "left_anti")
    )


def claim_edges(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Claim x evidence ref with each edge that leads exactly from one to the other."""
    side = edges.select(
        "object_id", F.col("from_ref").alias("claim_id"), F.col("to_ref").alias("evidence_id"), "edge_id"
    )
    refs = by_object(claim_refs(claims, "evidence_refs", "evidence_id"), claims, edges)
    return refs.join(side, ["object_id", "claim_id", "evidence_id"], "left")


def neighbour_edges(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges touching a claim or evidence some claim cites, from either end.

    Rows are (object, node, edge) where the node is the claim or the evidence itself. Listing
    every edge of shared evidence again for each claim citing it would grow with the square
    of the claims, so that step is left to a join on the claim's refs.
    """
    nodes = (
        claims.select("object_id", F.col("claim_id").alias("node_id"), F.lit("CLAIM").alias("node_kind"))
        .unionByName(
            claim_refs(claims, "evidence_refs", "node_id").drop("claim_id").distinct()
            .withColumn("node_kind", F.lit("EVIDENCE"))
        )
    )
    # an edge moves once, and its two ends are told apart where it lies
    near = by_object(edges.select("object_id", "edge_id", "from_ref", "to_ref"), claims, edges)
    ends = near.select(
        "object_id", "edge_id", F.explode(F.array_distinct(F.array("from_ref", "to_ref"))).alias("node_id")
    )
    return ends.join(nodes, ["object_id", "node_id"]).select("object_id", "node_kind", "node_id", "edge_id")


def delta_join(current: DataFrame, incoming: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """Incoming rows against current ones by key: `is_new`, and a changed flag per column."""
    side = current.select(
        *key, F.lit(True).alias("known"), *[F.col(c).alias(f"old_{c}") for c in compared]
    )
    joined = incoming.select(*key, *compared).join(side, key, "left")
    return joined.select(
        *key,
        F.col("known").isNull().alias("is_new"),
        *[
            (F.col("known").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"old_{c}"))).alias(f"{c}_changed")
            for c in compared
        ],
    )


def trusted_attestors(attestations: DataFrame, registry: DataFrame) -> DataFrame:
    """Attestations with a flag telling whether the attestor is registered, case-folded."""
    side = registry.select(F.lower("attestor").alias("folded")).distinct().withColumn("known", F.lit(True))
    return (
        attestations.withColumn("folded", F.lower("attestor")).join(side, "folded", "left")
        .withColumn("trusted", true(F.col("known"))).drop("folded", "known")
    )
