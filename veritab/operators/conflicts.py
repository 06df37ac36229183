"""Conflicting claims about one property of one subject.

Whether a group conflicts follows from minima and maxima, in linear time. Pairs are not listed:
each claim in conflict gets one row per cause it conflicts by, with a witness on the other side,
found from at most one bound row per (kind, staleness, authority) of the group. The shape is the
same for groups of any size, and no claim in conflict is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import EVIDENCE_AUTHORITIES
from ..functions.expr import folded, ident, true
from ..functions.ordered import RUN_LIMIT
from ..session import pin

TOLERANCE = 0.0001
GROUP = ["subject", "property"]
SLOTS = 1 << 26
CAUSES = [
    "STALE_SOURCE", "SHARE_CLASS_MISMATCH", "REPRESENTATION_MISMATCH", "UNKNOWN_AUTHORITY", "EFFECTIVE_DATE_MISMATCH",
]


def comparable(claims: DataFrame) -> DataFrame:
    """Claims with the form values are compared in: `form`, `num` and `txt`."""
    kind = F.col("value_kind")
    form = F.when(kind == "number", "number").when(kind == "string", "string").otherwise("other")
    return claims.select(
        *GROUP, "claim_id", form.alias("form"),
        F.when(kind == "number", F.col("value_num")).alias("num"),
        F.when(kind == "number", F.lit(None)).when(kind == "string", folded(F.col("value_str")))
        .otherwise(F.col("value_json")).alias("txt"),
        F.get("evidence_refs", 0).alias("evidence_id"), "evidence_refs",
    )


def _group_facts(values: DataFrame) -> DataFrame:
    # Texts of different forms need no telling apart here: a mixed group conflicts anyway.
    code = F.when(F.col("form") == "number", 1).when(F.col("form") == "string", 2).otherwise(3)
    facts = values.groupBy(*GROUP).agg(
        F.count("*").alias("claims"), (F.min(code) != F.max(code)).alias("mixed"),
        (F.max("num") - F.min("num")).alias("spread"), (F.min("txt") != F.max("txt")).alias("worded"),
    )
    differ = F.col("mixed") | true(F.col("spread") > TOLERANCE) | true(F.col("worded"))
    return facts.select(*GROUP, "claims", differ.alias("conflicting"))


def conflict_groups(claims: DataFrame) -> DataFrame:
    """Number of claims per (subject, property) and whether any two of them conflict."""
    return _group_facts(comparable(claims))


def _cause(prop: Column, stale: Column, same_authority: Column) -> Column:
    return (
        F.when(stale, "STALE_SOURCE").when(prop == "shareClass", "SHARE_CLASS_MISMATCH")
        .when(prop.isin("economicIdentity", "issuer"), "REPRESENTATION_MISMATCH")
        .when(~same_authority, "UNKNOWN_AUTHORITY").otherwise("EFFECTIVE_DATE_MISMATCH")
    )


def _with_first_evidence(values: DataFrame, evidence: DataFrame) -> DataFrame:
    """Staleness and authority of the first evidence, from one pass over the values.

    Claims without any are spread over the join by their own id. Authorities outside the fixed list
    count as one, which bounds the bounds of a group.
    """
    known = F.col("authority").isin(EVIDENCE_AUTHORITIES)
    authority = F.when(F.col("authority").isNull() | known, F.col("authority")).otherwise("OTHER")
    first = evidence.select(
        F.xxhash64("evidence_id").alias("place"), "evidence_id", (F.col("freshness") == "STALE").alias("stale"), authority.alias("authority")
    )
    # ids begin alike, so both sides are sorted by a hash first
    place = F.xxhash64(F.when(F.col("evidence_id").isNull(), F.col("claim_id")).otherwise(F.col("evidence_id")))
    rows = values.withColumn("place", place).join(first, ["place", "evidence_id"], "left")
    return rows.drop("place", "evidence_id").withColumn("stale", true(F.col("stale")))


def _shared(claims: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """Claims that may share their group with another one, and whether a group may have more than `limit` of them.

    A claim alone in its group conflicts with none. Groups are counted by a hash, 8 bytes a claim; the hashes of two claims or
    more are marked in a bitmap of fixed size, so that the claims themselves are told apart where they lie. A wrongly marked
    claim is only judged for nothing.
    """
    # null keys make no group
    grouped = claims.filter(F.col("subject").isNotNull() & F.col("property").isNotNull())
    place = F.xxhash64(*GROUP)
    # dealt before they are counted: most groups are small, and a table ahead of the shuffle would hold all of them
    counted = grouped.select(place.alias("place")).repartition("place").groupBy("place").count().filter("count > 1")
    slots = counted.select(_word(F.col("place")).alias("word"), _bit(F.col("place")).alias("bit"), "count")
    words = pin(slots.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("marks"), F.max("count").alias("most")))
    crowded = (words.agg(F.max("most")).first()[0] or 0) > limit
    marked = (F.col("word") == _word(place)) & (F.getbit("marks", _bit(place)) == 1)
    return grouped.join(F.broadcast(words.select("word", "marks")), marked, "left_semi"), crowded


def _word(place: Column) -> Column:
    return F.shiftright(F.pmod(place, F.lit(SLOTS)), 6)


def _bit(place: Column) -> Column:
    return F.pmod(place, F.lit(64)).cast("int")


def _with_bounds(values: DataFrame, columns: list[str], crowded: bool) -> DataFrame:
    """Values with `bounds`: the extreme claims of their group per (form, staleness, authority).

    Groups are dealt whole, once, and sorted once: windows find the extremes of each kind and hand them to every claim
    of the group. Where groups are too large for that, partial aggregates find them and a join spreads them.
    """
    kind = ["form", "stale", "authority"]
    extremes = {
        "low_num": F.min(F.struct("num", *columns)), "high_num": F.max(F.struct("num", *columns)),
        "low_txt": F.min(F.struct("txt", *columns)), "high_txt": F.max(F.struct("txt", *columns)), "any": F.min(F.struct(*columns)),
    }
    # At most forms x staleness x authorities entries.
    entry = F.struct(*kind, *extremes)
    if crowded:
        bounds = values.groupBy(*GROUP, *kind).agg(*[value.alias(name) for name, value in extremes.items()])
        return values.join(bounds.groupBy(*GROUP).agg(F.collect_list(entry).alias("bounds")), GROUP)
    key = ["place", *GROUP]
    alike = W.partitionBy(*key, *kind)
    rows = values.withColumn("place", F.xxhash64(*GROUP)).repartition("place")
    rows = rows.select("*", *[value.over(alike).alias(name) for name, value in extremes.items()], F.row_number().over(alike.orderBy(F.lit(0))).alias("nth"))
    once = F.collect_list(F.when(F.col("nth") == 1, entry)).over(W.partitionBy(*key))
    return rows.withColumn("bounds", once).drop("place", "nth", *extremes)


def _witnessed(values: DataFrame, columns: list[str], crowded: bool) -> DataFrame:
    """One row per (claim, cause) for every claim in conflict within its group, with `columns` of claim and witness."""

    def judged(b: Column) -> Column:
        side = lambda name: F.struct(*[b[name][c].alias(c) for c in columns])
        witness = (
            F.when(b["form"] != F.col("form"), side("any"))
            .when(b["high_num"]["num"] - F.col("num") > TOLERANCE, side("high_num"))
            .when(F.col("num") - b["low_num"]["num"] > TOLERANCE, side("low_num"))
            .when(b["low_txt"]["txt"] != F.col("txt"), side("low_txt"))
            .when(b["high_txt"]["txt"] != F.col("txt"), side("high_txt"))
        )
        cause = _cause(
            F.col("property"), F.col("stale") | b["stale"], b["authority"].eqNullSafe(F.col("authority"))
        )
        return F.struct(cause.alias("cause"), witness.alias("witness"))

    met = F.filter(F.transform("bounds", judged), lambda j: j["witness"].isNotNull())
    rows = _with_bounds(values, columns, crowded).withColumn("met", met)

    def first_witness(cause: str) -> Column:
        mine = F.filter("met", lambda j: j["cause"] == cause)
        return F.array_min(F.transform(mine, lambda j: j["witness"]))

    by_cause = F.array(*[
        F.struct(F.lit(cause).alias("cause"), first_witness(cause).alias("witness")) for cause in CAUSES
    ])
    found = rows.select(*GROUP, *columns, F.explode(by_cause).alias("c")).filter(F.col("c.witness.claim_id").isNotNull())
    named = {"claim_id": "witness", "evidence_refs": "witness_refs"}
    return found.select(*GROUP, *columns, "c.cause", *[F.col(f"c.witness.{c}").alias(named[c]) for c in columns])


def claims_in_conflict(claims: DataFrame, limit: int = RUN_LIMIT) -> DataFrame:
    """Every claim that another claim of its group contradicts, with one such claim."""
    shared, crowded = _shared(claims, limit)
    values = comparable(shared).drop("evidence_id", "evidence_refs").withColumns({"stale": F.lit(False), "authority": F.lit(None).cast("string")})
    return _witnessed(values, ["claim_id"], crowded).select(*GROUP, "claim_id", "witness")


def conflict_profile(claims: DataFrame, evidence: DataFrame, refs: bool = True, limit: int = RUN_LIMIT) -> DataFrame:
    """Every claim in conflict, once per cause, with a witness and, with `refs`, the evidence refs of both; groups of any size."""
    columns = ["claim_id", "evidence_refs"] if refs else ["claim_id"]
    shared, crowded = _shared(claims, limit)
    values = comparable(shared) if refs else comparable(shared).drop("evidence_refs")
    return _witnessed(_with_first_evidence(values, evidence), columns, crowded)


def conflicts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Conflicts as rows of (claim, cause) with a witness and the evidence of both sides."""
    return conflict_profile(claims, evidence).select(
        ident("conflict", "prop", F.col("subject"), F.col("property"), F.col("claim_id"), F.col("cause")).alias("conflict_id"),
        *GROUP, "claim_id", "witness", F.col("cause").alias("likely_cause"),
        F.array_sort(F.array_distinct(F.concat("evidence_refs", "witness_refs"))).alias("evidence_refs"),
        F.lit("BLOCKING").alias("severity"),
    )


def conflict_issues(groups: DataFrame) -> DataFrame:
    """One open issue per conflicting group."""
    return groups.filter("conflicting").select(
        ident("issue", "unresolved", F.col("subject"), F.col("property"), "conflict").alias("id"), "subject",
        F.lit("EVIDENCE_CONFLICT").alias("issue_type"), F.col("property").alias("dimension"),
    )


def redemption_conflict(terms: DataFrame) -> DataFrame:
    """Subjects whose first two redemption rights, in id order, name different windows."""
    rights = terms.filter((F.col("kind") == "RIGHT") & (F.col("type") == "REDEMPTION"))
    row = F.struct("id", "redemption_window")
    first = rights.groupBy("subject").agg(F.min(row).alias("first"))
    second = (
        rights.join(first, "subject").filter(F.col("id") > F.col("first.id"))
        .groupBy("subject").agg(F.min(row).alias("second"), F.min("first").alias("first"))
    )
    one, two = F.col("first"), F.col("second")
    differ = F.lower(one["redemption_window"]) != F.lower(two["redemption_window"])
    return second.filter(differ).select(
        ident("conflict", "prop", F.col("subject"), "redemptionWindow", one["id"], two["id"]).alias("conflict_id"),
        "subject", one["redemption_window"].alias("window_a"), two["redemption_window"].alias("window_b"),
        F.lit("SHARE_CLASS_MISMATCH").alias("likely_cause"), F.lit("BLOCKING").alias("severity"),
    )
