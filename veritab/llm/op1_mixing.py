"""Operator 1: mixing sources to target weights by weighted fair queueing.

Within its source each document has a place in a fixed shuffle (the order of a digest of its id).
Its virtual finish time is the source's words up to and including it, divided by the source's
target; a further pass over the source adds the source's size. Over all sources the documents are
ranged by finish time and taken from the front until the budget of words is spent.

Running sums are made in two steps, over slots and within a slot, both over a source (slots of
the digest) and over all finish times (ranges of time), so neither a source with a third of all
rows nor the global order puts many rows into one task. Only columns, joins and windows are used.

Defined results: null text has size 0 and is never taken; a null source is one source, ordered
last; rows that repeat a doc_id are documents of their own; with a null doc_id the order falls back
to the size; with no words at all every target is 0 and nothing is taken; an empty table gives no
rows; columns named like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import keeps_columns
from .registry import query, table
from .text import WORD

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
RANGES = 4096
SEED = "mix-1"


def _sized(docs: DataFrame) -> DataFrame:
    """Rows with size, source key, place in the shuffle and slot, dealt by source and slot."""
    words = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0))
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.withColumns({
        "__size": F.when(F.col("text").isNull(), 0).otherwise(words).cast("long"),
        "__none": F.col("source").isNull(),
        "__from": F.coalesce(F.col("source"), F.lit("")),
        "__order": digest,
        "__slot": F.substring(digest, 1, 3),
    })
    return rows.repartition("__none", "__from", "__slot")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """(__none, __from, __source_size) to the same with __target: shares by weight, none above `passes` times its size.

    One row per source. The level of the shares is found in closed form: with sources in order of
    cap / weight, the first one whose cap the remaining level does not reach fixes the level for
    all that follow; levels after it are no higher, so it is the highest of those that fit.
    """
    everything = W.partitionBy()
    by_name = W.orderBy("__none", "__from")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("__weight", weight)
    rows = rows.withColumns({
        "__cap": F.col("__source_size") * F.lit(float(passes)),
        "__ratio": F.col("__source_size") * F.lit(float(passes)) / F.col("__weight"),
        "__budget": F.sum("__source_size").over(everything),
    })
    earlier = W.orderBy("__ratio", "__none", "__from").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("__ratio", "__none", "__from").rowsBetween(0, W.unboundedFollowing)
    level = (F.col("__budget") - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0))) / F.sum("__weight").over(rest)
    rows = rows.withColumn("__level", level)
    found = F.max(F.when(F.col("__ratio") >= F.col("__level"), F.col("__level"))).over(everything)
    return rows.withColumn("__target", F.least(F.col("__cap"), F.coalesce(found, F.col("__ratio")) * F.col("__weight"))).select(
        "__none", "__from", "__source_size", "__target", "__budget"
    )


@keeps_columns
def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """`docs` with size, source_size, target and taken, the words of the document that the mix takes."""
    rows = _sized(docs)
    source = ["__none", "__from"]
    slots = rows.groupBy(*source, "__slot").agg(F.sum("__size").alias("__in_slot"))
    up_to = W.partitionBy(*source).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    slots = slots.withColumn("__before", F.coalesce(F.sum("__in_slot").over(up_to), F.lit(0)))
    targets = source_targets(slots.groupBy(*source).agg(F.sum("__in_slot").alias("__source_size")), weights, passes)
    plan = slots.join(targets, source).drop("__in_slot")
    within = W.partitionBy(*source, "__slot").orderBy("__order", "__size").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("__sum", F.sum("__size").over(within)).join(plan, [*source, "__slot"])
    finish = lambda k: (F.col("__source_size") * F.lit(k) + F.col("__before") + F.col("__sum")).cast("double") / F.col("__target")
    turn = lambda k: F.struct(finish(k).alias("finish"), F.col("__order").alias("order"), F.lit(k).alias("pass"), F.col("__size").alias("size"))

    turns = placed.filter("__size > 0").select(F.explode(F.array(*[turn(k) for k in range(passes)])).alias("__turn"), "__budget")
    turns = turns.withColumn("__range", F.least(F.floor(F.col("__turn.finish") * RANGES), F.lit(2 * RANGES)).cast("int"))
    ranges = turns.groupBy("__range").agg(F.sum("__turn.size").alias("__in_range"), F.first("__budget").alias("__all"))
    ahead = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("__ahead", F.coalesce(F.sum("__in_range").over(ahead), F.lit(0))).filter("__ahead < __all")
    last = ranges.agg(F.max_by(F.struct("__range", "__ahead", "__all"), "__range").alias("__cut")).select("__cut.*")
    crossing = turns.join(last, "__range")
    ordered = W.partitionBy("__range").orderBy("__turn").rowsBetween(W.unboundedPreceding, 0)
    crossing = crossing.withColumn("__total", F.col("__ahead") + F.sum("__turn.size").over(ordered)).filter("__total <= __all")
    end = crossing.agg(F.max("__turn").alias("__end"))
    start = last.agg(F.max("__range").alias("__first"))

    taken = sum(
        (
            F.when(
                (F.floor(finish(k) * RANGES) < F.col("__first")) | F.coalesce(turn(k) <= F.col("__end"), F.lit(False)),
                F.col("__size"),
            ).otherwise(F.lit(0))
            for k in range(passes)
        ),
        start=F.lit(0).cast("long"),
    )
    limits = placed.withColumns({"__end": end.scalar(), "__first": start.scalar()})
    names = ["size", "source_size", "target", "taken"]
    return limits.select(
        *[F.col(c) for c in docs.columns if c.lower() not in names],
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.when(F.col("__size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken"),
    )


ORACLE = rf"""
    WITH sized AS (
        SELECT doc_id, source, md5('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS ord,
               coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
        FROM documents
    ), sources AS (
        SELECT source, sum(size)::DOUBLE AS source_size, 3.0::DOUBLE * sum(size) AS cap,
               [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
        FROM sized GROUP BY source
    ), leveled AS (
        SELECT *, cap / weight AS ratio, sum(source_size) OVER () AS budget,
               (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM sources
    ), targets AS (
        SELECT source, source_size, budget,
               least(cap, coalesce((SELECT max(level) FROM leveled WHERE ratio >= level), ratio) * weight) AS target
        FROM leveled
    ), placed AS (
        SELECT s.*, t.source_size, t.target, t.budget,
               sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.size ROWS UNBOUNDED PRECEDING) AS upto
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    ), turns AS (
        SELECT doc_id, size, ord, pass, budget, (source_size * pass + upto)::DOUBLE / target AS finish
        FROM placed, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0
    ), queue AS (
        SELECT *, sum(size) OVER (ORDER BY finish, ord, pass, size ROWS UNBOUNDED PRECEDING) AS total FROM turns
    ), took AS (
        SELECT doc_id, sum(size) AS taken FROM queue WHERE total <= budget GROUP BY doc_id
    )
    SELECT p.doc_id, p.size::BIGINT AS size, p.source_size::BIGINT AS source_size, p.target, coalesce(k.taken, 0)::BIGINT AS taken
    FROM placed p LEFT JOIN took k ON p.doc_id = k.doc_id
"""


@query("op1_mixing", ORACLE)
def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
