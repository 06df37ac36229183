"""Operator 12: shards of near equal bytes by sampled splitters.

Records are ordered by a key: a hash of their text, then one of their doc_id, so equal texts lie
side by side. Keys are drawn in proportion to size, splitters are the quantiles of the draws, and
every record belongs to the range between two splitters. Ranges are then measured over all records.
One that is overfull in bytes or in rows is subdivided by a draw of its own, within a text where
one text fills it, until none is or a single record is left. Ranges are many to a shard and go
to shards in key order by their measured bytes, so a shard is off its share by at most
about one range at each end.

Groups of equal texts stay in one shard unless they are larger than a range may be. A group that
holds a third of all rows is a run of ranges, so it goes to several shards and several tasks.

What the driver holds is the splitters: some RANGES to a shard, and one more for every ROWS rows.
Texts are read once; the narrow rows of keys and sizes are written to the shared folder, and all
else works on them.

Defined results: null text has no bytes and a CRC of 0 and is a text of its own, apart from the
empty one; a null doc_id and rows that repeat a doc_id are records of their own, told apart by
a number given when the narrow rows are written; shards may stay empty if there are few records;
an empty table gives no rows; other columns are passed through by `write_shards` and not
read otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritab.session import scratch_path

from .registry import query, table

SHARDS = 24
RANGES = 256
ROWS = 1 << 20
DRAWS = 8
ROUNDS = 24
OVERHEAD = 8

LAW = "bytes"
LOW = -(1 << 63)
SEED = 12
TIE = 1 << 20


def text_key() -> Column:
    return F.xxhash64("text", F.col("text").isNull())


def row_key(tie: Column) -> Column:
    """A hash of doc_id whose last bits tell rows with equal ids apart; they decide nothing between different ids."""
    return F.xxhash64(F.lit(SEED), "doc_id").bitwiseAND(F.lit(-TIE)).bitwiseOR(F.pmod(tie, F.lit(TIE)))


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, row_key, size, text_crc32), written once, so that ties keep their numbers."""
    spark = docs.sparkSession
    narrow = docs.select(
        "doc_id", text_key().alias("text_key"), row_key(F.xxhash64(F.monotonically_increasing_id())).alias("row_key"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    narrow.write.parquet(path := scratch_path(spark, "records"))
    return spark.read.parquet(path)


class Splitters:
    """Sorted first keys (text, row) of ranges; range 0 starts at the lowest key."""

    def __init__(self, firsts: set[tuple[int, int]]):
        self.firsts = sorted(firsts | {(LOW, LOW)})
        self.texts = np.array([t for t, _ in self.firsts], np.int64)
        self.rows = np.array([r for _, r in self.firsts], np.int64)

    def __len__(self) -> int:
        return len(self.firsts)

    def place(self, texts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The range of each key: the last one that starts at or before it."""
        low, high = np.searchsorted(self.texts, texts, "left"), np.searchsorted(self.texts, texts, "right")
        out = high - 1
        # texts at which a range starts: the second part of the key decides
        for text in np.unique(texts[high > low]):
            own = texts == text
            lo, hi = np.searchsorted(self.texts, text, "left"), np.searchsorted(self.texts, text, "right")
            out[own] = lo + np.searchsorted(self.rows[lo:hi], rows[own], "right") - 1
        return out

    def column(self) -> Column:
        @F.arrow_udf("int")
        def place(texts: pa.Array, rows: pa.Array) -> pa.Array:
            return pa.array(self.place(texts.to_numpy(zero_copy_only=False), rows.to_numpy(zero_copy_only=False)).astype(np.int32))

        return place("text_key", "row_key")


def draws(rows: DataFrame, weight: Column, seed: int) -> DataFrame:
    """(text_key, row_key, n): keys drawn on average `weight` times each, alike in every run."""
    chance = F.pmod(F.xxhash64(F.lit(seed), "text_key", F.shiftright("row_key", 20)), F.lit(1 << 40)) / F.lit(1 << 40)
    return rows.withColumn("n", F.floor(weight + chance)).filter("n > 0")


def quantiles(drawn: list[tuple[int, int, int]], parts: int) -> set[tuple[int, int]]:
    """First keys of `parts` ranges with equally many draws. A range starts with a text, unless that text alone fills ranges."""
    if not drawn or parts < 2:
        return set()
    drawn = sorted(drawn)
    total = sum(n for _, _, n in drawn)
    step = total / parts
    own: dict[int, int] = {}
    for text, _, n in drawn:
        own[text] = own.get(text, 0) + n
    out, seen, edge = set(), 0, step
    for text, row, n in drawn:
        if seen + n >= edge:
            out.add((text, row) if own[text] > step else (text, LOW))
            edge = (np.floor((seen + n) / step) + 1) * step
        seen += n
    return out


def split(rows: DataFrame, shards: int = SHARDS) -> tuple[Splitters, list[tuple[int, int, int]]]:
    """Splitters, and (bytes, rows, shard) of each range."""
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not count:
        return Splitters(set()), [(0, 0, 0)]
    parts = int(max(shards * RANGES, -(-count // ROWS)))
    full = max(2 * total / parts, 1), max(2 * count / parts, ROWS)
    picked = draws(rows, F.col("size") * F.lit(parts * DRAWS / total), SEED).select("text_key", "row_key", "n").collect()
    splitters = Splitters(quantiles([tuple(r) for r in picked], parts))
    for turn in range(1, ROUNDS + 1):
        ranged = rows.withColumn("range", splitters.column())
        found = {r["range"]: r for r in ranged.groupBy("range").agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("text_key").alias("low"), F.max("text_key").alias("high"),
            F.min("row_key").alias("first"), F.max("row_key").alias("last"),
        ).collect()}
        over = {k: r for k, r in found.items() if (r["size"] > full[0] or r["n"] > full[1]) and (r["low"], r["first"]) != (r["high"], r["last"]) and r["n"] > 1}
        if not over or turn == ROUNDS:
            break
        pieces = {k: int(np.ceil(2 * max(r["size"] / full[0], r["n"] / full[1]))) for k, r in over.items()}
        rate = rows.sparkSession.createDataFrame([(k, pieces[k] * DRAWS / r["size"]) for k, r in over.items()], "range int, rate double")
        picked = draws(ranged.join(rate, "range"), F.col("size") * F.col("rate"), SEED + turn).select("range", "text_key", "row_key", "n").collect()
        firsts = set(splitters.firsts)
        for k, r in over.items():
            drawn = [(p["text_key"], p["row_key"], p["n"]) for p in picked if p["range"] == k]
            more = quantiles(drawn, pieces[k]) - firsts
            # where nothing was drawn the range is halved, between texts or within its only one
            middle = lambda low, high: -(-(r[low] + r[high]) // 2)  # noqa: B023, E731
            firsts |= more or {(middle("low", "high"), LOW) if r["low"] < r["high"] else (r["high"], middle("first", "last"))}
        splitters = Splitters(firsts)
    ranges, seen = [], 0
    for k in range(len(splitters)):
        size, n = (found[k]["size"], found[k]["n"]) if k in found else (0, 0)
        ranges.append((size, n, min(int((seen + size / 2) * shards / total), shards - 1)))
        seen += size
    return splitters, ranges


def placed(rows: DataFrame, splitters: Splitters, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """`rows` with range, shard and slot; a window sees one range."""
    spark = rows.sparkSession
    before, table_rows = {}, []
    for k, (_, n, shard) in enumerate(ranges):
        table_rows.append((k, shard, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + n
    where = spark.createDataFrame(table_rows, "range int, shard int, before long")
    order = W.partitionBy("range").orderBy("text_key", "row_key", "doc_id")
    numbered = rows.withColumn("range", splitters.column()).withColumn("place", F.row_number().over(order))
    return numbered.join(where, "range").withColumn("slot", (F.col("before") + F.col("place") - 1).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    rows = records(docs)
    splitters, ranges = split(rows, shards)
    return placed(rows, splitters, ranges).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """All columns and rows of `docs` as Parquet folders shard=0, shard=1, ..., range by range in key order.

    A column named `shard` gives way to the folder's number.
    """
    splitters, ranges = split(records(docs), shards)
    tie = F.xxhash64(F.monotonically_increasing_id())
    row = F.struct(*[docs[c] for c in docs.columns if c != "shard"]).alias("row")
    keyed = docs.select(row, text_key().alias("text_key"), row_key(tie).alias("row_key")).withColumn("range", splitters.column())
    where = docs.sparkSession.createDataFrame([(k, s) for k, (_, _, s) in enumerate(ranges)], "range int, shard int")
    dealt = keyed.join(where, "range").repartition("range").sortWithinPartitions("shard", "range", "text_key", "row_key")
    dealt.select("row.*", "shard").write.partitionBy("shard").parquet(path)


@query("op12_sharding")
def op12_sharding(spark, sf_dir: str) -> DataFrame:
    rows = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
