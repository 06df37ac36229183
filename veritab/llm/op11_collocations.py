"""Operator 11: phrases whose words keep together, found by Misra-Gries summaries and counted exactly.

Three passes over the texts, all counts per language:

1. Words are counted exactly. A phrase can reach the threshold only if each of its words does, so
   phrases with a rarer word are left out from here on.
2. The hashes of all other phrases of 2 to 5 words go, counted per task, to the partition their hash
   names, as sorted runs of 32 bits within the partition. There a Misra-Gries summary takes them in: beyond its capacity, which is above the
   partition's mass divided by the threshold, all counters are lowered by the same amount. The sum
   of what was taken off, the summary's error, stays below the threshold (the capacity grows before
   it could pass it), so every phrase that reaches the threshold survives with a counter that
   misses at most the error. Counters that cannot reach the threshold even so are dropped.
3. Phrases that survive are counted exactly, by their text.

What tasks get of the words of pass 1 and the survivors of pass 2 is a bit filter of a size that
grows with the words up to FILTER_BITS bits: it lets some others through, which the exact counts
remove, and holds none back. Hashes that collide in pass 2 only add to a counter, which loses nothing.

Scores are exact: products are decimals of 38 digits, divided as integers.

Defined results: null text has no words; null lang is `und`; empty texts, rows that repeat and null
ids need no care, as only texts and languages are read; ties are ordered by phrase, so ranks are
the same in every run; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritab.session import scratch_path

from .packed import squeeze, widen
from .registry import query, table
from .text import LOWER, UPPER, Rolling, Words, lower, mix, raw, slices

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
COVERED = 100
UNKNOWN = "und"

FILTER_BITS = 1 << 27
BUFFER = 1 << 22
MASS = 1 << 24
EVEN_PARTITIONS = 4096
TALLY = 1 << 18

STOPS = ".,;:!?\n\x0b\x0c\r"
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in STOPS]] = True
_BREAK = _STOP.copy()
_BREAK[[32, 9]] = True


class Bits:
    """A set of 64-bit keys as bits of a bounded array; may hold others too."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(64 * len(words) - 1)

    @classmethod
    def of(cls, keys: DataFrame, size: int) -> Bits:
        """The column `key`; what reaches the driver is at most the array."""
        place = f"(key & {size - 1}L)"
        bits = keys.selectExpr(f"cast({place} >> 6 as int) AS word", f"shiftleft(1L, cast({place} & 63 as int)) AS bit")
        found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(size // 64, np.uint64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return cls(words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys & self.mask
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


class Phrases:
    """Words of a slice of texts and the phrases within their pieces."""

    def __init__(self, part: pa.Table):
        data, offsets = raw(part.column("text"))
        self.data = lower(data)
        self.words = Words(self.data, offsets, _BREAK)
        langs = part.column("lang").combine_chunks().dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy()[self.words.row]
        self.seeds = np.array([xxhash.xxh3_64_intdigest(name) for name in self.langs], np.uint64)
        self.piece = np.cumsum(_STOP[self.data])[self.words.start] + self.words.row
        self.rolling = Rolling(self.words.hashes())

    def of(self, size: int, rare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First word and key of every phrase of `size` words, none of them among the rare ones."""
        at = np.arange(max(0, len(self.words) - size + 1))
        good = self.piece[at] == self.piece[at + size - 1]
        if rare is not None:
            before = np.concatenate([[0], np.cumsum(rare)])
            good &= before[at] == before[at + size]
        at = at[good]
        return at, mix(self.rolling.of(at, at + size) ^ self.seeds[self.lang[at]])

    def rare(self, common: Bits) -> np.ndarray:
        return ~common.has(self.of(1)[1])

    def text(self, at: int, size: int) -> str:
        return b" ".join(self.data[self.words.start[at] : self.words.end[at + size - 1]].tobytes().split()).decode()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Phrases]:
    for batch in batches:
        for part in slices(pa.Table.from_batches([batch])):
            phrases = Phrases(part)
            if len(phrases.words):
                yield phrases


def tallied(docs: DataFrame, sizes: tuple[int, ...], common: Bits | None = None, wanted: Bits | None = None, partitions: int = 1) -> DataFrame:
    """(lang, phrase, size, key, n): phrases that the filters let through, counted over parts of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named: dict[int, tuple[str, str, int]] = {}
        counts: dict[int, int] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*named[key], key, n) for key, n in counts.items()]
            lang, phrase, size, key, n = zip(*rows) if rows else [()] * 5
            keys = np.array(key, np.uint64).view(np.int64)
            columns = [pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(size, pa.int32()), pa.array(keys), pa.array(n, pa.int64())]
            named.clear(), counts.clear()
            return pa.record_batch(columns, names=["lang", "phrase", "size", "key", "n"])

        for phrases in _parts(batches):
            rare = phrases.rare(common) if common is not None else None
            for size in sizes:
                at, keys = phrases.of(size, rare)
                if wanted is not None:
                    let = wanted.has(mix(in_partition(keys, partitions)))
                    at, keys = at[let], keys[let]
                found, first, n = np.unique(keys, return_index=True, return_counts=True)
                for key, place, times in zip(found.tolist(), at[first].tolist(), n.tolist()):
                    if key not in named:
                        named[key] = (phrases.langs[phrases.lang[place]], phrases.text(place, size), size)
                    counts[key] = counts.get(key, 0) + times
            if len(counts) > TALLY:
                yield flush()
        yield flush()

    return docs.mapInArrow(run, "lang string, phrase string, size int, key long, n long")


class Summary:
    """Misra-Gries counters that may be added to and merged; `error` is what any count may miss, below the threshold."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.error = max(capacity, 1), threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held, self.waiting = [], 0

    def take(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add in the end; runs wait until they are worth a sort."""
        self.held.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(self.capacity, BUFFER // 16):
            self.settle()

    def settle(self) -> None:
        if self.held:
            self.add(np.concatenate([k for k, _ in self.held]), np.concatenate([n for _, n in self.held]))
            self.held, self.waiting = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
        self.keys, self.counts = keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts
        over = len(self.keys) - self.capacity
        if over <= 0:
            return
        # the largest counter that must go is taken off all, as far as the error allows
        cut = min(int(np.partition(self.counts, over - 1)[over - 1]), self.threshold - 1 - self.error)
        if cut > 0:
            self.error += cut
            self.counts = self.counts - cut
            left = self.counts > 0
            self.keys, self.counts = self.keys[left], self.counts[left]
        self.capacity = max(self.capacity, 2 * len(self.keys) if len(self.keys) > self.capacity else 0)

    def merge(self, other: Summary) -> None:
        """Take in another summary; the errors must together stay below the threshold."""
        if self.error + other.error >= self.threshold:
            raise ValueError("summaries that missed too much to be merged")
        self.error += other.error
        self.add(other.keys, other.counts)

    def survivors(self) -> np.ndarray:
        """Keys that may have reached the threshold."""
        return self.keys[self.counts + self.error >= self.threshold]


def survivors(docs: DataFrame, common: Bits, words: int, partitions: int, min_count: int, longest: int) -> DataFrame:
    """(key): mixed partition hashes of a superset of the phrases that occur `min_count` times."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            edges = np.searchsorted(keys, np.arange(partitions + 1, dtype=np.uint64) << np.uint64(32))
            rows = []
            for part in np.flatnonzero(np.diff(edges)).tolist():
                lo, hi = edges[part], edges[part + 1]
                low = keys[lo:hi].astype(np.uint32)
                rows.append((part, int(hi - lo), squeeze(np.diff(low, prepend=np.uint32(0))), squeeze(n[lo:hi].astype(np.uint32))))
            part, size, low, counts = zip(*rows) if rows else [()] * 4
            columns = [pa.array(part, pa.int32()), pa.array(size, pa.int32()), pa.array(low, pa.binary()), pa.array(counts, pa.binary())]
            return pa.record_batch(columns, names=["part", "size", "keys", "counts"])

        for phrases in _parts(batches):
            rare = phrases.rare(common)
            for size in range(2, longest + 1):
                held.append(in_partition(phrases.of(size, rare)[1], partitions))
                total += len(held[-1])
            if total > BUFFER:
                yield flush()
                total = 0
        yield flush()

    capacity = -(-2 * words * (longest - 1) // (partitions * min_count))

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries: dict[int, Summary] = {}
        for batch in batches:
            for row in batch.to_pylist():
                low = np.cumsum(widen(row["keys"], row["size"], np.uint32), dtype=np.uint32).astype(np.uint64)
                summary = summaries.setdefault(row["part"], Summary(capacity, min_count))
                summary.take(low, widen(row["counts"], row["size"], np.uint32).astype(np.int64))
        for part, summary in summaries.items():
            summary.settle()
            keys = mix(np.uint64(part << 32) | summary.survivors())
            yield pa.record_batch([pa.array(keys.view(np.int64))], names=["key"])

    runs = docs.mapInArrow(hashed, "part int, size int, keys binary, counts binary")
    return runs.repartition(partitions, "part").mapInArrow(summarised, "key long")


def partition_count(mass: int) -> int:
    """Hash partitions for so many occurrences: in proportion at first, then by the square root, so that runs do not get short."""
    even = max(12, -(-mass // MASS))
    return even if even <= EVEN_PARTITIONS else int((even * EVEN_PARTITIONS) ** 0.5)


def in_partition(keys: np.ndarray, partitions: int) -> np.ndarray:
    """The hash partition of each key in the upper 32 bits, what is left of the key in the lower."""
    upper = (keys >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)
    return upper << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)


def filter_size(entries: int) -> int:
    """Bits of a filter: eight for each entry there can be, a power of two within fixed bounds."""
    return min(max(1 << 16, 1 << int(8 * entries).bit_length()), FILTER_BITS)


def counted_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all words and phrases that occur `min_count` times, and (lang, total) of all words."""
    spark = docs.sparkSession
    texts = docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))

    def stored(df: DataFrame, label: str) -> DataFrame:
        df.write.parquet(path := scratch_path(spark, label))
        return spark.read.parquet(path)

    words = stored(tallied(texts, (1,)).groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("key").alias("key"), F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    total = words.agg(F.sum("n")).first()[0] or 0
    often = words.filter(F.col("n") >= min_count)
    common = Bits.of(often, filter_size(total // min_count))
    partitions = partition_count(total * (longest - 1))
    found = survivors(texts, common, total, partitions, min_count, longest)
    wanted = Bits.of(found, filter_size(total * (longest - 1) // min_count))
    exact = tallied(texts, tuple(range(2, longest + 1)), common, wanted, partitions).groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.sum("n").alias("n"))
    phrases = often.select("lang", "phrase", "size", "n").union(exact.filter(F.col("n") >= min_count).select("lang", "phrase", "size", "n"))
    return stored(phrases, "phrases"), totals


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int | None = TOP, covered: int = COVERED
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of phrases that no longer one covers, best first.

    A phrase is covered by a longer one that occurs in `covered` percent of its places. The longer one need
    only be looked for among those with one word more: a phrase between the two is at least as frequent.
    """
    phrases, totals = counted_phrases(docs, min_count, longest)
    many = phrases.filter("size > 1").withColumn("words", F.split("phrase", " "))
    joined = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = many.select("lang", "phrase", F.col("n").alias("a"), "words", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals.withColumnRenamed("total", "n"), "lang")
    scored = cuts.select(
        "lang", "phrase", "a", "n",
        F.struct(F.expr("(cast(a as decimal(19,0)) * 1000 * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").alias("score"), "k", "l", "r").alias("cut"),
    )
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min("cut").alias("cut"))
    longer = many.filter("size > 2").select("lang", "n", F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))).alias("phrase"))
    cover = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    free = best.join(cover, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    rows = free.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    # a limit on the number itself lets Spark keep the first rows of each task before the shuffle
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query(
    "op11_collocations",
    rf"""
    WITH pieces AS (
        SELECT row_number() OVER () AS piece, lang, w FROM (
            SELECT coalesce(lang, '{UNKNOWN}') AS lang,
                   unnest(list_transform(
                       regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]'),
                       lambda p: list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> ''))) AS w
            FROM documents) WHERE len(w) > 0
    ), totals AS (
        SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
    ), counted AS (
        SELECT lang, phrase, size, count(*) AS f FROM (
            SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
            FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), (SELECT unnest(range(1, {LONGEST} + 1)) AS size)
            WHERE i + size - 1 <= len(w)
        ) GROUP BY lang, phrase, size HAVING count(*) >= {MIN_COUNT}
    ), cuts AS (
        SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM counted WHERE size > 1
    ), scored AS (
        SELECT c.lang, c.phrase, c.size, c.f AS a, c.k, l.f AS l, r.f AS r, t.n,
               (1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS score
        FROM cuts c JOIN totals t ON t.lang = c.lang
        JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ')
        JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 :], ' ')
    ), best AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), free AS (
        SELECT * FROM best b WHERE NOT EXISTS (
            SELECT 1 FROM counted o WHERE o.lang = b.lang AND o.size > b.size
            AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * o.f >= {COVERED} * b.a)
    )
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM free
    ) WHERE rank <= {TOP}
    """,
)
def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
