"""Operator 7: near copies by SimHash, candidates by deletion-variant signatures.

For fingerprints that differ in at most two bits, two segments of 32 bits are enough: one of them
differs in at most one bit. Every segment of a distinct fingerprint is indexed once for each of its
bits with that bit left out; fingerprints with an equal variant meet in an equality join, which
verifies the distance in its condition.

A variant that more than `BUCKET` distinct fingerprints share is not joined: all members of such
buckets also meet by the points at distance 0 or 1 around them. Two fingerprints are at most two
bits apart exactly if these balls share a point, and all members of one point are that close to
each other, so a star to the smallest member keeps every link. That costs 65 rows a fingerprint
at any size of the bucket and forms no pairs.

`drop_near_copies` (the pipeline stage) finds all documents whose sets of five-word shingles have a
Jaccard similarity of at least 0.8. SimHash comes first: sets whose fingerprints are at most two bits
apart are paired by the same deletion variants, and those that reach the similarity form families.
Fingerprints miss some sets that similar, so the rest is found between families: with its shingles in
one order, a set has one among its first fifth in common with every set that similar (prefix
filtering), pairs come from an equality join on those, and the shingles of each are then compared. No
pair inside a family is formed. The order puts shingles that are common in a sample last, which keeps
their buckets small; the sample decides nothing else.

Defined results: null or wordless text has fingerprint zero and is linked like any other, and the
empty set of shingles; exact copies share a fingerprint and a set; a null doc_id is larger than any
other and never names a component that has another id; repeated rows are returned as often as they
come, and stand or fall together in the stage; an empty table gives no rows; the stage passes all
columns through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import pin, scratch_path
from .components import components
from .columns import keeps_columns
from .registry import query, table
from .text import mix

SHINGLE, DISTANCE, SEED = 3, 2, 42
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8
BUCKET = 32
SET_BUCKET, REPRESENTATIVES = 16, 3
SAMPLE, SAMPLE_COUNT = 8192, 4
FILTER_BITS = 1 << 23
SET_ROWS = 512
CROWDED_KEYS = 8
LEAST_SKETCH, LARGEST_SKETCH = 8, 16


def shingles(text: bytes, size: int) -> list[bytes]:
    """Word shingles of lower-cased text; the whole sequence if it is shorter than one."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def majority(digests: bytes, count: int) -> bytes:
    """Bits that are set in over half of `count` digests of equal length."""
    width = len(digests) // count
    ones = np.zeros(width * 8, np.int64)
    for start in range(0, count, 1 << 16):
        part = np.frombuffer(digests, np.uint8)[start * width : (start + (1 << 16)) * width].reshape(-1, width)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count).tobytes()


def simhash64(text: bytes, size: int = SHINGLE) -> bytes:
    """Big-endian fingerprint over all shingles, repeats included, by XXH64."""
    found = shingles(text, size)
    return majority(b"".join([xxhash.xxh64_digest(s, SEED) for s in found]), len(found)) if found else bytes(8)


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, hi): the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            prints = b"".join([simhash64(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in texts])
            values = np.frombuffer(prints, ">i8").astype(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(values)], names=["doc_id", "hi"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, hi long")


def segments(bits: int, count: int) -> list[tuple[int, int]]:
    """First bit and width of each of `count` segments, none across two 64-bit columns."""
    out = []
    for column in range(bits // 64):
        own = count // (bits // 64)
        edges = [64 * k // own for k in range(own + 1)]
        out += [(64 * column + a, b - a) for a, b in zip(edges, edges[1:])]
    return out


def variants(prints: DataFrame, columns: list[str], count: int) -> DataFrame:
    """A row (key, fingerprint) for every bit left out of its segment: `64 * len(columns)` rows each."""
    masks = []
    for first, width in segments(64 * len(columns), count):
        whole = ((1 << width) - 1) << (first % 64)
        masks += [(first // 64, first % 64, whole & ~(1 << (first % 64 + k))) for k in range(width)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    slot = F.col("slot")
    pick = lambda k: F.element_at(F.array(*[F.lit(signed(m[k])) for m in masks]), slot + 1)
    value = F.element_at(F.array(*[F.col(c) for c in columns]), pick(0).cast("int") + 1)
    rows = prints.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("slot"))
    # a variant has at most 32 bits: its number goes above them
    moved = F.call_function("shiftrightunsigned", value.bitwiseAND(pick(2)), pick(1).cast("int"))
    return rows.select(*columns, (F.shiftleft(slot.cast("long"), 33) + moved).alias("key"))


def bits_apart(columns: list[str], left: Column, right: Column) -> Column:
    return sum((F.bit_count(left[c].bitwiseXOR(right[c])) for c in columns), start=F.lit(0))


def crowded(rows: DataFrame) -> DataFrame:
    """Variants that two fingerprints or more share, with their number."""
    return rows.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key"))).filter("n > 1")


def bucket_links(members: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """(left, right) pairs of fingerprints within `limit` bits that share a variant."""
    side = lambda name: members.select("key", F.struct(*columns).alias(name))
    near = (F.col("l") < F.col("r")) & (bits_apart(columns, F.col("l"), F.col("r")) <= limit)
    return side("l").join(side("r").withColumnRenamed("key", "other"), (F.col("key") == F.col("other")) & near).select("l", "r")


def balls(prints: DataFrame) -> DataFrame:
    """(left, right): stars over the points at distance 0 or 1 of 64-bit fingerprints."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)])
    points = prints.select("hi", F.explode(F.transform(flips, lambda x: F.col("hi").bitwiseXOR(x))).alias("point"))
    heads = points.groupBy("point").agg(F.min("hi").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    links = points.join(heads, "point").filter("hi <> least")
    return links.select(F.struct(F.col("least").alias("hi")).alias("l"), F.struct("hi").alias("r"))


def fingerprint_links(prints: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """Links between distinct 64-bit fingerprints (column hi) at most two bits apart; none is lost."""
    if limit not in (1, 2):
        raise ValueError("two segments with one wildcard serve distances of 1 and 2")
    members = pin(crowded(variants(prints, ["hi"], 2)))
    links = bucket_links(members.filter(F.col("n") <= BUCKET), ["hi"], limit)
    hot = members.filter(F.col("n") > BUCKET).select("hi").distinct()
    if limit == 2:
        return links.union(balls(hot)).distinct()
    near = F.explode(F.array(*[F.col("hi").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)]))
    steps = hot.select("hi", near.alias("to")).join(hot.select(F.col("hi").alias("to")), "to").filter("hi < to")
    return links.union(steps.select(F.struct("hi").alias("l"), F.struct(F.col("to").alias("hi")).alias("r"))).distinct()


def simhash_components(docs: DataFrame, size: int = SHINGLE, limit: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    prints = pin(fingerprints(docs, size))
    nodes = prints.groupBy("hi").agg(F.min("doc_id").alias("least"))
    links = fingerprint_links(nodes.select("hi"), limit)
    roots = components(links.select(F.col("l.hi").alias("a"), F.col("r.hi").alias("b")))
    placed = nodes.join(roots, nodes["hi"] == roots["node"], "left").select("hi", "least", F.coalesce("root", "hi").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = placed.join(named, "root").select(F.col("hi").alias("at"), "component_id")
    return prints.join(by_print, prints["hi"] == by_print["at"]).select(
        "doc_id", F.lpad(F.lower(F.hex("hi")), 16, "0").alias("fingerprint"), "component_id"
    )


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; a text shorter than one has a hash of its whole sequence."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), SEED)], np.uint64)
    one, count = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), len(words) - size + 1
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + one[k : k + count])
    return np.unique(total)


def _sets(docs: DataFrame, size: int, emit: Callable, schema: str) -> DataFrame:
    """What `emit` makes of the ids and shingle sets of a few rows."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start in range(0, len(ids), SET_ROWS):
                part = range(start, min(start + SET_ROWS, len(ids)))
                found = [shingle_set(texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b"", size) for k in part]
                yield pa.record_batch(emit(ids.slice(start, SET_ROWS), found), names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def set_id(shingle_hashes: np.ndarray) -> int:
    """Number of a shingle set; texts with equal sets share it."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingle_hashes.tobytes(), SEED)).view(np.int64))


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes that repeat in a sample of fixed size, and how often they do; orders shingles, decides nothing."""
    share = max(1, docs.count() // SAMPLE)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    rows = _sets(sample, size, lambda ids, found: [pa.array(np.concatenate(found).view(np.int64))], "shingle long")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SAMPLE_COUNT).toArrow()
    keys, counts = often["shingle"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def prefix_length(count: int, similarity: float) -> int:
    """Of two sets at least so similar, with their shingles in one order, the first so many of each have one in common."""
    return count - int(np.ceil(similarity * count - 1e-9)) + 1 if count else 0


def sketch(shingle_hashes: np.ndarray) -> np.ndarray:
    """Parities of classes of hashes, two to four for each: two sets differ in at least as many shingles as their sketches in bits."""
    bits = 1 << min(max(int(2 * len(shingle_hashes)).bit_length(), LEAST_SKETCH), LARGEST_SKETCH)
    odd = np.bincount((shingle_hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def set_print(shingle_hashes: np.ndarray) -> int:
    """SimHash fingerprint of a shingle set."""
    bits = majority(shingle_hashes.tobytes(), len(shingle_hashes)) if len(shingle_hashes) else bytes(8)
    return int(np.frombuffer(bits, np.int64)[0])


def prefixes(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(doc_id, id, size, keys, sketch, hi): the first shingles of every text, rare ones before those common in a sample, and its fingerprint."""
    common, counts = common_shingles(docs, size)

    def prefix(found: np.ndarray) -> np.ndarray:
        if len(common) and len(found):
            at = np.minimum(np.searchsorted(common, found), len(common) - 1)
            rank = np.where(common[at] == found, counts[at], 0)
            found = found[np.argsort(rank, kind="stable")]
        return found[: prefix_length(len(found), similarity)].view(np.int64)

    def emit(ids: pa.Array, found: list[np.ndarray]) -> list[pa.Array]:
        keys = [prefix(f) for f in found]
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
        sketches = pa.array([sketch(f) for f in found], pa.list_(pa.int64()))
        numbers = [pa.array([of(f) for f in found], kind) for of, kind in ((set_id, pa.int64()), (len, pa.int32()), (set_print, pa.int64()))]
        return [ids, *numbers[:2], lists, sketches, numbers[2]]

    return _sets(docs, size, emit, "doc_id long, id long, size int, keys array<long>, sketch array<long>, hi long")


def may_be_alike(left: Column, right: Column, similarity: float) -> Column:
    """Whether two sets whose first common shingle has these places can reach the similarity."""
    least = F.lit(similarity / (1 + similarity)) * (left["size"] + right["size"]) - 1e-6
    return F.least(left["size"] - left["place"], right["size"] - right["place"]) >= least


def set_pairs(left: DataFrame, right: DataFrame, similarity: float, more: Column | None = None) -> DataFrame:
    """(a, b) distinct pairs of ids of no common family that share a key and can be alike; left has (key, l), right (key, r)."""
    kin = F.coalesce(F.col("l.family") == F.col("r.family"), F.lit(False))
    fits = (F.col("l.id") != F.col("r.id")) & ~kin & may_be_alike(F.col("l"), F.col("r"), similarity)
    met = left.join(right.withColumnRenamed("key", "other"), (F.col("key") == F.col("other")) & fits & (F.lit(True) if more is None else more))
    return met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) pairs of ids that link all sets with fingerprints (column hi) at most two bits apart, over one set for each fingerprint."""
    heads = nodes.groupBy("hi").agg(F.min("id").alias("head"))
    side = lambda hi, name: heads.select(F.col("hi").alias(hi), F.col("head").alias(name))
    near = fingerprint_links(heads.select("hi")).select(F.col("l.hi").alias("x"), F.col("r.hi").alias("y"))
    across = near.join(side("x", "a"), "x").join(side("y", "b"), "y").select("a", "b")
    within = nodes.join(heads, "hi").filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    both = across.union(within)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def discard(stored: DataFrame) -> None:
    """Delete the files of a table that nothing will read again."""
    spark = stored.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in stored.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bit_filter(ids: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Whether numbers can be among those of a column: bits of fixed size, wrong only by letting others through."""
    at = ids.select(ids[ids.columns[0]].bitwiseAND(F.lit(FILTER_BITS - 1)).cast("int").alias("at")).distinct().toArrow()["at"].to_numpy()
    marks = np.zeros(FILTER_BITS, bool)
    marks[at] = True
    bits = np.packbits(marks)

    def among(numbers: np.ndarray) -> np.ndarray:
        place = numbers & (FILTER_BITS - 1)
        return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)

    return among


def sketched(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches do not rule the similarity out; whole sets move for these only."""
    nodes = rows.groupBy("id").agg(F.first("sketch").alias("sketch"), F.first("size").alias("size"))
    side = lambda name: nodes.select(F.col("id").alias(f"id_{name}"), F.struct("sketch", "size").alias(f"node_{name}"))
    both = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    short = F.least(F.size("node_a.sketch"), F.size("node_b.sketch"))

    def folded(bits: Column) -> Column:
        # classes are remainders by powers of two, so the halves of a longer sketch make the shorter one
        half = F.zip_with(F.slice(bits, 1, short), F.slice(bits, short + 1, short), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(bits) == short, bits).when(F.size(bits) == 2 * short, half)

    differ = F.zip_with(folded(F.col("node_a.sketch")), folded(F.col("node_b.sketch")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.coalesce(F.aggregate(differ, F.lit(0), lambda n, x: n + x), F.lit(0))
    most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("node_a.size") + F.col("node_b.size")) + 1e-6
    return both.filter(apart <= most).select("a", "b")


def wanted_sets(docs: DataFrame, rows: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of the sets that pairs name, from the first document of each and, now and then, another."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    may_want = bit_filter(wanted)
    may_hold = bit_filter(rows.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").select("doc_id"))

    def lists(ids: pa.Array, found: list[np.ndarray]) -> list[pa.Array]:
        holds = ids.is_null().to_numpy(zero_copy_only=False) | may_hold(ids.fill_null(0).to_numpy(zero_copy_only=False))
        own = {set_id(f): f for f, held in zip(found, holds.tolist()) if held}
        ids = np.fromiter(own, np.int64, len(own))
        ids = ids[may_want(ids)]
        chosen = [own[i] for i in ids.tolist()]
        ends = np.cumsum([0, *map(len, chosen)]).astype(np.int32)
        hashes = np.concatenate([np.zeros(0, np.uint64), *chosen]).view(np.int64)
        return [pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes))]

    return _sets(docs, size, lists, "id long, shingles array<long>")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets reach the Jaccard similarity, counted exactly."""
    sets = sets.groupBy("id").agg(F.first("shingles").alias("shingles"))
    side = lambda name: sets.select(F.col("id").alias(f"id_{name}"), F.col("shingles").alias(f"set_{name}"))
    both = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(shared / (F.size("set_a") + F.size("set_b") - shared) >= similarity).select("a", "b")


def near_copy_roots(docs: DataFrame, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, id) of every row, and (node, root): the components of sets at least so similar. No link is lost.

    Families are the components of the SimHash links that hold. Members of a key's bucket up to SET_BUCKET are
    paired across families. In larger ones each member is paired with REPRESENTATIVES first, under its most crowded
    keys; pairs inside a component found by then are not needed, and all others of the bucket are formed.
    Stored tables are deleted when what follows from them is stored.
    """
    spark = docs.sparkSession

    def stored(df: DataFrame, label: str) -> DataFrame:
        df.write.parquet(path := scratch_path(spark, label))
        return spark.read.parquet(path)

    first = stored(prefixes(docs, size, similarity), "prefixes")
    rows = stored(first.drop("keys", "hi"), "rows")
    candidates = simhash_pairs(first.groupBy("id").agg(F.first("hi").alias("hi")))
    candidates = stored(sketched(candidates, rows, similarity), "candidates")
    held = stored(alike(candidates, wanted_sets(docs, rows, candidates, size), similarity), "held")
    families = components(held).select("node", F.col("root").alias("family"))
    nodes = first.groupBy("id").agg(F.first("keys").alias("keys"), F.first("size").alias("size"))
    nodes = nodes.join(families, nodes["id"] == families["node"], "left")
    placed = nodes.select("id", "size", "family", F.posexplode("keys").alias("place", "key"))
    narrow = placed.select("key", "id", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("place")).alias("at"), "family")
    place = F.struct(
        "id", F.shiftright("at", 32).cast("int").alias("size"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place"), "family"
    )
    members = stored(crowded(narrow).select("key", place.alias("m"), "n"), "members")
    discard(first)
    side = lambda df, name: df.select("key", F.col("m").alias(name))
    few, many = members.filter(F.col("n") <= SET_BUCKET), members.filter(F.col("n") > SET_BUCKET)
    small = set_pairs(side(few, "l"), side(few, "r"), similarity, F.col("l.id") < F.col("r.id"))
    picks = many.groupBy("key").agg(*[F.min_by("m", F.xxhash64(F.lit(k), "m.id")).alias(f"p{k}") for k in range(REPRESENTATIVES)])
    picks = picks.select("key", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(REPRESENTATIVES)]))).alias("l"))
    # copies meet the same representatives under most of their keys, so the most crowded ones are enough here
    turn = F.row_number().over(W.partitionBy("m.id").orderBy(F.desc("n"), "key"))
    most = many.withColumn("turn", turn).filter(F.col("turn") <= CROWDED_KEYS)
    pairs = stored(small.union(set_pairs(picks, side(most, "r"), similarity)).distinct(), "pairs")
    close = stored(sketched(pairs, rows, similarity), "close")
    links = stored(held.union(alike(close, wanted_sets(docs, rows, close, size), similarity)), "links")
    roots = components(links)
    if many.isEmpty():
        discard(members)
        return rows, roots
    named = many.join(roots, F.col("m.id") == F.col("node"), "left").select("key", "m", F.coalesce("root", "m.id").alias("c"))
    named = stored(named, "named")
    discard(members)
    groups = named.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count(F.lit(1)).alias("groups"))
    open_ = named.join(groups.filter("groups > 1"), "key")
    apart = open_.filter("c <> main").select("key", F.struct("m.*", "c").alias("l"))
    rest = set_pairs(apart, open_.select("key", F.struct("m.*", "c").alias("r")), similarity, F.col("l.c") != F.col("r.c"))
    rest = stored(sketched(rest.join(pairs, ["a", "b"], "left_anti"), rows, similarity), "rest")
    discard(named)
    if rest.isEmpty():
        return rows, roots
    return rows, components(links.union(stored(alike(rest, wanted_sets(docs, rows, rest, size), similarity), "links")))


@keeps_columns
def drop_near_copies(docs: DataFrame, size: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """The document with the smallest doc_id of every group of near copies, all columns."""
    rows, roots = near_copy_roots(docs, size, similarity)
    nodes = rows.groupBy("id").agg(F.min("doc_id").alias("least"))
    placed = nodes.join(roots, nodes["id"] == roots["node"], "left").withColumn("group", F.coalesce("root", "id"))
    keepers = placed.groupBy("group").agg(F.min("least").alias("__keeper"))
    ids = rows.select("doc_id").distinct()
    dropped = bit_filter(ids.join(keepers, F.col("doc_id") == F.col("__keeper"), "left_anti").filter("doc_id IS NOT NULL"))

    @F.arrow_udf("boolean")
    def in_doubt(ids: pa.Array) -> pa.Array:
        return pc.or_kleene(ids.is_null(), pa.array(dropped(ids.fill_null(0).to_numpy(zero_copy_only=False))))

    # most rows stay, and what cannot be dropped is not moved
    doubt = in_doubt(F.col("doc_id").cast("long"))
    settled = docs.filter(doubt).join(keepers, F.col("doc_id").eqNullSafe(F.col("__keeper")), "left_semi")
    return docs.filter(~doubt).union(settled)


@query("op7_simhash")
def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
