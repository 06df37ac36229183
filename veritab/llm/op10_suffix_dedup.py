"""Operator 10: repeated byte strings, by a logarithmic family of suffix arrays.

Only anchored suffixes are kept: those at places where a hash of the next 16 bytes falls under a
threshold, about one in 64. A string of `size` bytes belongs to the first anchor in it, so equal
strings belong to anchors at the same distance from their start. For an anchor, `whole` is the
digest of all text that its strings cover, and `tail` the digest of the text behind the anchor that
all its strings of one distance class have in common. A chunk of documents is a batch: its suffix
array is its list of (tail, whole), sorted; digest order puts equal tails side by side, as text
order would. Strings without a near anchor (low-entropy text) are their own entries.

Within a bucket of the digest range arrays of batches come one by one into a family of levels:
equal-sized levels merge, so that an entry is merged a logarithmic number of times. The merged
family shows how often each `whole` and each `tail` occurs. A string under a repeated `whole` is
repeated. Under a repeated `tail` that also has a `whole` seen once, strings are compared one by
one in a second round; that concerns the ends of repeats only. What neither shows is unique.

Texts move once, entries cost 6 to 14 bytes per anchor, and each batch sends an entry once, however
often its documents repeat it.

Defined results: null text is empty; matches never cross rows, rows that repeat a doc_id are rows of
their own and match each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .registry import query, table
from .text import Rolling, cover, mix, raw, runs

SIZE = 400
GRAM = 16
RARITY = 64
CLASSES = (0, 75, 150, 225, 300)
CHUNK_BYTES = 2 << 20
_BYTE_BASE = 0xC2B2AE3D27D4EB4F

RESULT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _tag(hashes: np.ndarray, kind: int) -> np.ndarray:
    return mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * kind % 2**64))


class _Batch:
    """Anchored suffixes of a chunk, and the strings that belong to each."""

    def __init__(self, texts: pa.Table, size: int):
        self.size = size
        self.data, self.offsets = raw(texts.column("text"))
        self.rolling = Rolling(self.data.astype(np.uint64) + np.uint64(1), _BYTE_BASE)
        places = np.arange(max(0, len(self.data) - GRAM + 1))
        found = places[self.rolling.of(places, places + GRAM) < np.uint64(2**64 // RARITY)]
        row = np.searchsorted(self.offsets, found, "right") - 1
        inside = found + GRAM <= self.offsets[row + 1]
        self.anchor, row = found[inside], row[inside]
        before = np.concatenate([[-1], self.anchor[:-1]])
        reach = CLASSES[-1]
        self.lo = np.maximum.reduce([np.where(before >= self.offsets[row], before + 1, self.offsets[row]), self.anchor - reach + 1])
        self.hi = np.minimum(self.anchor, self.offsets[row + 1] - size)
        used = self.lo <= self.hi
        self.anchor, self.lo, self.hi = self.anchor[used], self.lo[used], self.hi[used]
        self._entries()

    def _entries(self) -> None:
        size, rolling = self.size, self.rolling
        whole = _tag(rolling.of(self.lo, self.hi + size), 1)
        owner, near, tails = [], [], []
        for first, end in zip(CLASSES, CLASSES[1:]):
            held = np.flatnonzero((self.anchor - self.lo >= first) & (self.anchor - self.hi < end))
            at = self.anchor[held]
            owner.append(held)
            near.append(np.full(len(held), first))
            tails.append(_tag(rolling.of(at, at + size - end + 1), 2 + first))
        alone = self._unanchored()
        lone = _tag(rolling.of(alone, alone + size), 3)
        self.owner, self.first, self.alone = np.concatenate(owner), np.concatenate(near), alone
        tail = np.concatenate([*tails, lone])
        value = np.concatenate([whole[self.owner], lone])
        order = np.lexsort((value, tail))
        new = np.ones(len(order), bool)
        new[1:] = (tail[order][1:] != tail[order][:-1]) | (value[order][1:] != value[order][:-1])
        group = np.cumsum(new) - 1
        self.place = np.empty(len(order), np.int64)
        self.place[order] = group
        self.tails, self.wholes = tail[order][new], value[order][new]
        self.many = (np.bincount(group, minlength=len(self.tails)) > 1).astype(np.int64)

    def _unanchored(self) -> np.ndarray:
        """Starts of strings that belong to no anchor."""
        change = np.zeros(len(self.data) + 1, np.int32)
        starts, ends = self.offsets[:-1], self.offsets[1:] - self.size + 1
        long = ends > starts
        np.add.at(change, starts[long], 1)
        np.add.at(change, ends[long], -1)
        np.add.at(change, self.lo, -1)
        np.add.at(change, self.hi + 1, 1)
        return np.flatnonzero(np.cumsum(change[:-1], dtype=np.int32) > 0)

    def second(self, replies: pa.Table, buckets: int) -> None:
        """Strings to be compared one by one, and those already known to be repeated."""
        verdict = packed.read_replies(replies, 1, self.tails, buckets, 0)[self.place]
        anchored = len(self.owner)
        repeated, contested = (verdict & 1) > 0, (verdict & 2) > 0
        sure = np.unique(self.owner[repeated[:anchored]])
        self.known = np.concatenate([_ranges(self.lo[sure], self.hi[sure]), self.alone[repeated[anchored:]]])
        open_ = np.flatnonzero(contested[:anchored])
        owner, first = self.owner[open_], self.first[open_]
        step = np.array(CLASSES[1:])[np.searchsorted(CLASSES, first)]
        lo = np.maximum(self.lo[owner], self.anchor[owner] - step + 1)
        hi = np.minimum(self.hi[owner], self.anchor[owner] - first)
        self.starts = _ranges(lo, hi)
        keys = _tag(self.rolling.of(self.starts, self.starts + self.size), 4)
        self.keys, self.key_place, counts = np.unique(keys, return_inverse=True, return_counts=True)
        self.key_many = (counts > 1).astype(np.int64)

    def removed(self, replies: pa.Table, buckets: int) -> np.ndarray:
        again = packed.read_replies(replies, 2, self.keys, buckets, False)[self.key_place]
        return cover(np.concatenate([self.known, self.starts[again]]), self.size, len(self.data))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges [lo, hi]."""
    counts = np.maximum(hi - lo + 1, 0)
    jumps = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(lo) else lo, counts)
    return jumps + np.arange(len(jumps))


class Family:
    """Levels of merged suffix arrays; two levels of about equal size merge into the next."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _merge(a, b):
        tail, whole, count = (np.concatenate([x, y]) for x, y in zip(a, b))
        order = np.lexsort((whole, tail))
        tail, whole, count = tail[order], whole[order], count[order]
        new = np.ones(len(tail), bool)
        new[1:] = (tail[1:] != tail[:-1]) | (whole[1:] != whole[:-1])
        heads = np.flatnonzero(new)
        return tail[heads], whole[heads], np.add.reduceat(count, heads) if len(heads) else count

    def add(self, tail: np.ndarray, whole: np.ndarray, count: np.ndarray) -> None:
        level = (tail, whole, count)
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            level = self._merge(self.levels.pop(), level)
        self.levels.append(level)

    def collapsed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = self.levels[-1]
        for level in reversed(self.levels[:-1]):
            out = self._merge(level, out)
        return out


def _scan(sent):
    """For every entry: 1 if its whole is repeated, plus 2 if its tail is, and some whole there is not."""
    family = Family()
    for tail, whole, many in sent:
        family.add(tail, whole.view(np.uint64), many + 1)
    tail, whole, count = family.collapsed()
    heads = np.flatnonzero(np.concatenate([[True], tail[1:] != tail[:-1]]))
    sizes = np.diff(np.append(heads, len(tail)))
    total = np.repeat(np.add.reduceat(count, heads), sizes)
    single = np.repeat(np.minimum.reduceat(count, heads), sizes) == 1
    verdict = ((count > 1) + 2 * (single & (total > 1))).astype(np.uint8)
    pairs = mix(tail) + whole
    order = np.argsort(pairs)
    return [verdict[order[np.searchsorted(pairs, mix(t) + w.view(np.uint64), sorter=order)]] for t, w, _ in sent]


def _again(sent):
    keys, place, ends = packed.pool(sent)
    total = np.bincount(place, weights=np.concatenate([s[1] for s in sent]) + 1, minlength=len(keys))
    return packed.per_sender(total >= 2, place, ends)


def _result(texts: pa.Table, batch: _Batch, removed: np.ndarray) -> pa.Table:
    out = []
    for doc_id, lo, hi in zip(texts.column("doc_id").to_pylist(), batch.offsets, batch.offsets[1:]):
        mask = removed[lo:hi]
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(*runs(mask))] if mask.any() else []
        out.append((doc_id, int(hi - lo), spans, batch.data[lo:hi][~mask].tobytes()))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), spans, pa.binary()]
    columns = zip(*out) if out else [[]] * 4
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeated_bytes(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Every document without bytes that lie in a string of `size` bytes which also starts elsewhere.

    Returns doc_id, n_bytes, spans (maximal removed runs, end exclusive) and kept (the other bytes).
    """
    if size < CLASSES[-1] + GRAM:
        raise ValueError(f"size must be at least {CLASSES[-1] + GRAM}: an anchor lies in every string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, buckets = packed.chunked(docs, CHUNK_BYTES)
    parts = texts.groupBy("chunk")

    def ask_suffixes(key, table):
        batch = _Batch(table, size)
        return packed.ask_rows(key[0].as_py(), 1, buckets, batch.tails, [batch.wholes, batch.many])

    def ask_strings(key, table, replies):
        batch = _Batch(table, size)
        batch.second(replies, buckets)
        return packed.ask_rows(key[0].as_py(), 2, buckets, batch.keys, [batch.key_many])

    def finish(key, table, replies):
        batch = _Batch(table, size)
        batch.second(replies, buckets)
        return _result(table, batch, batch.removed(replies, buckets))

    suffixes = packed.answers(parts.applyInArrow(ask_suffixes, packed.ASKS), _scan)
    asked = parts.cogroup(suffixes.groupBy("chunk")).applyInArrow(ask_strings, packed.ASKS)
    strings = packed.answers(asked, _again)
    return parts.cogroup(suffixes.unionByName(strings).groupBy("chunk")).applyInArrow(finish, RESULT)


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return kept.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
