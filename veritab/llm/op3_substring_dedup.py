"""Operator 3: repeated word passages, found by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of `block` words, counted from its start.
All of its rolling windows of `block` words probe the index of blocks. A repeat of at least
`window` = 2 * block - 1 words holds a whole reference block of each text it stands in, so only
places around blocks that have a second occurrence are extended: the windows of `window` words
over such a block are compared whole, and adjoining ones merge into maximal exact repeats.

Both comparisons go through `packed`: first block keys (40 bits, only a filter), then 64-bit keys
of the candidate windows with the smallest doc_id of each chunk. No pairs of documents are formed:
a window is removed if the corpus holds it under a smaller doc_id, however many copies there are.

Defined results: null text has no words; a null doc_id counts as larger than any other; rows that
share a doc_id do not remove each other's words; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .registry import query, table
from .text import WordHashes, cover, runs

WINDOW = 13
LAST_ID = np.iinfo(np.int64).max
_FILTER = np.uint64(2**64 - 2**24)

RESULT = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept_text string"


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(LAST_ID).to_numpy(zero_copy_only=False)


class _Chunk:
    """What a chunk asks in either round, derived from its texts alone."""

    def __init__(self, table: pa.Table, window: int):
        self.block, self.window = (window + 1) // 2, window
        self.words, self.ids = WordHashes(table), _ids(table)
        self.at, hashes = self.words.windows(self.block)
        self.keys, self.place, self.counts = np.unique(hashes & _FILTER, return_inverse=True, return_counts=True)

    def candidates(self, replies: pa.Table, buckets: int) -> None:
        """Windows over a reference block that has a second occurrence: distinct keys and their smallest ids."""
        again = packed.read_replies(replies, 1, self.keys, buckets, False)
        flag = np.zeros(len(self.words.hashes) + self.window, bool)
        flag[self.at] = again[self.place]
        at, hashes = self.words.windows(self.window)
        start = self.words.bounds[self.words.row[at]]
        anchor = start + -(-(at - start) // self.block) * self.block
        chosen = flag[anchor]
        self.wide_at = at[chosen]
        self.wide_keys, self.wide_place = packed.distinct(hashes[chosen])
        self.wide_ids = self.ids[self.words.row[self.wide_at]]
        self.least = np.full(len(self.wide_keys), LAST_ID)
        np.minimum.at(self.least, self.wide_place, self.wide_ids)

    def removed(self, replies: pa.Table, buckets: int) -> np.ndarray:
        earlier = packed.read_replies(replies, 2, self.wide_keys, buckets, False)
        hit = earlier[self.wide_place] | (self.least[self.wide_place] < self.wide_ids)
        return cover(self.wide_at[hit], self.window, len(self.words.hashes))


def _again(sent):
    """Which block keys occur at least twice in the corpus."""
    keys, place, ends = packed.pool(sent)
    total = np.bincount(place, weights=np.concatenate([s[1] for s in sent]) + 1, minlength=len(keys))
    return packed.per_sender(total >= 2, place, ends)


def _earlier(sent):
    """For which window keys another chunk holds a smaller doc_id."""
    keys, place, ends = packed.pool(sent)
    ids = np.concatenate([s[1] for s in sent])
    least = np.full(len(keys), LAST_ID)
    np.minimum.at(least, place, ids)
    return np.split(least[place] < ids, ends[:-1])


def _result(texts: pa.Table, chunk: _Chunk, removed: np.ndarray) -> pa.Table:
    out = []
    for i, (doc_id, text) in enumerate(zip(texts.column("doc_id").to_pylist(), texts.column("text"))):
        mask = removed[chunk.words.bounds[i] : chunk.words.bounds[i + 1]]
        words = text.as_buffer().to_pybytes().split() if text.is_valid else []
        spans = []
        if mask.any():
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(*runs(mask))]
            words = compress(words, (~mask).tolist())
        out.append((doc_id, len(mask), spans, b" ".join(words).decode()))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), spans, pa.string()]
    columns = zip(*out) if out else [[]] * 4
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "n_words", "spans", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document without words that a document of a smaller id already has in a passage of `window` words.

    Returns doc_id, n_words, spans (removed runs of words, end exclusive) and kept_text (the other
    words, joined by one space). `window` must be odd.
    """
    if window % 2 == 0:
        raise ValueError("window must be odd: a block is half of it, rounded up")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, buckets = packed.chunked(docs)
    parts = texts.groupBy("chunk")

    def ask_blocks(key, table):
        chunk = _Chunk(table, window)
        return packed.ask_rows(key[0].as_py(), 1, buckets, chunk.keys, [(chunk.counts > 1).astype(np.int64)])

    def ask_windows(key, table, replies):
        chunk = _Chunk(table, window)
        chunk.candidates(replies, buckets)
        return packed.ask_rows(key[0].as_py(), 2, buckets, chunk.wide_keys, [chunk.least])

    def finish(key, table, replies):
        chunk = _Chunk(table, window)
        chunk.candidates(replies, buckets)
        return _result(table, chunk, chunk.removed(replies, buckets))

    blocks = packed.answers(parts.applyInArrow(ask_blocks, packed.ASKS), _again)
    asked = parts.cogroup(blocks.groupBy("chunk")).applyInArrow(ask_windows, packed.ASKS)
    windows = packed.answers(asked, _earlier)
    return parts.cogroup(blocks.unionByName(windows).groupBy("chunk")).applyInArrow(finish, RESULT)


@query("op3_substring_dedup")
def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return kept.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
