"""Operator 2: benchmark items inside documents, by size-partitioned MinHash containment search.

An item is the set of its five-word shingles. Items are partitioned by size; in a partition an item
of q shingles, of which r must be found, is indexed under the q - r + 1 smallest of its MinHash
order: a document that holds r of them cannot miss all of these, so the search loses nothing,
while a long document is probed with its own shingles only. Partitions whose smallest item asks for
more shingles than the document has are skipped. A candidate is verified by counting which of
all shingles of the item the document holds.

Items are a stated query set and are taken in blocks of bounded size, each against all documents,
so that the size of what travels with a task does not grow with the benchmark. Documents are
neither shuffled nor exploded.

Words are lower-cased (A-Z) and split at white space and ASCII punctuation, so that case and
punctuation do not hide a leak. An item of fewer than five words is one shingle of all its words.

Defined results: null or wordless texts and items match nothing; items that repeat an item_id are
reported once each; rows that repeat a doc_id are searched one by one; an empty table on either
side gives no matches; `drop_contaminated` passes all columns through.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import keeps_columns
from .registry import query, table
from .text import LOWER, UPPER, Words, lower, mix, raw, slices

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK_BYTES = 8 << 20

_BREAK = np.zeros(256, bool)
_BREAK[:128] = True
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

MATCHES = "doc_id long, item_id long, n_shingles long, n_shared long"


def _words(column) -> Words:
    data, offsets = raw(column)
    return Words(lower(data), offsets, _BREAK)


class Index:
    """A block of items: signature keys by size partition, and all shingles for verification."""

    def __init__(self, ids: list, texts: list, containment: float):
        words = _words(pa.array(texts, pa.string()))
        hashes, counts = words.hashes(), np.diff(words.bounds)
        sizes = np.minimum(counts, SHINGLE)
        owner, keys = [], []
        for size in np.unique(sizes[sizes > 0]):
            at, found = words.windows(hashes, int(size))
            row = words.row[at]
            own = sizes[row] == size
            owner.append(row[own])
            keys.append(mix(found[own] + np.uint64(size)))
        self.ids, self.lengths = ids, [int(s) for s in np.unique(sizes[sizes > 0])]
        pairs = np.unique(np.stack([np.concatenate(owner).astype(np.uint64), np.concatenate(keys)]), axis=1) if owner else np.zeros((2, 0), np.uint64)
        item, key = pairs[0].astype(np.int64), pairs[1]
        self.total = np.bincount(item, minlength=len(ids))
        self.needed = np.array([ceil(containment * n - 1e-9) for n in self.total], np.int64)
        _, place, held = np.unique(key, return_inverse=True, return_counts=True)
        order = np.lexsort((mix(key), held[place], item))  # rare shingles first, then MinHash order
        rank = np.arange(len(order)) - np.concatenate([[0], np.cumsum(self.total)])[item[order]]
        signed = order[rank <= (self.total - self.needed)[item[order]]]
        by_key = np.lexsort((item, key))
        self.keys, self.items = key[by_key], item[by_key]
        part = np.floor(np.log2(np.maximum(self.total, 1))).astype(np.int64)
        self.partitions = []
        for p in np.unique(part[self.total > 0]):
            chosen = signed[part[item[signed]] == p]
            chosen = chosen[np.argsort(key[chosen], kind="stable")]
            self.partitions.append((int(self.needed[(part == p) & (self.total > 0)].min()), key[chosen], item[chosen]))

    def search(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shared) of all verified items in the rows of a text column."""
        words = _words(column)
        hashes = words.hashes()
        row, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for size in self.lengths:
            at, found = words.windows(hashes, size)
            row.append(words.row[at])
            key.append(mix(found + np.uint64(size)))
        row, key = np.concatenate(row), np.concatenate(key)
        own = np.bincount(row, minlength=len(words.bounds) - 1)
        candidates = [np.zeros((0, 2), np.int64)]
        for least, keys, items in self.partitions:
            large = own[row] >= least
            candidates.append(_matches(row[large], key[large], keys, items)[0])
        candidates = np.unique(np.concatenate(candidates), axis=0)
        if not len(candidates):
            return (np.zeros(0, np.int64),) * 3
        suspect = np.isin(row, candidates[:, 0])
        pairs, hits = _matches(row[suspect], key[suspect], self.keys, self.items)
        number = len(self.ids)
        code = pairs[:, 0] * number + pairs[:, 1]
        wanted = np.isin(code, candidates[:, 0] * number + candidates[:, 1])
        held = np.unique(np.stack([code[wanted].astype(np.uint64), hits[wanted]]), axis=1)[0].astype(np.int64)
        code, shared = np.unique(held, return_counts=True)
        row, item = code // number, code % number
        enough = shared >= self.needed[item]
        return row[enough], item[enough], shared[enough]


def _matches(row, key, keys, items) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) and key of every probe that meets a sorted key; a key may have several items."""
    lo = np.searchsorted(keys, key, "left")
    met = np.flatnonzero(lo < len(keys))
    met = met[keys[lo[met]] == key[met]]
    counts = np.searchsorted(keys, key[met], "right") - lo[met]
    place = np.repeat(lo[met] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(met) else met
    return np.stack([np.repeat(row[met], counts), items[place]], axis=1), np.repeat(key[met], counts)


def indexes(benchmark: DataFrame, containment: float) -> list[Index]:
    """The items in blocks of about BLOCK_BYTES of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna(subset=["text"])
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = []
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        if rows:
            out.append(Index([r.item_id for r in rows], [r.text for r in rows], containment))
    return out


def contained_items(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) for every item that a document holds to `containment` or more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in indexes(benchmark, containment) or [Index([], [], containment)]:

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            names = pa.array(index.ids, pa.int64())
            for batch in batches:
                for part in slices(pa.Table.from_batches([batch])):
                    row, item, shared = index.search(part.column("text"))
                    ids = part.column("doc_id").combine_chunks().take(pa.array(row))
                    yield pa.record_batch(
                        [ids, names.take(pa.array(item)), pa.array(index.total[item], pa.int64()), pa.array(shared, pa.int64())],
                        names=["doc_id", "item_id", "n_shingles", "n_shared"],
                    )

        found = rows.mapInArrow(run, MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


@keeps_columns
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that hold no item, all columns."""
    for index in indexes(benchmark, containment):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(pa.Table.from_batches([batch])):
                    clean = np.ones(part.num_rows, bool)
                    clean[index.search(part.column("text"))[0]] = False
                    yield from part.filter(pa.array(clean)).combine_chunks().to_batches()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


_TOKENS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op2_decontamination",
    rf"""
    WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
    i AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
    wanted AS (
        SELECT DISTINCT item_id, array_to_string(w[k:k + least(len(w), {SHINGLE}) - 1], ' ') AS s, least(len(w), {SHINGLE}) AS n
        FROM (SELECT *, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS k FROM i WHERE len(w) > 0)
    ),
    probes AS (
        SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n)
    ),
    sized AS (SELECT item_id, count(*) AS n_shingles FROM wanted GROUP BY item_id)
    SELECT doc_id, item_id, n_shingles, count(*) AS n_shared
    FROM wanted JOIN probes USING (s, n) JOIN sized USING (item_id)
    GROUP BY doc_id, item_id, n_shingles
    HAVING count(*) >= ceil({CONTAINMENT} * n_shingles - 1e-9)
    """,
)
def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
