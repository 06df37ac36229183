"""Questions from every part of a corpus to an index of the whole corpus.

Texts are dealt once into chunks of bounded size. A chunk sends its distinct 64-bit keys, sorted,
delta-coded and cut by key range into buckets, each with optional numbers. A bucket sees a key of
the whole corpus from all chunks, at most once from each, so a frequent key is never a hot one.
It replies to every chunk with numbers in the order of the keys it was sent; the chunk derives
its keys again from its texts and reads the reply. A key costs 3 to 6 bytes in the shuffle, where
a row with a hash and a place costs about 15, and texts move once: all rounds are one query, in
which Spark reads the same exchange again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20

ASKS = "bucket int, chunk int, round int, sizes array<int>, body binary"
REPLIES = "chunk int, bucket int, round int, width int, body binary"


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) and the number of buckets, both in proportion to the bytes of text.

    Rows go to chunks by doc_id and length, so rows that repeat one doc_id spread too. Null ids and
    texts are kept. Chunks and buckets grow with the fourth root of the corpus beyond 1 GB, up to 16
    times, so that a chunk still has a fair number of keys for each of the many buckets.
    """
    total = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    size = (total[0] or 0) + 64 * total[1]
    scale = min(max(size / 2**30, 1) ** 0.25, 16)
    chunks, buckets = max(12, -(-size // int(chunk_bytes * scale))), max(12, -(-size // int(bucket_bytes * scale)))
    key = F.xxhash64(F.lit(17), "doc_id", F.octet_length("text"))
    return docs.select(F.pmod(key, F.lit(int(chunks))).cast("int").alias("chunk"), "doc_id", "text"), int(buckets)


def squeeze(values: np.ndarray) -> bytes:
    """Byte planes of numbers, compressed; small numbers leave planes of zeros."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def widen(body: bytes, count: int, kind=np.uint64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(body, count * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, count).T).view(kind).reshape(count)


def edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted keys; buckets are equal ranges of the key space."""
    step = -(-(2**64) // buckets)
    return np.append(np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) * np.uint64(step)), len(keys))


def ask_rows(chunk: int, number: int, buckets: int, keys: np.ndarray, values: Iterable[np.ndarray] = ()) -> pa.Table:
    """Rows of ASKS for sorted distinct keys, with 64-bit numbers alongside."""
    at, values = edges(keys, buckets), list(values)
    out = []
    for b in np.flatnonzero(np.diff(at)):
        lo, hi = at[b], at[b + 1]
        body = [squeeze(np.diff(keys[lo:hi], prepend=np.uint64(0)))] + [squeeze(v[lo:hi]) for v in values]
        out.append((int(b), chunk, number, [int(hi - lo), *map(len, body)], b"".join(body)))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
    columns = zip(*out) if out else [[]] * 5
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["bucket", "chunk", "round", "sizes", "body"])


def read_ask(row: dict) -> list[np.ndarray]:
    """Keys, then the numbers sent with them."""
    count, *sizes = row["sizes"]
    out, place = [], 0
    for k, size in enumerate(sizes):
        part = widen(row["body"][place : place + size], count, np.uint64 if k == 0 else np.int64)
        out.append(np.cumsum(part, dtype=np.uint64) if k == 0 else part)
        place += size
    return out


def reply_rows(rows: list[dict], decide: Callable[[list[list[np.ndarray]]], list[np.ndarray]]) -> pa.Table:
    """Rows of REPLIES to the rows of ASKS that one bucket got."""
    out = []
    for row, reply in zip(rows, decide([read_ask(r) for r in rows])):
        width = reply.dtype.itemsize if reply.dtype != bool else 0
        body = pa.compress(np.packbits(reply).tobytes(), codec="zstd", asbytes=True) if width == 0 else squeeze(reply)
        out.append((row["chunk"], row["bucket"], row["round"], width, body))
    kinds = [pa.int32()] * 4 + [pa.binary()]
    columns = zip(*out) if out else [[]] * 5
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["chunk", "bucket", "round", "width", "body"])


def answers(asks: DataFrame, decide: Callable[[list[list[np.ndarray]]], list[np.ndarray]]) -> DataFrame:
    """Replies: `decide` gets what each chunk sent to a bucket and gives numbers for each key of each."""

    def run(table: pa.Table) -> pa.Table:
        return reply_rows(table.to_pylist(), decide)

    return asks.groupBy("bucket").applyInArrow(run, REPLIES)


def read_replies(replies: pa.Table, number: int, keys: np.ndarray, buckets: int, empty) -> np.ndarray:
    """One number for each sorted key, from the replies of one round; `empty` fills what nobody answered."""
    at = edges(keys, buckets)
    out = None
    for row in replies.to_pylist():
        if row["round"] != number:
            continue
        lo, hi = at[row["bucket"]], at[row["bucket"] + 1]
        if row["width"] == 0:
            packed = pa.decompress(row["body"], -(-int(hi - lo) // 8), codec="zstd", asbytes=True)
            part = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(hi - lo)).astype(bool)
        else:
            part = widen(row["body"], int(hi - lo), {1: np.uint8, 4: np.uint32, 8: np.int64}[row["width"]])
        if out is None:
            out = np.full(len(keys), empty, part.dtype)
        out[lo:hi] = part
    return np.full(len(keys), empty) if out is None else out


def pool(sent: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of a bucket: the distinct ones, and for each one sent its place among them; where senders end."""
    ends = np.cumsum([len(s[0]) for s in sent])
    keys, place = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
    return keys, place, ends


def per_sender(values: np.ndarray, place: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return np.split(values[place], ends[:-1])


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place of each key among them."""
    return np.unique(keys, return_inverse=True)
