"""Operator 4: language-model scores from a probabilistic suffix tree over words.

The root holds every token's count. A context (the one to `DEPTH` words before a token) is a candidate
if training documents hold it at least `MIN_COUNT` times, whatever the size of the corpus, so
candidates grow with it. A candidate is retained if its next-symbol distribution diverges from that
of its suffix: the likelihood-ratio statistic over full follower counts must pass the chi-square
quantile of `Z`, and the Kullback-Leibler divergence, less its expected excess, `MIN_DIVERGENCE`.
Followers with an expected count under 1 and a count under `HEAVY`, and those never seen, are one
class in the test.

Every token is scored in its longest retained suffix. A state's distribution is its counts over all
followers, smoothed towards its suffix by its number of different followers; a node that is not
retained, but lies on the way to a longer one, has its suffix's distribution. The root is smoothed
by 0.5 a token. All distributions sum to one over known tokens and one unknown.

No part of the tree reaches the driver or one task. Chunks of documents ask (`packed`) for the counts
of the n-grams they hold: words and pairs first, then three and four words where all pairs of words
before the last are candidates. Of the chunks that hold an n-gram the lowest owns it and adds its
share of the divergence to its context; sums per context are whole numbers, so reruns agree. A chunk
sends a key once, so a frequent context is never a hot one. Counting covers all training documents.

Defined results: null text is empty and has one token, its end; a null doc_id is a training document;
rows that repeat a doc_id count once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .registry import query, table
from .text import Rolling, WordHashes, slices

DEPTH = 3
MIN_COUNT = 64
MIN_DIVERGENCE = 0.005
Z = 3.09
HEAVY = 5
FOLDS, HELD_OUT = 5, 1
CHUNK_BYTES = 6 << 20
BOX_BYTES = 16 << 20
HELD_KEYS = 1 << 21
END = np.uint64(0x5851F42D4C957F2D)
UNIT = 1 << 10

# n-grams counted and contexts tested in each pass over the chunks
COUNTED = [(1, 2), (3, 4), ()]
TESTED = [(), (1,), (2, 3)]
TESTS = 100

SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class _Tokens:
    """Tokens of the rows of a table: hash, row, place in its row, whether its row trains."""

    def __init__(self, texts: pa.Table):
        words = WordHashes(texts, lowered=True)
        rows = len(words.counts)
        self.counts = words.counts + 1
        self.tokens = np.insert(words.hashes, words.bounds[1:], END) if rows else words.hashes
        self.row = np.repeat(np.arange(rows), self.counts)
        starts = np.cumsum(self.counts) - self.counts
        self.place = np.arange(len(self.tokens)) - starts[self.row]
        ids = texts.column("doc_id").to_pylist()
        self.held = np.array([held_out(i) for i in ids], bool)
        self.train = ~self.held[self.row]
        self.ids = ids


def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (chunk, doc_id, text) as one compressed Arrow stream for each chunk, so that texts move small."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))
    for batch in batches:
        for part in slices(pa.Table.from_batches([batch]), limit=BOX_BYTES):
            part = part.sort_by("chunk")
            chunk = part.column("chunk").to_numpy()
            starts = np.flatnonzero(np.diff(chunk, prepend=-1))
            bodies = []
            for start, end in zip(starts, np.append(starts[1:], len(chunk))):
                sink = pa.BufferOutputStream()
                rows = part.select(["doc_id", "text"]).slice(start, end - start).combine_chunks()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as stream:
                    stream.write_table(rows)
                bodies.append(sink.getvalue().to_pybytes())
            yield pa.record_batch([pa.array(chunk[starts], pa.int32()), pa.array(bodies, pa.binary())], names=["chunk", "body"])


def unboxed(rows: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(body.as_buffer()).read_all() for body in rows.column("body"))


def corpus_size(docs: DataFrame, buckets: int) -> tuple[int, int]:
    """Training tokens, and the different ones among them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(pa.Table.from_batches([batch]), limit=CHUNK_BYTES):
                tokens = _Tokens(part)
                more, number = np.unique(tokens.tokens[tokens.train], return_counts=True)
                keys, place = packed.distinct(np.concatenate([keys, more]))
                counts = np.bincount(place, np.concatenate([counts, number])).astype(np.int64)
                if len(keys) > HELD_KEYS:
                    yield from packed.ask_rows(0, 0, buckets, keys, [counts]).to_batches()
                    keys, counts = keys[:0], counts[:0]
        yield from packed.ask_rows(0, 0, buckets, keys, [counts]).to_batches()

    def count(rows: pa.Table) -> pa.Table:
        sent = [packed.read_ask(r) for r in rows.to_pylist()]
        types = len(np.unique(np.concatenate([s[0] for s in sent])))
        return pa.table({"tokens": [int(sum(s[1].sum() for s in sent))], "types": [types]})

    counted = docs.mapInArrow(ask, packed.ASKS).groupBy("bucket").applyInArrow(count, "tokens long, types long")
    row = counted.agg(F.sum("tokens"), F.sum("types")).first()
    return row[0] or 0, row[1] or 0


class _Grams:
    """The n-grams of one length in a chunk: last token of each, sorted distinct keys, place of each among them."""

    def __init__(self, at: np.ndarray, hashes: np.ndarray, total: int):
        self.at = at
        self.keys, place = packed.distinct(hashes)
        self.place = np.full(total, -1)
        self.place[at] = place
        self.sample = np.zeros(len(self.keys), np.int64)
        self.sample[place] = at
        self.count = self.owned = None

    def read(self, reply: np.ndarray) -> None:
        self.count, self.owned = reply >> 1, (reply & 1).astype(bool)

    def counts(self, at: np.ndarray) -> np.ndarray:
        return self.count[self.place[at]]


class _Chunk:
    """A chunk of boxed texts with what the first `passes` passes found for it."""

    def __init__(self, texts: pa.Table, replies: pa.Table | None, buckets: int, passes: int, total: int):
        self.tokens, self.buckets, self.total = _Tokens(unboxed(texts)), buckets, total
        self.rolling = Rolling(self.tokens.tokens)
        self.grams: dict[int, _Grams] = {}
        self.weights: dict[int, np.ndarray] = {}
        for done in range(passes):
            self.count(COUNTED[done])
            for n in COUNTED[done]:
                self.grams[n].read(packed.read_replies(replies, n, self.grams[n].keys, buckets, 0))
        for done in range(passes):
            for n in TESTED[done]:
                chosen = self.candidates(n)
                self.weights[n] = np.zeros(len(chosen), np.int64)
                self.weights[n][chosen] = packed.read_replies(replies, TESTS + n, self.grams[n].keys[chosen], buckets, 0)

    def count(self, lengths: tuple[int, ...]) -> None:
        """Cut n-grams; those of three words and more only where all pairs before the last word are candidates."""
        t = self.tokens
        for n in lengths:
            held = t.place >= n - 1
            if n > 2:
                inner = self.grams[2]
                often = np.append(inner.count >= MIN_COUNT, False)[inner.place]
                for back in range(1, n - 1):
                    held[back:] &= often[:-back]
            at = np.flatnonzero(held)
            self.grams[n] = _Grams(at, self.rolling.of(at - n + 1, at + 1), len(t.tokens))

    def candidates(self, n: int) -> np.ndarray:
        """Which n-grams are candidate contexts: frequent, and not the end of a text."""
        g = self.grams[n]
        return (g.count >= MIN_COUNT) & (self.tokens.tokens[g.sample] != END)

    def shares(self, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Candidate contexts of n words, and sums over those followers of each that this chunk owns."""
        inner, outer = self.grams[n], self.grams[n + 1]
        chosen = self.candidates(n)
        last = outer.sample[outer.owned]
        context = inner.place[last - 1]
        kept = np.append(chosen, False)[context]
        last, context = last[kept], context[kept]
        seen = outer.counts(last).astype(float)
        suffix = self.grams[n - 1].counts(last - 1) if n > 1 else self.total
        expected = inner.count[context] * (inner.counts(last) / suffix)
        alone = (expected >= 1) | (seen >= HEAVY)
        owner = (np.cumsum(chosen) - 1)[context]

        def summed(values: np.ndarray) -> np.ndarray:
            return np.rint(np.bincount(owner, values, int(chosen.sum()))).astype(np.int64)

        gain = np.rint(UNIT * seen * np.log(seen / expected))
        parts = [gain * alone, seen * alone, np.rint(UNIT * expected) * alone, alone, np.ones(len(seen)), seen]
        return inner.keys[chosen], [summed(p) for p in parts]

    def asks(self, chunk: int, number: int) -> pa.Table:
        self.count(COUNTED[number])
        out = []
        for n in COUNTED[number]:
            g = self.grams[n]
            trained = g.place[g.at[self.tokens.train[g.at]]]
            local = np.bincount(trained, minlength=len(g.keys)).astype(np.int64)
            out.append(packed.ask_rows(chunk, n, self.buckets, g.keys, [local]))
        for n in TESTED[number]:
            out.append(packed.ask_rows(chunk, TESTS + n, self.buckets, *self.shares(n)))
        return pa.concat_tables(out)

    def scores(self, types: int) -> pa.Table:
        t, rows = self.tokens, len(self.tokens.ids)
        every = np.arange(len(t.tokens))
        counts = self.grams[1].counts(every)
        base = (counts + 0.5) / (self.total + 0.5 * (types + 1))
        best = base.copy()
        for n, weights in self.weights.items():
            g = self.grams[n]
            at = np.flatnonzero(t.place >= n)
            weight = np.append(weights, 0)[g.place[at - 1]]
            at, weight = at[weight > 0], weight[weight > 0]
            best[at] = (self.grams[n + 1].counts(at) + weight * best[at]) / (g.counts(at - 1) + weight)
        total = lambda values: np.bincount(t.row, weights=values, minlength=rows)
        return pa.table({
            "doc_id": pa.array(t.ids, pa.int64()),
            "held_out": pa.array(t.held),
            "n_tokens": pa.array(t.counts.astype(np.int64)),
            "n_known": pa.array(total(counts > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(rows, self.total, np.int64)),
            "base_score": pa.array(total(np.log10(base))),
            "score": pa.array(total(np.log10(best))),
        })


def _totals(sent: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Twice the count of each n-gram, and one for the first chunk that sent it."""
    keys, place, ends = packed.pool(sent)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, np.concatenate([s[1] for s in sent]))
    reply = 2 * total[place]
    first = np.full(len(keys), len(place))
    np.minimum.at(first, place, np.arange(len(place)))
    reply[first[total > 0]] += 1
    return np.split(reply, ends[:-1])


def significant(statistic: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """Whether statistics pass the chi-square quantile of `Z` (Wilson and Hilferty)."""
    part = 2 / (9 * freedom)
    return statistic > freedom * (1 - part + Z * np.sqrt(part)) ** 3


def retained(gain, seen, expected, alone, total) -> np.ndarray:
    """The test of contexts: sums over followers that stand alone, against one class for the others."""
    others, left = total - seen, np.maximum(total - expected, 1)
    gain = gain + others * np.log(np.maximum(others, 1) / left)
    freedom = np.maximum(alone, 1)
    return significant(2 * gain, freedom) & (gain - freedom / 2 >= MIN_DIVERGENCE * total)


def _tests(sent: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The different followers of each context that is retained, 0 for others."""
    keys, place, ends = packed.pool(sent)
    sums = [np.zeros(len(keys), np.int64) for _ in range(6)]
    for k, total in enumerate(sums):
        np.add.at(total, place, np.concatenate([s[k + 1] for s in sent]))
    gain, seen, expected, alone, kinds, total = sums
    keep = retained(gain / UNIT, seen, expected / UNIT, alone, total)
    return packed.per_sender(np.where(keep, kinds, 0), place, ends)


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of every document under the tree of the training documents among them."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, buckets = packed.chunked(docs, CHUNK_BYTES)
    tokens, types = corpus_size(docs, buckets)
    parts = texts.mapInArrow(boxed, "chunk int, body binary").groupBy("chunk")

    def first(key, rows):
        return _Chunk(rows, None, buckets, 0, tokens).asks(key[0].as_py(), 0)

    def further(number: int) -> Callable:
        def ask(key, rows, replies):
            return _Chunk(rows, replies, buckets, number, tokens).asks(key[0].as_py(), number)

        return ask

    def finish(key, rows, replies):
        return _Chunk(rows, replies, buckets, len(COUNTED), tokens).scores(types)

    replies = _answers(parts.applyInArrow(first, packed.ASKS))
    for number in range(1, len(COUNTED)):
        asks = parts.cogroup(replies.groupBy("chunk")).applyInArrow(further(number), packed.ASKS)
        replies = replies.union(_answers(asks))
    return parts.cogroup(replies.groupBy("chunk")).applyInArrow(finish, SCORES)


def _answers(asks: DataFrame) -> DataFrame:
    def run(key, rows):
        return packed.reply_rows(rows.sort_by("chunk").to_pylist(), _tests if key[1].as_py() > TESTS else _totals)

    return asks.groupBy("bucket", "round").applyInArrow(run, packed.REPLIES)


@query("op4_suffix_tree")
def op4_suffix_tree(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
