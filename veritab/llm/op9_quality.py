"""Operator 9: quality by weak supervision.

Ten rules vote good, bad or abstain on each document. Expectation-maximisation over the counts of
vote patterns estimates how often each rule gives each vote on good and on bad documents, without
labels; the posterior probability of a good document decides. An abstention says nothing about a
document: most rules look for one kind of junk, and missing that kind must not vouch for a text
that shows another. There are at most 3^10 patterns at any corpus size, which bounds what reaches
the driver; counts cover all documents. A document that fails the base rules is never kept.

Votes follow from measures that are taken slice by slice in numpy; the measures are taken once to
count the patterns and once to decide, so no text is shuffled.

Defined results: null text has no words and fails; ties at a posterior of exactly the threshold
are kept; repeated rows are measured one by one; an empty table gives no rows and an untrained
model; `keep_good` passes all columns through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import keeps_columns
from .registry import query, table
from .text import Rolling, Words, cover, mix, raw, slices

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
PART_BYTES = 1 << 19
SYMBOLS = b"#*$%&|<>"
THRESHOLD = 0.5
GOOD, BAD, ABSTAIN = 2, 1, 0

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def _is_any(data: np.ndarray, chars: bytes) -> np.ndarray:
    wanted = np.zeros(256, bool)
    wanted[list(chars)] = True
    return wanted[data]


def _lines(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every line that has a word."""
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(breaks + 1, offsets[:-1])
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - ((data[ends - 1] == 10) if len(ends) else 0)
    with_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[with_word], ends[with_word]
    row = np.searchsorted(offsets, starts, "right") - 1
    hashes = Rolling(data.astype(np.uint64) + np.uint64(1)).of(starts, ends)
    return row, hashes


def _within_row(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)))


def measure(texts: pa.Table) -> dict[str, np.ndarray]:
    """Counts for each row of a slice."""
    data, offsets = raw(texts.column("text"))
    rows = len(offsets) - 1
    words = Words(data, offsets)
    hashes = words.hashes()
    n_words = np.diff(words.bounds)
    in_word = np.zeros(len(data) + 1, np.int8)
    np.add.at(in_word, words.start, 1)
    np.add.at(in_word, words.end, -1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8) > 0
    plain = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90)) | ((data >= 48) & (data <= 57))
    plain_sums = np.concatenate([[0], np.cumsum(plain)])
    odd_tail = ~plain[words.end - 1] & ~plain[np.maximum(words.end - 2, 0)] & (words.end - words.start > 1)
    rough = odd_tail | (plain_sums[words.end] == plain_sums[words.start])
    row, line = _lines(data, offsets, words)
    n_lines = np.bincount(row, minlength=rows)
    distinct = np.unique(np.stack([row.astype(np.uint64), line]), axis=1)[0].astype(np.int64) if len(row) else row
    at, windows = words.windows(hashes, WINDOW)
    _, place, counts = np.unique(_within_row(words.row[at], windows), return_inverse=True, return_counts=True)
    repeated = cover(at[counts[place] > 1], WINDOW, len(words))
    _, first, counts = np.unique(_within_row(words.row, hashes), return_index=True, return_counts=True)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, words.row[first], counts)
    return {
        "n_words": n_words,
        "word_chars": _per_row(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_row(_is_any(data, SYMBOLS), offsets),
        "n_dup_lines": n_lines - np.bincount(distinct, minlength=rows),
        "n_repeat_words": np.diff(np.concatenate([[0], np.cumsum(repeated)])[words.bounds]),
        "n_lines": n_lines,
        "n_upper": _per_row((data >= 65) & (data <= 90), offsets),
        "n_lower": _per_row((data >= 97) & (data <= 122), offsets),
        "n_exclaim": _per_row(data == 33, offsets),
        "n_plain": _per_row(plain & ((data & 0xC0) != 0x80), offsets),
        "n_rough": np.bincount(words.row[rough], minlength=rows),
        "n_same": np.bincount(words.row[1:][(hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])], minlength=rows),
        "top_word": top,
    }


def _between(value, good_below, bad_above):
    return np.where(value > bad_above, BAD, np.where(value <= good_below, GOOD, ABSTAIN))


def _above(value, limit):
    return np.where(value > limit, BAD, ABSTAIN)


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One row of votes for each document; the limits of a rule are its own two numbers."""
    words, lines = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1)
    letters = np.maximum(m["n_upper"] + m["n_lower"], 1)
    chars = np.maximum(m["word_chars"], 1)
    rules = [
        _above(m["n_symbols"] / words, 0.1),
        _above(m["n_upper"] / letters, 0.5),
        _above(m["n_exclaim"] / words, 0.2),
        _above(m["n_dup_lines"] / lines * (m["n_lines"] >= 3), 0.4),
        _above(m["n_repeat_words"] / words, 0.3),
        _above(m["top_word"] / words * (m["n_words"] >= 40), 0.3),
        _above(m["n_same"] / words, 0.3),
        _between(1 - m["n_plain"] / chars, 0.08, 0.15),
        _between(m["n_rough"] / words, 0.1, 0.25),
        np.where(m["n_words"] < MIN_WORDS, BAD, np.where(m["n_words"] >= 50, GOOD, ABSTAIN)),
    ]
    return np.stack(rules, axis=1).astype(np.int64)


N_RULES = 10
CODES = 3 ** np.arange(N_RULES)


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


class Model:
    """How often each rule gives each vote on bad (0) and good (1) documents, and the share of good ones."""

    def __init__(self):
        self.table = np.empty((2, N_RULES, 3))
        self.table[0] = [0.6, 0.3, 0.1]
        self.table[1] = [0.49, 0.01, 0.5]
        self.good = 0.8

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of a good document for each row of votes."""
        log = np.log(self.table)
        log[:, :, ABSTAIN] = 0
        log = log[:, np.arange(N_RULES), patterns].sum(axis=2)
        odds = log[1] + np.log(self.good) - log[0] - np.log1p(-self.good)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = 0.02) -> Model:
        """Expectation-maximisation; the starting table counts as `strength` of the documents."""
        start, total = self.table.copy(), counts.sum()
        hot = np.eye(3)[patterns]
        for _ in range(rounds if total else 0):
            good = self.posterior(patterns)
            shares = np.stack([(1 - good) * counts, good * counts])
            prior = strength * total + 1
            old = self.table
            self.table = (np.einsum("cp,prv->crv", shares, hot) + prior * start) / (shares.sum(axis=1) + prior)[:, None, None]
            self.good = float(np.clip((shares[1].sum() + 0.8 * prior) / (total + prior), 0.01, 0.99))
            if np.abs(old - self.table).max() < 1e-9:
                break
        return self


def _decode(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // CODES % 3


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(pattern, documents): at most 3^rules rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(pa.Table.from_batches([batch]), limit=PART_BYTES):
                codes, counts = np.unique(votes(measure(part)) @ CODES, return_counts=True)
                yield pa.record_batch([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["pattern", "documents"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern long, documents long")
    return parts.groupBy("pattern").agg(F.sum("documents").alias("documents"))


def train(docs: DataFrame) -> Model:
    found = vote_patterns(docs).collect()
    patterns = _decode(np.array([r.pattern for r in found], np.int64).reshape(-1))
    return Model().fit(patterns, np.array([r.documents for r in found], float))


def mark_quality(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with __n_words and the other measures, __base_failed, __quality (posterior) and __kept."""
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(pa.Table.from_batches([batch]), limit=PART_BYTES):
                m = measure(part)
                failed, quality = base_failed(m), model.posterior(votes(m))
                for name in MEASURES:
                    part = part.append_column(f"__{name}", pa.array(m[name], pa.int64()))
                part = part.append_column("__base_failed", pa.array(failed))
                part = part.append_column("__quality", pa.array(quality))
                part = part.append_column("__kept", pa.array(~failed & (quality >= threshold)))
                yield from part.combine_chunks().to_batches()

    added = [T.StructField(f"__{name}", T.LongType()) for name in MEASURES]
    added += [T.StructField("__base_failed", T.BooleanType()), T.StructField("__quality", T.DoubleType()), T.StructField("__kept", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


@keeps_columns
def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of good documents, all columns."""
    return mark_quality(docs).filter("__kept").select(*docs.columns)


@query("op9_quality")
def op9_quality(spark, sf_dir: str) -> DataFrame:
    marked = mark_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [*MEASURES, "base_failed", "kept"]
    return marked.select("doc_id", *[F.col(f"__{n}").alias(n) for n in names], F.col("__quality").alias("quality"))
