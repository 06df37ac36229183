"""Operator 13: whitening of embeddings by a bidiagonal qd solver.

Entries become integers, so sums and deviations from the mean are exact and do not depend on the
order of rows. The mean is taken off before anything is multiplied. Every task reduces its
centred rows, block after block, to the triangle R of a QR factorisation; triangles are stacked and
reduced again, FAN at a time, over as many rounds as any number of tasks needs. No Gram matrix is
formed, so small variances keep their digits.

R has the size of one vector squared, whatever the number of rows, and is solved on the driver:
Householder reflections make it bidiagonal, dqds (differential quotient-difference steps with
shifts from below) gives its singular values to high relative accuracy, and twisted factorisations
of the bidiagonal, one for each value, give the directions. Values closer than CLUSTER of the
largest are made orthogonal to each other. Tasks then project their rows on the directions.
The covariance of the whitened rows is measured over all of them, not derived.

Defined results: a vector that is null, empty or holds null or non-finite entries is dropped, as is
one with an entry of 2^40 or more, whose sums would not be exact; if lengths differ, the
commonest (of equally common ones the longest) counts and other vectors are dropped; rows that
repeat a vec_id or have none are rows of their own; directions without variance are not whitened, so
there are as many components as the rank has, up to `components`; a deviation beyond 64 bits is
null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
LARGEST = float(1 << 40)
BLOCK_ROWS = 4096
SUM_ROWS = 1 << 16
FOLD_BYTES = 1 << 26
TASK_BITS = 21
CLUSTER = 1e-3

EPS = float(np.finfo(np.float64).eps)
TINY = float(np.finfo(np.float64).tiny)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that count, and their length."""
    entry = lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))  # noqa: E731  (NaN is larger than all numbers)
    good = vectors.select("vec_id", "embedding").filter((F.size("embedding") > 0) & F.forall("embedding", entry))
    length = good.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    top = length.agg(F.max(F.struct("n", "length")).alias("top")).first()["top"]
    return good.filter(F.size("embedding") == (top["length"] if top else 0)), top["length"] if top else 0


def integers(column: pa.Array, length: int) -> np.ndarray:
    """Rows of the integers that entries become."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + OFFSET).reshape(-1, length)


@dataclass
class Mean:
    """The exact mean of n rows: `whole` + `rest` / n in each dimension, with |rest| <= n / 2."""

    n: int
    whole: np.ndarray
    rest: list[int]

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Mean:
        whole = [(2 * s + n) // (2 * n) for s in sums]
        return cls(n, np.array(whole, np.int64), [s - n * w for s, w in zip(sums, whole)])

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.whole) - np.array([r / self.n for r in self.rest])

    def deviation(self, rows: np.ndarray) -> pa.Array:
        """Sum of (n x - S)^2, exact, null beyond 64 bits."""
        about = float(self.n) ** 2 * np.square(self.centred(rows)).sum(axis=1)
        rest = np.array([r % 2**64 for r in self.rest], np.uint64)
        wide = (rows - self.whole).view(np.uint64) * np.uint64(self.n % 2**64) - rest
        exact = (wide * wide).sum(axis=1, dtype=np.uint64).view(np.int64)
        sure = about < 2.0**63 * (1 - 1e-9)
        for k in np.flatnonzero(~sure & (about < 2.0**63 * (1 + 1e-9))):
            total = sum((self.n * int(y) - r) ** 2 for y, r in zip(rows[k] - self.whole, self.rest))
            sure[k] = total < 2**63
        return pa.array(exact, mask=~sure)


def exact_mean(rows: DataFrame, length: int) -> Mean | None:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(length, np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, SUM_ROWS):
                x = integers(batch.column(0).slice(start, SUM_ROWS), length)
                total, n = total + x.sum(axis=0), n + len(x)
                if n >= SUM_ROWS:
                    yield pa.record_batch([pa.array([n]), pa.array([total])], names=["n", "sums"])
                    total, n = np.zeros(length, np.int64), 0
        yield pa.record_batch([pa.array([n]), pa.array([total])], names=["n", "sums"])

    parts = rows.select("embedding").mapInArrow(sums, "n long, sums array<long>")
    each = parts.select("n", F.posexplode("sums").alias("place", "part"))
    found = each.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).orderBy("place").collect()
    return Mean.of(found[0]["n"], [int(r["total"]) for r in found]) if found and found[0]["n"] else None


def folded(blocks: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray], width: int) -> list[np.ndarray]:
    """All blocks (block int, body array<double>) merged in rounds; a group of a round is bounded in bytes."""
    bits = int(np.clip(np.log2(FOLD_BYTES / (8 * width)), 1, 7))

    def run(group: pa.Table) -> pa.Table:
        bodies = [row.values.to_numpy() for row in group.column("body")]
        return pa.table({"block": pa.array([group.column("next")[0].as_py()], pa.int32()), "body": pa.array([merge(bodies)], pa.list_(pa.float64()))})

    for _ in range(-(-TASK_BITS // bits)):
        blocks = blocks.withColumn("next", F.shiftright("block", bits)).groupBy("next").applyInArrow(run, "block int, body array<double>")
    return [np.array(r["body"]) for r in blocks.collect()]


def _block(body: np.ndarray) -> pa.RecordBatch:
    number = pa.array([TaskContext.get().partitionId()], pa.int32())
    return pa.record_batch([number, pa.array([body.ravel()], pa.list_(pa.float64()))], names=["block", "body"])


def triangle(rows: DataFrame, mean: Mean) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    length = len(mean.whole)

    def square(part: np.ndarray) -> np.ndarray:
        out = np.zeros((length, length))
        out[: len(part)] = part
        return out

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, seen = np.zeros((0, length)), False
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                x = integers(batch.column(0).slice(start, BLOCK_ROWS), length)
                r, seen = np.linalg.qr(np.vstack([r, mean.centred(x)]), mode="r"), True
        if seen:
            yield _block(square(r))

    def merge(bodies: list[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, length))
        for body in bodies:
            r = np.linalg.qr(np.vstack([r, body.reshape(length, length)]), mode="r")
        return square(r).ravel()

    blocks = rows.select("embedding").mapInArrow(reduce, "block int, body array<double>")
    return merge(folded(blocks, merge, length * length)).reshape(length, length)


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V with matrix = U B V^T, by Householder reflections from both sides."""
    m, n = matrix.copy(), len(matrix)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            return None
        w = x / size
        w[0] += np.copysign(1.0, w[0])
        return w / np.linalg.norm(w)

    for k in range(n - 1):
        w = reflector(m[k:, k])
        if w is not None:
            m[k:, k:] -= 2 * np.outer(w, w @ m[k:, k:])
        w = reflector(m[k, k + 1 :])
        if w is not None:
            m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One differential step: the new q and e, and the pivots d, all positive if the shift is below the least eigenvalue."""
    n = len(q)
    d = np.empty(n)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d[0] = q[0] - shift
    for k in range(n - 1):
        new_q[k] = d[k] + e[k]
        ratio = q[k + 1] / new_q[k] if new_q[k] else 0.0
        new_e[k] = e[k] * ratio
        d[k + 1] = d[k] * ratio - shift
    new_q[-1] = d[-1]
    return new_q, new_e, d


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of B^T B for the squares of a bidiagonal's entries, in falling order."""
    out, work = [], [(np.asarray(q, float), np.asarray(e, float), 0.0)]
    limit = 100 * (len(q) + 1) * 30
    while work:
        q, e, moved = work.pop()
        if len(q) == 1:
            out.append(moved + q[0])
            continue
        small = np.flatnonzero(e <= (10 * EPS) ** 2 * (moved + np.minimum(q[:-1], q[1:])))
        if len(small):
            k = small[-1]
            work += [(q[: k + 1], e[:k], moved), (q[k + 1 :], e[k + 1 :], moved)]
            continue
        limit -= 1
        if limit < 0:
            raise RuntimeError("dqds did not settle")
        # pivots without a shift are the inverses of the inverse's diagonal: they bound the least eigenvalue from both sides
        new = _step(q, e, 0.0)
        least = float(new[2].min())
        if least > 0:
            below = 1.0 / float((1.0 / new[2]).sum())
            for shift in (below + 0.6 * (least - below), below * (1 - 4 * EPS * len(q))):
                tried = _step(q, e, shift)
                if shift > 0 and tried[2].min() >= 0:
                    new, moved = tried, moved + shift
                    break
        work.append((new[0], new[1], moved))
    return np.sort(np.array(out))[::-1]


def twisted(a: np.ndarray, b: np.ndarray, value: float, known: list[np.ndarray]) -> np.ndarray:
    """Unit eigenvector of B^T B for an eigenvalue, orthogonal to those already known for its cluster."""
    n = len(a)
    if n == 1:
        return np.ones(1)
    q, e, ab = a * a, b * b, a[:-1] * b
    guard = lambda x: x if abs(x) > TINY else TINY
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for k in range(n - 1):
        pivot = guard(s[k] + q[k])
        down[k] = ab[k] / pivot
        s[k + 1] = e[k] * (s[k] / pivot) - value
    p[-1] = q[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = guard(e[k] + p[k + 1])
        up[k] = ab[k] / pivot
        p[k] = q[k] * (p[k + 1] / pivot) - value
    best, best_norm = None, -1.0
    for r in np.argsort(np.abs(s + p + value), kind="stable")[: len(known) + 1]:
        z = np.zeros(n)
        z[r] = 1.0
        for k in range(r - 1, -1, -1):
            z[k] = -down[k] * z[k + 1]
        for k in range(r, n - 1):
            z[k + 1] = -up[k] * z[k]
        z /= np.linalg.norm(z)
        for _ in range(2):
            for other in known:
                z -= (other @ z) * other
        norm = np.linalg.norm(z)
        if norm > best_norm:
            best, best_norm = z / max(norm, TINY), norm
        if norm > 0.1:
            break
    return best


def directions(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of R^T R, with all their sum last, and their unit vectors as columns."""
    n = len(r)
    top = np.abs(r).max() if n else 0.0
    if top == 0:
        return np.zeros(1), np.zeros((n, 0))
    a, b, v = bidiagonal(r / top)
    b[np.abs(b) <= EPS * (np.abs(a[:-1]) + np.abs(a[1:]))] = 0.0
    edges = [0, *(np.flatnonzero(b == 0) + 1).tolist(), n]
    found = [(value, lo, hi) for lo, hi in zip(edges, edges[1:]) for value in dqds(a[lo:hi] ** 2, b[lo : hi - 1] ** 2)]
    found.sort(key=lambda f: -f[0])
    total = float(sum(value for value, _, _ in found))
    floor = (4 * n * EPS) ** 2 * found[0][0]
    values, vectors, known = [], [], {}
    for value, lo, hi in found[:components]:
        if value <= floor:
            break
        near = known.setdefault((lo, hi), [])
        cluster = [z for other, z in near if other - value <= CLUSTER * found[0][0]]
        z = twisted(a[lo:hi], b[lo : hi - 1], value, cluster)
        near.append((value, z))
        values.append(value)
        vectors.append(v[:, lo:hi] @ z)
    return np.array([*values, total]) * top * top, np.array(vectors).T.reshape(n, len(vectors))


@dataclass
class Whitening:
    mean: Mean
    matrix: np.ndarray
    explained: list[float]

    def apply(self, rows: np.ndarray) -> np.ndarray:
        return self.mean.centred(rows) @ self.matrix


def fit(rows: DataFrame, length: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows of one length; None where there is nothing to whiten."""
    mean = exact_mean(rows, length) if length else None
    if mean is None:
        return None
    values, vectors = directions(triangle(rows, mean), components)
    if not vectors.shape[1]:
        return None
    return Whitening(mean, vectors / np.sqrt(values[:-1] / mean.n), (values[:-1] / values[-1]).tolist())


def identity_error(rows: DataFrame, whitening: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, centred before multiplying."""
    length, k = whitening.matrix.shape

    def moments(x: np.ndarray) -> np.ndarray:
        mean = x.mean(axis=0)
        y = x - mean
        return np.concatenate([[len(x)], mean, (y.T @ y).ravel()])

    def merge(bodies: list[np.ndarray]) -> np.ndarray:
        bodies = np.stack(bodies)
        n, means = bodies[:, 0], bodies[:, 1 : k + 1]
        mean = n @ means / n.sum()
        apart = means - mean
        return np.concatenate([[n.sum()], mean, bodies[:, k + 1 :].sum(axis=0) + ((apart * n[:, None]).T @ apart).ravel()])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body = None
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                found = moments(whitening.apply(integers(batch.column(0).slice(start, BLOCK_ROWS), length)))
                body = found if body is None else merge([body, found])
        if body is not None:
            yield _block(body)

    blocks = rows.select("embedding").mapInArrow(measure, "block int, body array<double>")
    total = merge(folded(blocks, merge, 1 + k + k * k))
    return float(np.abs(total[k + 1 :].reshape(k, k) / total[0] - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) of every row that counts; arrays by component."""
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    rows, length = usable(vectors)
    whitening = fit(rows, length, components)
    if whitening is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, n = identity_error(rows, whitening), whitening.mean.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = whitening.matrix.shape[1]
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                x = integers(part.column(1), length)
                ends = pa.array(np.arange(0, (len(x) + 1) * k, k, dtype=np.int32))
                lists = lambda values: pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values).ravel()))  # noqa: B023, E731
                columns = [
                    part.column(0), pa.array(np.full(len(x), n)), whitening.mean.deviation(x), lists(whitening.apply(x)),
                    lists(np.tile(whitening.explained, (len(x), 1))), pa.array(np.full(len(x), error)),
                ]
                yield pa.record_batch(columns, names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


@query("op13_whitening")
def op13_whitening(spark, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "at"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("at.whitened").alias("whitened"),
        F.col("at.explained").alias("explained"), "identity_error",
    )
