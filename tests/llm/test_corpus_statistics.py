"""Collocations, shards and whitening against plain versions and on edge cases."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import LOWER
from veritab.llm import op11_collocations, op12_sharding, op13_whitening

WIDE = "vec_id long, embedding array<float>, label int, n long, place string, block string"


# phrases


def phrases(docs, min_count, longest=5, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, found in counts.items():
        many = {p: a for p, a in found.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in many.items():
            inside = lambda o: any(o[k : k + len(p)] == p for k in range(len(o) - len(p) + 1))  # noqa: B023, E731
            if any(len(o) > len(p) and b >= a and inside(o) for o, b in many.items()):
                continue
            score, _, left, right = min((1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return Counter(out)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


TEXTS = [
    ("A b, c d e.\tf\x1cg é  É", "en"), (None, "en"), ("", None), (" \t", ""), ("x y z x y z x y z", None), ("x y z", "und"), ("x y z", "und"),
    ("New York city. new york\nNEW YORK city\tis", "en"), ("one " * 3000, "fr"), ("a!b?c;d:e", "en"), ("a\x0bb\x0cc\rd", "en"), ("word" * 3000, "fr"),
]


@pytest.mark.parametrize("min_count", [1, 2, 3])
def test_phrases_of_edge_cases(spark, min_count):
    docs = spark.createDataFrame([(t, g, "k", 1) for t, g in TEXTS], "text string, lang string, phrase string, n int").repartition(3)
    assert bag(op11_collocations.collocations(docs, min_count)) == phrases(TEXTS, min_count)


def test_phrases_of_documents(spark, documents, monkeypatch):
    rows = [(r.text, r.lang) for r in documents.select("text", "lang").collect()]
    monkeypatch.setattr(op11_collocations, "BUFFER", 1 << 10)
    monkeypatch.setattr(op11_collocations, "TALLY", 1 << 6)
    assert bag(op11_collocations.collocations(documents, 20)) == phrases(rows, 20)
    assert bag(op11_collocations.collocations(documents, 20, top=3)) == phrases(rows, 20, top=3)


def test_no_documents(nothing):
    assert op11_collocations.collocations(nothing).count() == 0


@pytest.mark.parametrize("capacity", [1, 40, 400, 10**6])
def test_summary_keeps_every_frequent_key(capacity):
    rng = np.random.default_rng(capacity)
    keys = np.concatenate([rng.zipf(1.3, 60_000) % 20_000, np.repeat(np.arange(30_000, 30_040), 100)]).astype(np.uint64)
    rng.shuffle(keys)
    halves = []
    for half in np.array_split(keys, 2):
        summary = op11_collocations.Summary(capacity, 50)
        for part in np.array_split(half, 9):
            summary.add(*np.unique(part, return_counts=True))
        halves.append(summary)
    whole, other = halves
    whole.threshold = 100
    whole.merge(other)
    true = Counter(keys.tolist())
    assert whole.error < 100
    for key, count in zip(whole.keys.tolist(), whole.counts.tolist()):
        assert true[key] - whole.error <= count <= true[key]
    assert {k for k, n in true.items() if n >= 100} <= set(whole.survivors().tolist())


# shards


def check_shards(rows, docs, shards):
    """The law and what every row must carry; returns bytes by shard."""
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    slots, total = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    return total


def test_shards_of_edge_cases(edges, edge_rows, nothing):
    rows = op12_sharding.shard(edges).collect()
    check_shards(rows, edge_rows, 24)
    assert {(r.doc_id, r.shard) for r in rows if r.doc_id is not None} == {(r.doc_id, r.shard) for r in op12_sharding.shard(edges.repartition(7)).collect() if r.doc_id is not None}
    assert op12_sharding.shard(nothing).count() == 0


def test_shards_of_documents_are_of_near_equal_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op12_sharding.shard(docs).collect()
    total = check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 24)
    largest = max(r["size"] for r in rows)
    share = sum(total.values()) / 24
    assert max(abs(t - share) for t in total.values()) <= largest + share / 50


@pytest.mark.parametrize("ids", ["distinct", "equal", "none"])
def test_shards_of_a_hot_text(spark, ids):
    doc_id = {"distinct": F.col("id"), "equal": F.lit(7).cast("long"), "none": F.lit(None).cast("long")}[ids]
    text = F.when(F.col("id") % 3 > 0, F.concat(F.lit("text "), F.col("id"))).when(F.col("id") % 2 == 0, F.lit("copy of one text"))
    docs = spark.range(60_000).select(doc_id.alias("doc_id"), text.alias("text"))
    rows = op12_sharding.shard(docs, 6).collect()
    total = check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 6)
    assert max(total.values()) <= 1.02 * min(total.values())
    if ids == "distinct":
        by_text = defaultdict(set)
        for r in rows:
            by_text[r["text_crc32"]].add(r["shard"])
        assert sum(len(s) > 1 for s in by_text.values()) <= 2, "small groups stay together"


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(op12_sharding, "DRAWS", 0.3)
    monkeypatch.setattr(op12_sharding, "ROWS", 50)
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', if(id % 3 = 0, 0, id)) AS text")
    rows = op12_sharding.records(docs)
    splitters, ranges = op12_sharding.split(rows, 4)
    assert sum(n for _, n, _ in ranges) == 20_000 and max(n for _, n, _ in ranges) <= 50
    total = Counter()
    for size, _, shard in ranges:
        total[shard] += size
    assert max(total.values()) <= 1.02 * min(total.values())
    assert splitters.firsts == sorted(splitters.firsts)


def test_written_shards_hold_all_rows_and_columns(spark, edges, tmp_path):
    op12_sharding.write_shards(edges, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert bag(back.select(edges.columns)) == bag(edges)
    assert back.select("shard").distinct().count() <= 5


# whitening


def check_whitening(df, vectors, components=32):
    keep = [(i, [float(c) for c in v]) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in keep], object)
    n, sums = len(x), x.sum(axis=0)
    rows = df.collect()
    got = [(r["vec_id"], r["deviation"]) for r in rows]
    assert Counter(got) == Counter((i, int(((n * row - sums) ** 2).sum())) for (i, _), row in zip(keep, x))
    y = ((x * n - sums) / n).astype(float)
    values = np.linalg.eigvalsh(y.T @ y / n)[::-1]
    rank = int((values > 1e-12 * values[0]).sum())
    white = np.array([r["whitened"] for r in rows])
    assert white.shape == (n, min(components, rank))
    assert np.allclose(rows[0]["explained"], values[: white.shape[1]] / values.sum(), rtol=1e-9)
    assert np.abs(white.T @ white / n - np.eye(white.shape[1])).max() < 1e-9
    assert abs(rows[0]["identity_error"]) < 1e-9 and {r["n"] for r in rows} == {n}
    # whitened rows are projections of the centred ones: the same signs for all rows, unit directions
    order = {i: k for k, (i, _) in enumerate(keep)}
    if len(order) == n:
        own = y[[order[i] for i, _ in got]]
        back = np.linalg.lstsq(own, white, rcond=None)[0] if rank == own.shape[1] else None
        if back is not None:
            assert np.allclose(np.linalg.norm(back * np.sqrt(values[: white.shape[1]]), axis=0), 1, rtol=1e-8)


def test_whitening_of_embeddings(spark, monkeypatch):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    plain = [(r.vec_id, r.embedding) for r in vectors.collect()]
    monkeypatch.setattr(op13_whitening, "BLOCK_ROWS", 50)
    monkeypatch.setattr(op13_whitening, "SUM_ROWS", 64)
    check_whitening(op13_whitening.whiten(vectors.repartition(9)), plain)
    digest = op13_whitening.op13_whitening(spark, "/root/testdata/sf0.01")
    assert digest.count() == 32 * len(plain) and digest.agg(F.min("component"), F.max("component")).first() == (1, 32)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, 5, "p", "b") for i, v in rows], WIDE).repartition(3)


def test_whitening_of_edge_cases(spark):
    rng = np.random.default_rng(5)
    good = [(k, rng.normal(size=4).tolist()) for k in range(40)]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0, 3.0]), (53, [1.0, float("nan"), 0.0, 0.0]), (54, [float("inf"), 0.0, 0.0, 0.0])]
    check_whitening(op13_whitening.whiten(vectors_of(spark, [*good, *bad])), good)
    twice = [*good, *good, (None, good[0][1])]
    check_whitening(op13_whitening.whiten(vectors_of(spark, twice)), twice)
    odd = [(60, [1.0, 2.0]), (61, [2.0**41, 0.0, 0.0, 0.0])]
    check_whitening(op13_whitening.whiten(vectors_of(spark, [*good, *odd])), good)
    flat = [(i, [v[0], v[0], 3.0, v[1]]) for i, v in good]
    check_whitening(op13_whitening.whiten(vectors_of(spark, flat), 2), flat, 2)
    for none in ([], bad, [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert op13_whitening.whiten(vectors_of(spark, none)).count() == 0


def test_deviation_beyond_64_bits_is_null(spark):
    rows = [(1, [0.0, 2.0**39]), (2, [0.0, 0.0]), (3, [1.0, 0.0])]
    found = {r.vec_id: r.deviation for r in op13_whitening.whiten(vectors_of(spark, rows)).collect()}
    assert found == {1: None, 2: None, 3: None}


@pytest.mark.parametrize("kind", ["even", "graded", "repeated", "clustered", "few"])
def test_bidiagonal_solver(kind):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 40))
    if kind == "graded":
        a = a * 2.0 ** -np.arange(40)
    if kind == "repeated":
        a = np.hstack([a[:, :20]] * 2)
    if kind == "clustered":
        a = np.linalg.qr(a)[0] * (1 + 1e-13 * np.arange(40))
    if kind == "few":
        a = a[:7]
    r = np.zeros((40, 40))
    r[: min(len(a), 40)] = np.linalg.qr(a, mode="r")
    values, vectors = op13_whitening.directions(r, 40)
    k = vectors.shape[1]
    assert k == {"repeated": 20, "few": 7}.get(kind, k) and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-11
    assert np.abs(a.T @ a @ vectors - vectors * values[:-1]).max() < 1e-12 * values[0]
    single = np.linalg.svd(r, compute_uv=False)[:k]
    assert np.allclose(np.sqrt(values[:k]), single, rtol=1e-11 if kind != "graded" else 1e-6)
    assert values[-1] == pytest.approx((a * a).sum(), rel=1e-12)
