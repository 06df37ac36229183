"""Every stage of the pipeline against a plain version, on its own input."""

import pytest

import corpus_pipeline
from tests.llm import brute
from veritab.llm.op9_quality import mark_quality

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [[r.asDict() for r in d.collect()] for d in out]


def pairs(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_columns(steps):
    assert all(set(r) == set(steps[0][0]) for rows in steps[:5] for r in rows)


def test_quality(spark, steps):
    failed = {row[0] for row in brute.quality(pairs(steps[0])) if row[6]}
    kept = {r["doc_id"] for r in steps[1]}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert kept == {r.doc_id for r in mark_quality(docs).collect() if r["__kept"]} and not kept & failed


def test_lines(steps):
    expected = {(row[0], row[3]) for row in brute.common_lines(pairs(steps[1]))}
    assert {(r["doc_id"], brute.sha(r["text"])) for r in steps[2]} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2] if r["text"] not in dict(pairs(steps[1])).values())


def test_near_copies(steps):
    before = sorted(pairs(steps[2]))
    kept = {r["doc_id"] for r in steps[3]}
    loose = brute.groups([t for _, t in before], lambda a, b: brute.jaccard(a, b) >= 0.6)
    tight = brute.groups([t for _, t in before], lambda a, b: brute.jaccard(a, b) >= 0.9)
    assert {before[r][0] for r in loose} <= kept, "documents unlike all others stay"
    assert kept <= {before[r][0] for r in tight}, "of close copies one stays"


def test_leaks(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hit = {row[0] for row in brute.contained(pairs(steps[3]), items)}
    assert {r["doc_id"] for r in steps[4]} == {i for i, _ in pairs(steps[3])} - hit


def test_mixture(steps):
    total = sum(len(brute.words(t)) for _, t in pairs(steps[4]))
    rows = steps[5]
    largest = max(r["size"] for r in rows)
    assert all(r["taken"] > 0 for r in rows) and {r["doc_id"] for r in rows} <= {i for i, _ in pairs(steps[4])}
    assert total - largest < sum(r["taken"] for r in rows) <= total
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * largest


def test_run(spark, steps):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(r["doc_id"] for r in steps[5])
