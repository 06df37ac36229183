import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, chunk string, bucket int, kept string"


def prose(seed, count):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(count))


def build():
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies, shared passages and lines."""
    base, passage, line = prose(1, 220), prose(2, 90), "A shared line of text"
    near = base.split()
    near[100] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, base.upper()), (5, prose(5, 300) + " " + passage + " " + prose(6, 50)),
        (6, prose(7, 40) + " " + passage + " " + prose(8, 40)), (7, passage), (7, passage), (8, None), (9, ""), (10, " \t\n\x0b "),
        (11, "one"), (12, "a\x0bb\x0cc\rd\te"), (13, "\n\n"), (14, prose(9, 30_000)), (15, "x " * 4000), (16, "é ü ß   Ä"),
        (17, "word" * 5000), (None, base), (None, None), (18, "A B C"), (19, "a b c"), (20, prose(10, 25) + "%%% " * 30),
    ]
    rows += [(30 + k, f"{prose(30 + k, 60)}\n  {line.upper() if k % 2 else line}\t\n{prose(60 + k, 30)}") for k in range(12)]
    rows += [(50 + k, f"{prose(50 + k, 60)}\nnine times\n") for k in range(9)]
    sources = ["a", "b", None, "", "é", "a", "a"]
    return [(i, t, "en", sources[k % 7], len(t or ""), -1, "c", 3, "k") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def edge_rows():
    return [(r[0], r[1]) for r in build()]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(build(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
