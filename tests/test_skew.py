"""Split paths for hot groups give what the plain paths and brute force give."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from veritab.functions.ordered import Ordered
from veritab.functions.tree import tree_roots
from veritab.operators import commitlog, conflicts, digests, versions
from veritab.sources.bindings import Tables

FOLDER = "/root/testdata/sf0.001"


def hot_rows(spark, n=600):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"k{i % 7}", i * 3 % 1000, i, rng.choice([None, i])) for i in range(n)]
    return spark.createDataFrame(data, "k string, ts long, id long, v long").repartition(5)


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ordered_split_equals_plain(spark):
    df = hot_rows(spark)

    def run(limit):
        done = (
            Ordered(df, ["k"], ["ts", "id"], limit).row_number("rn").previous(["id"], "p").fill("v", "f")
            .running_max("id", "m").done()
        )
        return collected(done.select("k", "id", "rn", "p.id", "f", "m"))

    assert run(10) == run(10**6)


def test_tree_layers_equal_fold(spark):
    data = [(f"g{i % 3}" if i % 2 else "hot", f"0x{(i * 7919) % 65536:04x}{i:060x}") for i in range(700)]
    leaves = spark.createDataFrame(data, "g string, leaf string")
    assert collected(tree_roots(leaves, ["g"], 4)) == collected(tree_roots(leaves, ["g"], 10**6))


def test_tree_of_few_leaves(spark):
    for n in (1, 2, 3, 5, 8):
        leaves = spark.createDataFrame([("g", f"0x{i:064x}") for i in range(n)], "g string, leaf string")
        assert collected(tree_roots(leaves, ["g"], 1)) == collected(tree_roots(leaves, ["g"], 100))


def test_commit_replay_split_equals_walk(spark):
    rng = random.Random(11)
    zero, root = commitlog.ZERO_ROOT, "0x" + "1" * 64
    data, versions_by = [], defaultdict(int)
    for seq in range(900):
        key = "hot" if seq % 3 else f"o{seq % 5}"
        guess = versions_by[key] if rng.random() < 0.5 else rng.randrange(6)
        bad = rng.random() < 0.05
        call = "register" if guess == 0 else "update"
        data.append((key, seq, call, guess or None, zero if bad else root, root))
        if not bad and guess == versions_by[key]:
            versions_by[key] += 1
    calls = spark.createDataFrame(
        data, "object_id string, seq long, call string, expected_version long, object_root string, evidence_root string"
    )
    split = commitlog.commitment_outcomes(calls, limit=20)
    assert collected(split) == collected(commitlog.commitment_outcomes(calls))
    final = {r["object_id"]: r["version"] for r in commitlog.commitment_fold(split).collect()}
    assert final == {k: v for k, v in versions_by.items() if v}


CLAIM = (
    "subject string, property string, claim_id string, value_kind string, value_num double, value_str string, "
    "value_json string, evidence_refs array<string>"
)


def test_conflict_rows_cover_every_pair(spark):
    """Rows of (claim, cause) equal those of all pairs, with a witness that is a pair; no claim is left out."""
    rng = random.Random(3)
    kinds = [("number", 1.0), ("number", 1.00005), ("number", 2.5), ("string", "A"), ("string", " a "), ("boolean", "true")]
    claims, evidence = [], []
    for i in range(260):
        kind, value = rng.choice(kinds)
        prop = rng.choice(["nav", "shareClass", "issuer"])
        refs = [] if i % 5 == 0 else [f"e{i}"]
        claims.append((
            "s" if i % 3 else f"t{i % 4}", prop, f"c{i:03d}", kind, value if kind == "number" else None,
            value if kind == "string" else None, f'"{value}"', refs,
        ))
        evidence.append((f"e{i}", rng.choice(["STALE", "FRESH", None]), rng.choice(["PRIMARY_SOURCE", "DERIVED"])))
    sides = {e[0]: (e[1] == "STALE", e[2]) for e in evidence}

    def form(c):
        return c[3] if c[3] in ("number", "string") else "other"

    def differ(a, b):
        if form(a) != form(b):
            return True
        if a[3] == "number":
            return abs(a[4] - b[4]) > 0.0001
        return (a[5] or a[6]).strip().lower() != (b[5] or b[6]).strip().lower()

    def cause(a, b):
        one, two = (sides[c[7][0]] if c[7] else (False, None) for c in (a, b))
        if one[0] or two[0]:
            return "STALE_SOURCE"
        if a[1] in ("shareClass", "issuer"):
            return "SHARE_CLASS_MISMATCH" if a[1] == "shareClass" else "REPRESENTATION_MISMATCH"
        return "EFFECTIVE_DATE_MISMATCH" if one[1] == two[1] else "UNKNOWN_AUTHORITY"

    pairs = {(a[2], b[2]): cause(a, b) for a in claims for b in claims if a is not b and a[:2] == b[:2] and differ(a, b)}
    rows = conflicts.conflicts(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(evidence, "evidence_id string, freshness string, authority string")).collect()
    assert {(r["claim_id"], r["likely_cause"]) for r in rows} == {(a, why) for (a, _), why in pairs.items()}
    assert all(pairs[r["claim_id"], r["witness"]] == r["likely_cause"] for r in rows)
    assert len(rows) == len({r["conflict_id"] for r in rows})


def test_conflicts_have_one_shape_at_every_size(spark):
    for size in (2, 64, 65, 300):
        claims = [("s", "nav", f"c{i:03d}", "number", float(i), None, str(i), [f"e{i % 7}"]) for i in range(size)]
        evidence = spark.createDataFrame([(f"e{i}", "FRESH", f"authority {i}") for i in range(7)], "evidence_id string, freshness string, authority string")
        df = spark.createDataFrame(claims, CLAIM)
        assert {r["claim_id"] for r in conflicts.conflicts(df, evidence).collect()} == {c[2] for c in claims}
        assert conflicts.claims_in_conflict(df).count() == size


def test_crowded_groups_of_claims_give_the_same_conflicts(spark):
    rng = random.Random(8)
    claims = [
        (rng.choice(["s", "t", None]), rng.choice(["nav", "shareClass"]), f"c{i % 70:03d}", rng.choice(["number", "string"]), rng.choice([None, 1.0, 2.0]),
         rng.choice(["a", " A", "b"]), "x", rng.choice([[], [f"e{i % 7}"]]))
        for i in range(90)
    ]
    claims.append(("alone", "nav", "c0", "number", 1.0, None, "1", []))
    claims += [("unnamed", "nav", name, "number", value, None, "1", []) for name, value in ((None, 1.0), ("c1", 2.0))]
    df = spark.createDataFrame(claims, CLAIM)
    evidence = spark.createDataFrame([(f"e{i}", "STALE" if i == 2 else "FRESH", f"authority {i}") for i in range(6)], "evidence_id string, freshness string, authority string")
    whole, split = (collected(conflicts.conflict_profile(df, evidence, limit=limit)) for limit in (1000, 2))
    assert whole and whole == split
    assert collected(conflicts.conflict_profile(df, evidence, refs=False)) == collected(conflicts.conflict_profile(df, evidence).drop("evidence_refs", "witness_refs"))
    assert collected(conflicts.claims_in_conflict(df)) == collected(conflicts.claims_in_conflict(df, limit=2))
    # a claim without an id is no witness
    assert [r[2] for r in whole if r[0] == "unnamed"] == [None]
    assert conflicts._shared(df, 1000)[0].filter("subject = 'alone'").count() == 0


def test_sections_follow_id_order(spark):
    items = spark.range(20_500).selectExpr("'o' AS object_id", "'claims' AS collection", "lpad(cast(id AS string), 6, '0') AS item_id", "'{}' AS json")
    rows = sorted(digests.assemble_sections(items).selectExpr("section", "size(items) AS n", "items[0].item_id AS first").collect())
    assert [tuple(r) for r in rows] == [(0, 10_000, "000000"), (1, 10_000, "010000"), (2, 500, "020000")]


def test_watch_steps_split_equals_plain(spark):
    changes = Tables(spark, FOLDER).changes.withColumn("object_id", F.when(F.col("seq") % 3 == 0, "hot").otherwise(F.col("object_id")))
    assert collected(versions.watch_steps(changes, limit=50)) == collected(versions.watch_steps(changes))


def test_publisher_filter_split_equals_plain(spark):
    t = Tables(spark, FOLDER)
    split = commitlog.publisher_filter(t.commit_calls, t.roles, t.pauses, limit=50)
    assert collected(split) == collected(commitlog.publisher_filter(t.commit_calls, t.roles, t.pauses))


def test_results_do_not_depend_on_partitioning(spark):
    t = Tables(spark, FOLDER)
    first = collected(digests.evidence_roots(t.objects, t.evidence))
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        again = collected(digests.evidence_roots(t.objects, t.evidence.orderBy(F.rand(1)).repartition(13)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first == again
