"""Rule branches and precedence steps on hand-made rows."""

import os

import pytest
from pyspark.sql import functions as F

from veritab import session
from veritab.functions.canonical import canonical
from veritab.operators import (
    conflicts, digests, extract, ingest, lineage, mandates, promote, relate, status, verify, versions,
)
from veritab.sources.store import SEMANTIC_CASE, read_json, save_versions
from veritab.streaming import feeds

NOW = 1_700_000_100_000
HASH = "0x" + "1" * 64
CLAIM = (
    "object_id string, claim_id string, property string, state string, source_refs array<string>, "
    "evidence_refs array<string>, attestation_refs array<string>"
)
EVIDENCE = (
    "object_id string, evidence_id string, type string, source string, content_hash string, locator string, observed_at long, "
    "fetched_at long, authority string, freshness string, metadata_json string"
)
ATTESTATION = "object_id string, attestation_id string, state string, expires_at long, attestor string, signature string"


def claim(cid, state="SOURCED", evidence=("e1",), attestations=(), sources=("s1",), prop="nav", obj="o"):
    return (obj, cid, prop, state, list(sources), list(evidence), list(attestations))


def piece(eid, freshness="FRESH", authority="PRIMARY_SOURCE", observed=NOW - 1000, source="s1", content=HASH, obj="o", kind="API_RESPONSE"):
    return (obj, eid, kind, source, content, None, observed, observed, authority, freshness, "{}")


def kinds(df):
    return sorted((r["claim_id"], r["check_type"], r["result"]) for r in df.collect())


def test_claim_and_evidence_checks(rows):
    claims = rows(
        CLAIM, claim("a", "REVOKED"), claim("b", "INFERRED"), claim("c", "CONFLICTING"), claim("d", evidence=(), attestations=("gone",)),
        claim("f", evidence=("lost",)), claim("g", evidence=("old",)), claim("h", evidence=("ai",)), claim("i", evidence=("stale",)),
    )
    evidence = rows(
        EVIDENCE, piece("e1"), piece("old", observed=NOW - 20_000), piece("ai", authority="AI_INFERENCE", freshness=None), piece("stale", "STALE"),
    )
    found = kinds(verify.verify_claims(claims, evidence, rows(ATTESTATION, ("o", "x", "ACTIVE", None, "0xA", "0x")), NOW, 10_000))
    assert found == sorted([
        ("a", "CLAIM_STATE", "FAIL"), ("a", "EVIDENCE_AVAILABLE", "PASS"),
        ("b", "INFERENCE_BOUNDARY", "UNRESOLVED"), ("b", "EVIDENCE_AVAILABLE", "PASS"),
        ("c", "EVIDENCE_CONFLICT", "FAIL"), ("c", "EVIDENCE_AVAILABLE", "PASS"),
        ("d", "EVIDENCE_PRESENCE", "FAIL"), ("f", "EVIDENCE_REFERENCE", "FAIL"), ("g", "FRESHNESS", "FAIL"),
        ("h", "AUTHORITY_BOUNDARY", "UNRESOLVED"), ("h", "EVIDENCE_AVAILABLE", "PASS"), ("i", "FRESHNESS", "FAIL"),
    ])


def test_age_equal_to_the_limit_is_still_fresh(rows):
    claims, evidence = rows(CLAIM, claim("a")), rows(EVIDENCE, piece("e1", observed=NOW - 10_000))
    assert kinds(verify.check_freshness(claims, evidence, NOW, 10_000)) == [("a", "EVIDENCE_AVAILABLE", "PASS")]


def test_attestation_rules_in_order(rows):
    good = "0x" + "a" * 130
    names = ["revoked", "listed", "expired", "never", "stranger", "bad", "good", "shaped", "odd"]
    data = [
        ("o", "revoked", "REVOKED", NOW - 1, "0xA", good), ("o", "listed", "ACTIVE", None, "0xA", good),
        ("o", "expired", "ACTIVE", NOW - 1, "0xA", good), ("o", "never", "ACTIVE", 0, "0xA", good),
        ("o", "stranger", "ACTIVE", None, "0xB", good), ("o", "bad", "ACTIVE", None, "0xa", "sig-bad"),
        ("o", "good", "ACTIVE", None, "0xa", "sig-good"), ("o", "shaped", "ACTIVE", NOW, "0xA", good), ("o", "odd", "ACTIVE", None, "0xA", "0x12"),
    ]
    claims = rows(CLAIM, claim("c", attestations=[*names, "missing"]))
    checks = verify.check_attestations(
        claims, rows(ATTESTATION, *data), NOW, attestors=rows("attestor string", ("0xa",)),
        valid_signatures=rows("signature string", ("sig-good",)), invalid_signatures=rows("signature string", ("sig-bad",)),
        revoked=rows("attestation_id string", ("listed",)),
    )
    got = {r["ref"]: (r["check_type"].removeprefix("ATTESTATION_"), r["result"]) for r in checks.collect()}
    assert got == {
        "revoked": ("REVOCATION", "FAIL"), "listed": ("REVOCATION", "FAIL"), "expired": ("EXPIRY", "FAIL"), "never": ("VALID", "PASS"),
        "stranger": ("ATTESTOR_AUTHORITY", "FAIL"), "bad": ("SIGNATURE", "FAIL"), "good": ("SIGNATURE", "PASS"),
        "shaped": ("VALID", "PASS"), "odd": ("SIGNATURE", "FAIL"), "missing": ("PRESENCE", "FAIL"),
    }


SNAPSHOT = (
    "snapshot_id string, source_id string, content_hash string, http_status int, body_storage_ref string, fetched_at long, "
    "observed_at long, max_age_ms long"
)


def test_ingest_gate_order(rows):
    data = rows(
        SNAPSHOT, ("http", "s", "0x", 503, "", NOW, NOW, None), ("hash", "s", "0x", 200, "", NOW, NOW, None),
        ("body", "s", HASH, None, " \t", NOW + 1, NOW, None), ("time", "s", HASH, 200, "b", NOW + 1, NOW, None),
        ("old", "s", HASH, 200, "b", NOW, NOW - 100_000, 10_000), ("edge", "s", HASH, 200, "b", NOW, NOW - 10_000, 10_000),
        ("free", "s", HASH, 399, "b", NOW, 0, None),
    )
    got = {r["snapshot_id"]: (r["status"], r["reason_code"]) for r in ingest.ingest_gate(data, NOW).collect()}
    assert got == {
        "http": ("SOURCE_FAILURE", "HTTP_FAILURE"), "hash": ("SOURCE_FAILURE", "MISSING_CONTENT_HASH"),
        "body": ("SOURCE_FAILURE", "MISSING_BODY_STORAGE_REF"), "time": ("SOURCE_FAILURE", "INVALID_FETCH_TIME"),
        "old": ("STALE", None), "edge": ("INGESTED", None), "free": ("INGESTED", None),
    }


def test_status_precedence(rows):
    objects = rows("object_id string, version int", *[(o, 1) for o in "abcdefg"])
    claims = rows(
        "object_id string, state string", ("a", "REVOKED"), ("a", "STALE"), ("b", "CONFLICTING"), ("c", "STALE"), ("e", "UNKNOWN"), ("f", "SOURCED"),
    )
    exceptions = rows("object_id string, type string, status string", ("b", "EVIDENCE_STALE", "OPEN"), ("d", "EVIDENCE_MISSING", "WAIVED"),
                      ("e", "POLICY_AMBIGUOUS", "OPEN"))
    got = {r["object_id"]: r["status"] for r in status.object_status(objects, claims, exceptions).collect()}
    assert got == {
        "a": "REVOKED", "b": "CONFLICTING", "c": "STALE", "d": "INSUFFICIENT_EVIDENCE", "e": "PARTIALLY_RESOLVED", "f": "RESOLVED", "g": "RESOLVED",
    }
    kept = {r["object_id"]: r["status"] for r in status.object_status(objects, claims, exceptions, open_only=True).collect()}
    assert kept["d"] == "RESOLVED"


def test_stale_evidence_comes_before_revoked_claims(rows):
    objects = rows("object_id string, version int", ("o", 1))
    claims, evidence = rows(CLAIM, claim("c", "REVOKED")), rows(EVIDENCE, piece("e1", "STALE"), piece("e2", "STALE"))
    none = rows("object_id string, type string", ("other", "EVIDENCE_STALE"))
    states = status.evidence_state(objects, evidence, claims, none)
    assert states.first().asDict() == {"object_id": "o", "version": 1, "status": "STALE", "first_stale": "e1", "raises_exception": True}
    assert [r["claim_id"] for r in status.stale_exceptions(states, claims, NOW).collect()] == ["c"]


def decided(rows, overall="PASS", state="RESOLVED", primary="T", allowed=(), prohibited=(), expires=None, claims=None, required=(), needed=()):
    objects = rows("object_id string, version int, primary_class string, secondary array<string>, claim_ref string", ("o", 1, primary, ["S"], "cls"))
    assignments = rows("object_id string, version int, mandate_id string, mandate_version int", ("o", 1, "m", 1))
    terms = rows(
        "mandate_id string, version int, allowed array<string>, prohibited array<string>, expires_at long",
        ("m", 1, list(allowed), list(prohibited), expires),
    )
    cases = mandates.policy_cases(
        objects, assignments, terms, rows("object_id string, version int, status string", ("o", 1, state)),
        rows("object_id string, version int, overall_status string", ("o", 1, overall)),
    )
    must = rows("mandate_id string, version int, ord int, property string, required_state string", ("none", 1, 1, "x", "x"), *required)
    have = rows("mandate_id string, version int, ord int, type string, max_age_ms long", ("none", 1, 1, "x", 1), *needed)
    checks = mandates.policy_checks(
        cases, assignments, must, have, claims or rows(CLAIM, claim("c1")), rows(EVIDENCE, piece("e1"), piece("e2", observed=NOW - 10_000)), NOW
    )
    row = mandates.decision_receipts(checks, NOW).first()
    return row["decision"], row["reason_codes"], row["supporting_claims"]


def test_decisions(rows):
    assert decided(rows) == ("ALLOW", ["MANDATE_ACTIVE", "VERIFICATION_PASSED", "OBJECT_RESOLVED", "NOT_PROHIBITED"], [])
    assert decided(rows, overall="UNRESOLVED")[0] == "CONDITIONAL"
    assert decided(rows, state="STALE")[1][2] == "OBJECT_STATUS_STALE"
    assert decided(rows, state="UNSUPPORTED")[1][2] == "OBJECT_RESOLVED"
    assert decided(rows, expires=0)[0] == "BLOCK"
    assert decided(rows, expires=NOW)[0] == "ALLOW"
    assert decided(rows, prohibited=["T"])[1][3] == "PROHIBITED_ASSET_CLASS"
    assert decided(rows, allowed=["S"])[2] == ["cls"]
    assert decided(rows, allowed=["X"])[0] == "BLOCK"


def test_required_claims_and_evidence(rows):
    assert decided(rows, required=[("m", 1, 1, "nav", "SOURCED")]) == (
        "ALLOW", ["MANDATE_ACTIVE", "VERIFICATION_PASSED", "OBJECT_RESOLVED", "NOT_PROHIBITED", "REQUIRED_CLAIM_NAV_SATISFIED"], ["c1"]
    )
    verified = rows(CLAIM, claim("c1", "VERIFIED"))
    assert decided(rows, claims=verified, required=[("m", 1, 1, "nav", "SOURCED")])[0] == "BLOCK"
    inferred = rows(CLAIM, claim("c1", "INFERRED"))
    assert decided(rows, claims=inferred, required=[("m", 1, 1, "nav", "SOURCED")])[0] == "CONDITIONAL"
    assert decided(rows, required=[("m", 1, 1, "issuer", "SOURCED")])[1][-1] == "MISSING_REQUIRED_CLAIM_ISSUER"
    assert decided(rows, needed=[("m", 1, 1, "API_RESPONSE", 10_000)])[0] == "ALLOW"
    assert decided(rows, needed=[("m", 1, 1, "API_RESPONSE", 9_999)])[1][-1] == "EVIDENCE_AGE_EXCEEDED_API_RESPONSE"
    assert decided(rows, needed=[("m", 1, 1, "FILING", None)])[1][-1] == "MISSING_REQUIRED_EVIDENCE_FILING"


def test_every_assignment_is_decided_under_its_own_mandate_version(rows):
    objects = rows("object_id string, version int, primary_class string, secondary array<string>, claim_ref string", ("o", 1, "T", ["S"], "cls"))
    pairs = [("o", 1, "m", 1), ("o", 1, "m", 2), ("o", 2, "m", 2), ("o", 1, "m", 3), ("o", 1, "none", 1), ("gone", 1, "none", 1)]
    assignments = rows("object_id string, version int, mandate_id string, mandate_version int", *pairs)
    terms = rows(
        "mandate_id string, version int, allowed array<string>, prohibited array<string>, expires_at long",
        ("m", 1, [], ["T"], None), ("m", 2, [], [], None),
    )
    cases = mandates.policy_cases(
        objects, assignments, terms, rows("object_id string, version int, status string", ("o", 1, "RESOLVED")),
        rows("object_id string, version int, overall_status string", ("o", 1, "PASS")),
    )
    must = rows("mandate_id string, version int, ord int, property string, required_state string", ("m", 1, 1, "nav", "VERIFIED"), ("m", 2, 1, "nav", "SOURCED"))
    have = rows("mandate_id string, version int, ord int, type string, max_age_ms long", ("x", 1, 1, "x", 1))
    checks = mandates.policy_checks(cases, assignments, must, have, rows(CLAIM, claim("c1")), rows(EVIDENCE, piece("e1")), NOW)
    got = {tuple(r[k] for k in mandates.KEYS): r for r in mandates.decision_receipts(checks, NOW).collect()}
    assert set(got) == set(pairs)
    assert {k: got[k]["decision"] for k in pairs} == {p: "ALLOW" if p == ("o", 1, "m", 2) else "BLOCK" for p in pairs}
    assert "PROHIBITED_ASSET_CLASS" in got["o", 1, "m", 1]["reason_codes"] and "OBJECT_NOT_FOUND" in got["o", 2, "m", 2]["reason_codes"]
    assert got["gone", 1, "none", 1]["reason_codes"] == ["MANDATE_NOT_FOUND", "VERIFICATION_NOT_FOUND", "OBJECT_NOT_FOUND"]
    assert len({r["decision_id"] for r in got.values()}) == len(pairs)

    def bare(status, overall):
        judged = mandates.policy_cases(
            objects, assignments.filter("version = 1 AND mandate_version = 2"), terms,
            rows("object_id string, version int, status string", (status, 1, "RESOLVED")),
            rows("object_id string, version int, overall_status string", (overall, 1, "PASS")),
        )
        policy = mandates.policy_checks(judged, assignments.limit(0), must, have, rows(CLAIM, claim("c1")), rows(EVIDENCE, piece("e1")), NOW)
        return mandates.decisions(policy).first()["decision"]

    assert (bare("o", "o"), bare("x", "o"), bare("o", "x")) == ("ALLOW", "BLOCK", "BLOCK")


SNAPSHOTS = "snapshot_id string, source_id string, content_hash string"


def test_strict_lineage(rows):
    claims = rows(CLAIM, claim("a"), claim("b", evidence=("lost",)), claim("c", evidence=()), claim("d", "INFERRED", evidence=()),
                  claim("f", evidence=("e2",), sources=("other",)))
    evidence = rows(EVIDENCE, piece("e1"), piece("e2", source="s2", content="0x" + "2" * 64))
    edges = rows("object_id string, edge_id string, from_ref string, to_ref string", ("o", "x", "a", "e1"))
    issues = lineage.lineage_issues(claims, evidence, rows(SNAPSHOTS, ("s1", "src", HASH), ("s2", "src", HASH)), edges)
    assert sorted((r["claim_id"], r["code"]) for r in issues.collect()) == [
        ("b", "EVIDENCE_REFERENCE_MISSING"), ("c", "CLAIM_EVIDENCE_MISSING"), ("f", "CLAIM_SOURCE_REFERENCE_MISMATCH"),
        ("f", "PROVENANCE_EDGE_MISSING"), ("f", "SOURCE_CONTENT_HASH_MISMATCH"),
    ]


def test_loose_lineage_status(rows):
    claims = rows(
        CLAIM, claim("ok"), claim("stale", evidence=("e2",), attestations=("att",)), claim("broken", evidence=("lost",)),
        claim("part", evidence=("e1", "lost")), claim("bare", evidence=(), sources=()), claim("gone", "REVOKED"), claim("group", evidence=("e3",)),
    )
    evidence = rows(EVIDENCE, piece("e1"), piece("e2", "STALE"), piece("e3", source="src"))
    traces = lineage.lineage_trace(
        claims, evidence, rows(SNAPSHOTS, ("s1", "src", HASH)), rows("object_id string, attestation_id string, state string", ("o", "att", "REVOKED"))
    )
    got = {r["claim_id"]: (r["status"], r["errors"]) for r in traces.collect()}
    assert got == {
        "ok": ("COMPLETE", 0), "stale": ("STALE", 1), "broken": ("BROKEN", 1), "part": ("PARTIAL", 1), "bare": ("INFERRED_ONLY", 0),
        "gone": ("REVOKED", 0), "group": ("COMPLETE", 0),
    }


def test_evidence_root_ignores_order_and_sees_tampering(rows):
    objects = rows("object_id string, version int", ("o", 1), ("empty", 1))
    pieces = [piece(f"e{i}") for i in range(5)]

    def root(*data):
        return {r["object_id"]: r["evidence_root"] for r in digests.evidence_roots(objects, rows(EVIDENCE, *data)).collect()}

    assert root(*pieces) == root(*reversed(pieces))
    assert root(*pieces)["o"] != root(*pieces[:-1], piece("e4", content="0x" + "3" * 64))["o"]
    assert root(*pieces)["empty"] != root(*pieces)["o"]


def test_canonical_json(rows):
    texts = rows("t string", ('{"b": 1.0, "a": [true, null, "x"], "c": {"z": 1, "y": 2}}',))
    assert texts.select(canonical(F.col("t"))).first()[0] == '{"a":[true,null,"x"],"b":1,"c":{"y":2,"z":1}}'


PROPOSED = "id string, source_refs array<string>, evidence_refs array<string>"


def test_promotion(rows):
    proposed = rows(PROPOSED, ("bare", [], ["e1"]), ("nosource", ["s1", "gone"], ["e1"]), ("noevidence", ["s1"], ["lost"]),
                    ("stale", ["s1"], ["e2"]), ("good", ["s1"], ["e1"]), ("weak", ["s1"], ["e3"]))
    evidence = rows(EVIDENCE, piece("e1"), piece("e2", "STALE"), piece("e3", authority="MARKET_DATA"))
    got = {r["id"]: r["outcome"] for r in promote.promote_claims(proposed, rows(SNAPSHOTS, ("s1", "src", HASH)), evidence).collect()}
    assert got == {
        "bare": "REJECT_UNSUPPORTED", "nosource": "REJECT_UNSUPPORTED", "noevidence": "REJECT_UNSUPPORTED", "stale": "REQUIRE_REVIEW",
        "good": "ACCEPT_AS_CANDIDATE", "weak": "ACCEPT_AS_INFERRED",
    }


def test_gate(rows):
    schema = (
        "total_cases long, passed_cases long, claim_accuracy double, rights_accuracy double, relationship_accuracy double, conflict_recall double, "
        "unsupported_inference_rate double, false_equivalence_rate double, false_allow_rate double"
    )

    def gate(*row):
        return promote.promotion_gate(rows(schema, row)).first()["status"]

    assert gate(22, 22, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0) == "PASS"
    assert gate(22, 21, 0.9, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0) == "FAIL"
    assert gate(22, 21, 1.0, 1.0, 1.0, 1.0, 0.0, 0.2, 0.0) == "REDESIGN_REQUIRED"
    assert gate(0, 0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0) == "PASS"


def test_nav_conflict_with_a_stale_source(rows):
    schema = "subject string, property string, claim_id string, value_kind string, value_num double, value_str string, value_json string, evidence_refs array<string>"
    claims = rows(schema, ("s", "nav", "c1", "number", 105.5, None, "105.5", ["e1"]), ("s", "nav", "c2", "number", 100.0, None, "100", ["e2"]),
                  ("s", "name", "c3", "string", None, "Fund ", '"Fund "', ["e1"]), ("s", "name", "c4", "string", None, " fund", '" fund"', ["e2"]))
    evidence = rows("evidence_id string, freshness string, authority string", ("e1", "FRESH", "PRIMARY_SOURCE"), ("e2", "STALE", "PRIMARY_SOURCE"))
    got = sorted((r["claim_id"], r["witness"], r["likely_cause"], r["evidence_refs"]) for r in conflicts.conflicts(claims, evidence).collect())
    assert got == [("c1", "c2", "STALE_SOURCE", ["e1", "e2"]), ("c2", "c1", "STALE_SOURCE", ["e1", "e2"])]


def test_extraction_from_objects_and_prose(rows):
    bodies = rows(
        "subject string, snapshot_id string, evidence_id string, body string",
        ("s", "json", "e", '{"fundName":"F","cusip":"123456789","nav":"105.42","yield":5.12,"redemption":{"frequency":"weekly"},"transferable":false}'),
        ("s", "text", "e", "Net Asset Value: $105.42 USD. ISIN: US0378331005. Class B. Share Class: Retail"), ("s", "list", "e", "[1]"), ("s", "none", "e", ""),
    )
    got = {(r["snapshot_id"], r["property"]): (r["value_str"], r["value_num"]) for r in extract.extract_claims(bodies).collect()}
    assert got == {
        ("json", "economicIdentity"): ("F", None), ("json", "cusip"): ("123456789", None), ("json", "nav"): (None, 105.42), ("json", "yieldBps"): (None, 512.0),
        ("text", "nav"): (None, 105.42), ("text", "isin"): ("US0378331005", None), ("text", "shareClass"): ("retail", None),
    }
    terms = {r["type"]: (r["terms"], r["transferability"]) for r in extract.extract_terms(bodies).collect()}
    assert terms["REDEMPTION"] == ("Redemption window: weekly", "RESTRICTED")
    assert terms["INCOME"][1] == "RESTRICTED"


def test_semantic_fixtures(spark, rows):
    folder = os.path.join(os.path.dirname(__file__), "fixtures")
    cases = read_json(spark, f"{folder}/*.json", SEMANTIC_CASE)
    flat = cases.select(F.explode("representations").alias("r")).select(
        "r.id", "r.parent", "r.relationship", F.col("r.shareClass").alias("share_class"), *[F.lit(None).cast("string").alias(c) for c in ("issuer", "redemption_terms")]
    )
    pairs = cases.select(F.col("representations")[0]["id"].alias("a_id"), F.col("representations")[1]["id"].alias("b_id"))
    got = {r["a_id"]: r["relationship"] for r in relate.semantic_compare(relate.representation_pairs(pairs, flat)).collect()}
    assert got == {"rep:1": "ECONOMICALLY_EQUIVALENT_TO", "rep:3": "SIMILAR_EXPOSURE_TO"}


def test_version_store_is_append_only(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    batch = rows("object_id string, version int, seq string, root string", ("o", 1, "a", "r1"), ("o", 1, "b", "r1"), ("o", 1, "c", "r2"))
    payload = batch.select("object_id", "version", "seq", F.lit("body").alias("payload"))

    def save(df):
        return sorted((r["seq"], r["outcome"]) for r in save_versions(spark, path, df, payload).collect())

    save_versions(spark, path, batch, payload)
    assert spark.read.parquet(path).count() == 1
    later = rows("object_id string, version int, seq string, root string", ("o", 1, "d", "r9"), ("o", 1, "e", "r1"))
    assert save(later) == [("d", "VIOLATION"), ("e", "UNCHANGED")]
    assert spark.read.parquet(path).count() == 1


def test_watch_stream_over_many_batches_equals_batch(spark, tmp_path):
    from veritab.sources.bindings import Tables

    changes = Tables(spark, "/root/testdata/sf0.001").changes.drop("ts")
    feed = str(tmp_path / "feed")
    ordered = changes.orderBy("ts_ms", "seq").withColumn("n", F.monotonically_increasing_id()).coalesce(1)
    for part in range(3):
        lo, hi = part * 400, (part + 1) * 400 if part < 2 else 10**9
        ordered.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).drop("n").coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    out, state, mark = (str(tmp_path / n) for n in ("out", "state", "mark"))
    feeds.watch_stream(stream, out, state, mark).awaitTermination()
    assert len(os.listdir(out)) >= 3
    got = sorted(map(tuple, spark.read.parquet(out).drop("batch").collect()), key=str)
    assert got == sorted(map(tuple, versions.watch_steps(changes).collect()), key=str)


def test_outbox_writes_each_id_once_over_replays(spark, tmp_path):
    from veritab.sources.bindings import Tables

    steps = versions.watch_steps(Tables(spark, "/root/testdata/sf0.001").changes.drop("ts"))
    feed, out, mark = (str(tmp_path / n) for n in ("steps", "outbox", "mark"))
    steps.coalesce(1).write.parquet(feed)
    steps.coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    feeds.outbox_sink(stream, out, mark).awaitTermination()
    written = spark.read.parquet(out)
    assert written.count() == written.select("outbox_id").distinct().count() == 2 * steps.count()


def test_late_and_replayed_events_over_micro_batches(spark, tmp_path):
    source, out, mark = (str(tmp_path / name) for name in ("in", "out", "mark"))
    schema = "event_id string, event_time timestamp"
    sent = [
        [("a", "2024-01-01 12:00:00"), ("b", "2024-01-01 12:00:00"), ("a", "2024-01-01 12:00:00")],
        [("c", "2024-01-02 20:00:00"), ("b", "2024-01-01 12:00:00")],
        [("d", "2024-01-01 05:00:00"), ("e", None), ("c", "2024-01-02 20:00:00")],
        [("e", None), ("d", "2024-01-01 05:00:00")],
    ]
    for batch in sent:
        rows = spark.createDataFrame(batch, "event_id string, t string").selectExpr("event_id", "cast(t as timestamp) AS event_time")
        rows.coalesce(1).write.mode("append").parquet(source)
        feeds.dedupe_replay(spark.readStream.schema(schema).parquet(source), out, mark).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d", "e"]


def test_freshness_stream_counts_late_rows(spark, tmp_path):
    source, out, mark = (str(tmp_path / name) for name in ("in", "out", "mark"))
    schema = "event_time timestamp, source string, stale boolean, failed boolean"
    for when in ("2024-01-05 10:10:00", "2024-01-01 10:20:00", "2024-01-05 10:40:00"):
        rows = spark.sql(f"SELECT timestamp'{when}' AS event_time, 's' AS source, true AS stale, false AS failed")
        rows.write.mode("append").parquet(source)
        feeds.freshness_stream(spark.readStream.schema(schema).parquet(source), out, mark).awaitTermination()
    everything = feeds.freshness_windows(spark.read.parquet(source))
    assert sorted(feeds.read_freshness(spark, out).collect()) == sorted(everything.collect())


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_every_proposed_field_changes_the_proposal_hash(rows):
    claim = {"proposal_id": "p", "id": "c", "subject": "s", "property": "nav", "value_json": "1", "unit": "USD", "confidence": 0.1, "is_direct": True,
             "source_refs": ["x"], "evidence_refs": ["e"]}
    relation = {"proposal_id": "p", "relationship_id": "r", "subject": "s", "predicate": "BACKED_BY", "object": "o", "confidence": 0.5, "is_equivalent": False,
                "state": "SOURCED", "evidence_refs": ["e"]}
    draft = {"proposal_id": "p", "id": "d", "subject": "s", "holder_type": "OWNER", "right_type": "INCOME", "terms": "t", "transferability": "LOCKED",
             "confidence": 0.2, "restriction_type": "LOCKUP", "conflict_id": "k", "property": "nav", "likely_cause": "OTHER", "severity": "BLOCKING",
             "issue_id": "i", "issue_type": "LOST"}
    header = {"proposal_id": "p", "run_id": "run", "prompt_version": "v1", "schema_version": "v1"}
    kinds = {str: "string", float: "double", bool: "boolean", list: "array<string>"}

    def table(row, versions):
        schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items())
        return rows(schema, *[tuple(v.values()) for v in versions])

    def changed(row):
        for key, value in row.items():
            if key != "proposal_id":
                yield key, {**row, key: [*value, "y"] if isinstance(value, list) else not value if isinstance(value, bool) else value + 0.25 if isinstance(value, float) else value + "x"}

    parts, cases = [claim, relation, draft, header], [[], [], [], []]
    for k, part in enumerate(parts):
        for key, row in changed(part):
            for j, other in enumerate(parts):
                cases[j].append({**(row if j == k else other), "proposal_id": f"{k}:{key}"})
    hashes = {r.proposal_id: r.proposal_hash for r in digests.draft_proposals(*[table(p, [*c, p]) for p, c in zip(parts, cases)]).collect()}
    assert len(hashes) == 1 + sum(len(p) - 1 for p in parts)
    again = [[{**p, "proposal_id": name} for name in hashes] for p in parts]
    plain = {r.proposal_id: r.proposal_hash for r in digests.draft_proposals(*[table(p, c) for p, c in zip(parts, again)]).collect()}
    assert all((hashes[name] == plain[name]) == (name == "p") for name in hashes)
