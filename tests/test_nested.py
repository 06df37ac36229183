"""Nested conformance: a whole document with one part broken at a time."""

import copy
import json

import pytest

from veritab.operators import nested

HEX, NOW = "0xab", 1


def sample(node):
    """A valid value for any node of a schema, with all optional keys."""
    if isinstance(node, nested.Record):
        return {k: sample(v) for k, v in node.fields().items()}
    if isinstance(node, nested.Items):
        return [sample(node.of), sample(node.of)]
    if isinstance(node, nested.Free):
        return {"free": [{"x": ""}]}
    if isinstance(node, nested.Number):
        return 1
    return node.among[0] if node.among else HEX if node.pattern else "text"


def steps(path):
    return [int(p) if p.isdigit() else p for p in path.replace("[", ".").replace("]", "").split(".")[1:]]


def changed(document, path, value):
    """The document with the value at a path replaced, or left out."""
    out = copy.deepcopy(document)
    *way, last = steps(path)
    at = out
    for step in way:
        at = at[step]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return out


def broken_values(path, node):
    """(value, rule, path) for each rule of a place."""
    if isinstance(node, nested.Record):
        sub = f"{path}.surprise"
        return [(7, "type", path), ({**sample(node), "surprise": 1}, "unknown_key", sub)]
    if isinstance(node, nested.Items):
        return [({}, "type", path), (None, "type", path)]
    if isinstance(node, nested.Free):
        return [([], "type", path)] if node.only_object else []
    if isinstance(node, nested.Number):
        low = (node.low - 1, "range" if node.high is not None else nested.low_rule(node), path)
        return [("1", "type", path), low] + ([(1.5, "whole", path)] if node.whole else [(node.high + 0.5, "range", path)])
    wrong = [(1, "type", path), (None, "type", path)]
    if node.among:
        return wrong + [("NONE_OF_THEM", "member", path), ("", "member", path)]
    return wrong + ([("ab", "pattern", path)] if node.pattern else [("", "non_empty", path)] if node.filled else [])


def cases():
    good = sample(nested.OBJECT)
    yield "good", json.dumps(good), set()
    for place, node in nested.places(nested.OBJECT):
        if place == nested.ROOT:
            continue
        path = place.replace("[]", "[1]")
        for k, (value, rule, at) in enumerate(broken_values(path, node)):
            yield f"{path} {k}", json.dumps(changed(good, path, value)), {(rule, at)}
    for place, node in nested.places(nested.OBJECT):
        if isinstance(node, nested.Record):
            path = place.replace("[]", "[0]")
            for key in node.fields():
                yield f"no {path}.{key}", json.dumps(changed(good, f"{path}.{key}", ...)), {("required", f"{path}.{key}")} if key in node.required else set()


def test_every_rule_at_every_place(spark):
    made = list(cases())
    assert len(made) > 400
    rows = spark.createDataFrame([(name, text) for name, text, _ in made], "object_id string, json string")
    got = {name: set() for name, _, _ in made}
    for r in nested.object_violations(rows).collect():
        assert (r.rule, r.path) not in got[r.row_id]
        got[r.row_id].add((r.rule, r.path))
    assert {n: v for n, v in got.items()} == {n: v for n, _, v in made}


@pytest.mark.parametrize("text", [None, "", "{", "[1", "nothing"])
def test_no_json(spark, text):
    rows = spark.createDataFrame([("o", text)], "object_id string, json string")
    assert [tuple(r) for r in nested.object_violations(rows).collect()] == [("o", "not_json", "$")]


def test_other_kinds_empty_objects_and_tables(spark):
    rows = spark.createDataFrame([("a", "[]"), ("b", "{}"), (None, "{}")], "object_id string, json string")
    got = nested.object_violations(rows).collect()
    assert [(r.rule, r.path) for r in got if r.row_id == "a"] == [("type", "$")]
    for i in ("b", None):
        assert {(r.rule, r.path) for r in got if r.row_id == i} == {("required", f"$.{k}") for k in nested.OBJECT.required}
    assert nested.object_violations(rows.limit(0)).count() == 0


def test_one_pass(spark):
    rows = spark.createDataFrame([("a", "[]")], "object_id string, json string")
    plan = nested.object_violations(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_numbers_text_and_ends_of_documents(spark):
    schema = nested.Record({"n": nested.Number(0, 9e18, whole=True)}, {"h": nested.HEX, "t": nested.REF})
    texts = {
        "whole": '{"n":1.0}', "half": '{"n":1.5}', "wide": '{"n":1e19}', "huge": '{"n":1e999}', "low": '{"n":-0.5}', "flag": '{"n":true}', "none": '{"n":null}',
        "twice": '{"n":1,"n":2}', "more": ' {"n":1} and more', "nan": '{"n":NaN}', "break": '{"n":1,"h":"0xab\\r"}', "breaks": '{"n":1,"h":"0xab\\r\\r"}',
        "lone": '{"n":1,"\\ud800":1}', "long": '{"n":' + "9" * 400 + "}", "tab": '{"n":1,"t":"\t"}',
    }
    rows = spark.createDataFrame(list(texts.items()), "object_id string, json string")
    got = {name: set() for name in texts}
    for r in nested.violations(rows, "object_id", "json", schema).collect():
        got[r.row_id].add((r.rule, r.path))
    over = {("range", "$.n"), ("whole", "$.n")}
    assert got == {
        "whole": set(), "half": {("whole", "$.n")}, "wide": over, "huge": over, "low": over, "flag": {("type", "$.n")}, "none": {("type", "$.n")},
        "twice": {("not_json", "$")}, "more": set(), "nan": {("not_json", "$")}, "break": set(), "breaks": {("pattern", "$.h")},
        "lone": {("unknown_key", "$.?")}, "long": over, "tab": {("not_json", "$")},
    }


def test_a_table_in_one_piece_is_checked_by_all_cores(spark, tmp_path):
    from veritab.sources.bindings import Tables

    spark.range(8).selectExpr("id AS o_orderkey", "id AS o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert Tables(spark, str(tmp_path)).raw("orders").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_documents_are_walked_once(spark):
    import time

    text = json.dumps(sample(nested.OBJECT)).encode()
    start = time.process_time()
    for _ in range(200):
        assert not list(nested.document_violations(nested.OBJECT, text))
    assert time.process_time() - start < 2
