"""Shape of physical plans: no nested loops, no cross products, Python only in the log replay."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "v8_verify_claims", "d1_receipt_status", "d8_decision_receipts", "l1_lineage_issues", "d9_lineage_trace",
    "c5_resolve_snapshot_loose", "c8_neighbour_edges", "c9_object_x_mandate", "c13_representation_pairs",
    "x1_conflict_pairs", "g7_classify_relationships", "e9_extract_claims", "r7_interpret_rights", "o1_promote_claims",
    "m4_object_root", "t1_watch_batch", "t10_publisher_filter", "t7_attestation_fold", "y6_reverse_provenance",
]


def plan_of(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_nested_loops(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if not name.startswith("t7"):
        assert "Python" not in plan and "MapInPandas" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "b4_claims_by_subject")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan
    lines = [line for line in plan_of(spark, "d3_object_status").splitlines() if "ReadSchema" in line and "l_" in line]
    assert lines and all("l_quantity" not in line for line in lines)
