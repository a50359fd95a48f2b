"""Tables stored by item, audits in one scan, and the protocol of traces."""

import json

import pytest
from pyspark.sql import functions as F

from votelens.operators import checks, evaluation
from votelens.operators.traces import protocol_breaches
from votelens.sources import placed

from .plans import exchanges, nodes, planned_whole

GRADE = "item_id string, order_label string, mode string, rubric_version string, verdict string, confidence double, reason string, escalated boolean"


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(f"i{i}", o, m, "v", "accept" if i % 3 else "reject", 0.5 + i % 40 / 100, "r", False) for i in range(200) for o in ("original", "swapped") for m in ("single", "agent", "verifier") if (i + len(o)) % 7]
    grades = spark.createDataFrame(rows, GRADE)
    truth = spark.createDataFrame([(f"i{i}", f"a{i % 5}", i % 4 == 0, "RUSHED" if i % 4 == 0 else None) for i in range(220)], "item_id string, annotator_id string, is_defective boolean, defect_type string")
    return grades, truth, placed.store_by_item(grades, 6), placed.store_by_item(truth, 6)


def test_nothing_moves_by_item(spark, stored):
    grades, truth, grades_by_item, truth_by_item = stored
    with planned_whole(spark):
        for made, plain in (
            (evaluation.paired_grades(grades_by_item), evaluation.paired_grades(grades)),
            (evaluation.scored_records(grades_by_item, truth_by_item), evaluation.scored_records(grades, truth)),
            (placed.pending_by_item(truth_by_item, grades_by_item), checks.pending_work(truth, grades)),
        ):
            assert exchanges(made) == [] and exchanges(plain) != []
            assert sorted(map(tuple, made.collect()), key=repr) == sorted(map(tuple, plain.select(*made.columns).collect()), key=repr)


def test_an_audit_reads_a_table_once(spark, stored, tmp_path):
    _, _, grades, _ = stored
    with planned_whole(spark):
        audit = checks.audit({"grades": grades})
        assert sum("Scan" in name for name, *_ in nodes(audit)) == 1
    assert audit.collect() == []
    bad = grades.withColumn("verdict", F.when(F.col("item_id") == "i5", "maybe").otherwise(F.col("verdict"))).unionByName(grades.where("item_id = 'i9'"))
    found = {(r.rule, json.loads(r.key)["item_id"]): r.n for r in checks.broken_keys("grades", bad).collect()}
    assert set(found) == {("allowed: verdict", "i5"), ("unique key", "i9")} and set(found.values()) == {1, 2}
    seen = checks.checked_write("grades", bad, f"file://{tmp_path}/out")
    n = bad.where("item_id = 'i5'").count()
    assert seen["rows"] == bad.count() and {k: v for k, v in seen.items() if v and k != "rows"} == {"allowed: verdict": n}
    apart = spark.read.parquet(f"file://{tmp_path}/out/ok=false").collect()
    assert len(apart) == n and all(r.violations == ["allowed: verdict"] and r.item_id == "i5" for r in apart)


def ran(spark, *traces, mode="agent"):
    rows = [(f"{k}", "original", mode, "v", t if isinstance(t, str) or t is None else json.dumps([{"type": e.split(":")[0], "name": (e.split(":") + [None])[1]} for e in t])) for k, t in enumerate(traces)]
    df = spark.createDataFrame(rows, "item_id string, order_label string, mode string, rubric_version string, trace string")
    out = {k: [] for k in range(len(traces))}
    for r in protocol_breaches(df).collect():
        out[int(r.item_id)].append((r.pos, r.rule))
    return [sorted(v) for v in out.values()]


def test_protocol(spark):
    r, call, got, end = "api_round", "tool_call:t", "tool_result:t", "verdict"
    full = [r, call, got] * 6
    assert ran(
        spark, [r, end], [r, call, got, r, end], [*full, "budget_exhausted", r, end], ["inherited_escalation"], [r, "invalid_verdict", r, end], [r, "call_failed", r, "escalation"],
    ) == [[]] * 6
    assert ran(
        spark, [], None, "{", [r], [end], [r, end, r], [r, call, r, got, end], [r, call, "tool_result:u", end], [*full, r, call, got, r, end], [*full, "budget_exhausted", r, call, got, end],
        [r, "budget_exhausted", end], [*full, "budget_exhausted", "budget_exhausted", r, end], [r, "inherited_escalation"], [r, end, end], "[1]",
    ) == [
        [(0, "no end")], [(0, "unreadable")], [(0, "unreadable")], [(1, "no end")], [(0, "before any round")], [(2, "after the end")],
        [(2, "call without its result"), (3, "result without its call")], [(2, "result without its call")], [(19, "call over budget")], [(20, "call after budget spent")],
        [(1, "budget not spent")], [(19, "spent twice")], [(1, "inherited with rounds")], [(2, "after the end")], [(0, "unreadable")],
    ]
    assert ran(spark, [*[r, call, got] * 4, r, "review"], [r, call, got, r, "review"], mode="verifier") == [[(10, "call over budget")], []]
    assert ran(spark, [r, call, got, r, end], mode="single") == [[(1, "call over budget")]]

def test_a_trace_is_parsed_once(spark):
    """The breaches' list is no column that a filter of the explosion would compute anew, with the JSON and all below it."""
    traces = spark.createDataFrame([("i", "original", "agent", "v1", '[{"type":"verdict"}]')], "item_id string, order_label string, mode string, rubric_version string, trace string")
    breaches = protocol_breaches(traces)
    with planned_whole(spark):
        assert sum(text.count("from_json") for _, text, _ in nodes(breaches)) == 1
    assert sorted((r["pos"], r["rule"]) for r in breaches.collect()) == [(0, "before any round")]
