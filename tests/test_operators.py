"""Signals, preparation, seeding, grading, evidence, traces, tables and the stream, on small tables."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from votelens.functions import columns as C
from votelens.operators import evidence, grading, preparation, seeding, signals, traces
from votelens.params import RUBRIC, Params
from votelens.sources import tables
from votelens.streaming import incremental

SUB = "item_id string, annotator_id string, vote string, justification string"


def annotator(name, votes, texts):
    return [(f"{name}{i}", name, v, t) for i, (v, t) in enumerate(zip(votes, texts, strict=True))]


def test_annotator_flags(spark):
    rows = annotator("side", "A" * 9, [f"text {i}" for i in range(9)]) + annotator("same", "ABABABABAB", ["One  text"] * 5 + ["one text "] * 5)
    rows += annotator("near", "ABABABAB", [" A b", "a  B", "a b", *(f"t{i}" for i in range(5))]) + annotator("clean", "ABABABABAB", [f"text {i}" for i in range(10)]) + annotator("few", "A" * 7, ["x"] * 7)
    got = {r.annotator_id: r for r in signals.annotator_flags(spark.createDataFrame(rows, SUB)).collect()}
    assert {k: r.reason for k, r in got.items()} == {"side": "constant_side", "same": "justification_reuse", "near": None, "clean": None, "few": None}
    assert got["near"].dup_ratio == 3 / 8 and got["side"].side_ratio == 1.0 and got["few"].dup_ratio == 1.0


def test_overlay(spark):
    scored = spark.createDataFrame([("i", "bad", 0.9, False), ("j", "bad", None, True), ("k", "good", None, True)], "item_id string, annotator_id string, score double, escalated boolean")
    flags = spark.createDataFrame([("bad", True), ("good", False)], "annotator_id string, flagged boolean")
    got = {r.item_id: (r.score, r.escalated, r.agg_flagged) for r in signals.layer0_overlay(scored, flags).collect()}
    assert got == {"i": (0.0, False, True), "j": (0.0, False, True), "k": (None, True, False)}


def test_text_functions(spark):
    df = spark.createDataFrame([("Response A beats Response B.  Response A",), ("A obviously.",), ("x" * 250,), ("",)], "t string")
    t = F.col("t")
    rows = df.select(C.swap_letters(t).alias("s"), C.swap_letters(C.swap_letters(t)).alias("ss"), t, C.truncate_text(t).alias("cut"), C.word_count(t).alias("n")).collect()
    assert rows[0].s == "Response B beats Response A.  Response B" and all(r.ss == r.t for r in rows) and rows[1].s == rows[1].t
    assert rows[2].cut == "x" * 200 + "… [TRUNCATED — 250 chars total]" and rows[3].n == 0 and rows[0].n == 7


def test_peer_votes(spark):
    raw = [  # pos, question, judge, a, b, winner
        (1, 1, "p", "x", "y", "model_a"), (2, 1, "p", "x", "y", "model_b"), (3, 1, "q", "y", "x", "model_a"), (4, 1, "q", "y", "x", "tie"), (5, 1, "own", "x", "y", "model_a"), (6, 1, "p", "y", "x", "model_a"), (7, 1, "r", "x", "y", "bad"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in raw], "pos long, question_id int, judge string, model_a string, model_b string, winner string, turn int")
    items = spark.createDataFrame([("it", 1, "x", "y", "own")], "item_id string, question_id int, model_a string, model_b string, judge string")
    assert {r.judge: r.vote for r in preparation.peer_votes(df, items).collect()} == {"p": "B", "q": "B"}


def test_keyed_writes(spark):
    a = spark.createDataFrame([("x", 1, "one"), ("y", 1, "one")], "k string, version int, v string")
    b = spark.createDataFrame([("x", 3, "three"), ("x", 2, "two"), ("z", 1, "new")], "k string, version int, v string")
    assert {r.k: r.v for r in preparation.upsert_latest(a, b, ["k"]).collect()} == {"x": "three", "y": "one", "z": "new"}
    assert {r.k: r.v for r in preparation.insert_ignore(a, b, ["k"], "version").collect()} == {"x": "one", "y": "one", "z": "new"}


@pytest.mark.parametrize("n", [0, 10, 150, 1000])
def test_assignment_is_whole_even_and_order_free(spark, n):
    ids = [(f"item{i:04d}",) for i in range(n)]
    one = {tuple(r) for r in seeding.assign_items(spark.createDataFrame(ids, "item_id string")).collect()}
    random.Random(1).shuffle(ids)
    two = {tuple(r) for r in seeding.assign_items(spark.createDataFrame(ids, "item_id string").repartition(3)).collect()}
    assert one == two and len(one) == len({i for i, _ in one}) == n
    loads = [sum(a == x for _, a in one) for x in {a for _, a in one}]
    assert not n or max(loads) - min(loads) <= 5


def test_injection_plan(spark):
    clean = spark.createDataFrame([(f"i{i}",) for i in range(111)], "item_id string")
    plan = {r.item_id: r.defect_type for r in seeding.injection_plan(clean).collect()}
    assert len(plan) == 27 and abs(sum(t == "RUSHED" for t in plan.values()) - 13.5) <= 0.5
    subs = clean.select("item_id", F.lit("a").alias("annotator_id"), F.lit("A").alias("vote"), F.lit("Response A is far better than Response B in all that was asked").alias("justification"), F.lit(False).alias("is_defective"), F.lit(None).cast("string").alias("defect_type"))
    out = {r.item_id: r for r in seeding.inject_item_defects(subs, seeding.injection_plan(clean)).collect()}
    assert len(out) == 111 and {k for k, r in out.items() if r.is_defective} == set(plan)
    assert all(len(out[k].justification.split()) < 10 for k, t in plan.items() if t == "RUSHED")
    assert all(out[k].justification.startswith("Response B is") and out[k].vote == "A" for k, t in plan.items() if t == "SELF_CONTRADICTION")


def payload(**change):
    base = {"dimension_scores": {"decision_plausibility": 4, "justification_alignment": 3, "specificity": 2, "effort": 1}, "verdict": "accept", "confidence": 0.5, "reason": " r "}
    return json.dumps(base | change)


def test_verdict_rules(spark):
    cases = [
        (payload(), None), (payload(verdict="maybe"), "verdict"), (payload(confidence=1.5), "confidence"), (payload(confidence=None), "confidence"), (payload(reason="  "), "reason"),
        (payload(dimension_scores={"effort": 6}), "dimension_scores"), (payload(dimension_scores={"effort": "4"}), None), (payload(dimension_scores={"effort": 4.0}), None), (payload(dimension_scores={"effort": 2.5}), "dimension_scores"),
        (payload(dimension_scores={"effort": "high"}), "dimension_scores"), ("not json", "dimension_scores"), (None, "dimension_scores"),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, payload string")
    rows = sorted(grading.dimension_mismatch(grading.validate_verdicts(df)).collect(), key=lambda r: r.i)
    assert [r.error for r in rows] == [e for _, e in cases]
    assert rows[0].reason == "r" and rows[0].missing == [] and len(rows[6].missing) == 3


def test_combination(spark):
    rows = [("accept", 0.8, "uphold", 0.6), ("accept", 0.8, "overturn", 0.9), ("reject", 0.9, "overturn", 0.5)]
    df = spark.createDataFrame(rows, "grader_verdict string, grader_confidence double, decision string, review_confidence double")
    verdict, confidence = grading.combined()
    got = df.select(verdict.alias("v"), confidence.alias("c")).collect()
    assert [(r.v, pytest.approx(r.c)) for r in got] == [("accept", 0.7), ("reject", 0.54), ("accept", 0.3)]


def test_history_is_the_first_k_others(spark):
    rows = [(f"i{i:02d}", "busy", "A", f"t{i}") for i in range(30)] + [("solo", "one", "B", "t")]
    got = evidence.annotator_history(spark.createDataFrame(rows, SUB), k=3).collect()
    by_item = {}
    for r in got:
        by_item.setdefault(r.item_id, {})[r.pos] = r.other_id
    assert by_item["i00"] == {1: "i01", 2: "i02", 3: "i03"} and by_item["i02"] == {1: "i00", 2: "i01", 3: "i03"} and by_item["i29"] == {1: "i00", 2: "i01", 3: "i02"}
    assert "solo" not in by_item and len(got) == 90


def test_traces(spark):
    events = [{"type": "api_round", "tokens_in": 5, "tokens_out": 2}, {"type": "tool_call", "name": "get_full_response"}, {"type": "budget_exhausted"}, {"type": "escalation", "reason": "  "}]
    df = spark.createDataFrame([("i", "original", "verifier", "v", json.dumps(events), 1, False, True), ("j", "original", "agent", "v", "[]", 0, False, False)],
                               "item_id string, order_label string, mode string, rubric_version string, trace string, n_tool_calls int, hit_cap boolean, escalated boolean")
    audit = {r.item_id: r for r in traces.trace_audit(df).collect()}
    assert audit["i"].agrees and (audit["i"].tokens_in, audit["i"].tokens_out) == (5, 2) and audit["j"].agrees
    ends = {r.item_id: (r.outcome, r.reason, r.budget_exhausted) for r in traces.terminal_outcome(df).collect()}
    assert ends == {"i": ("escalation", "(no reason given)", True), "j": ("none", None, False)}


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, mode string")
    path = f"file://{tmp_path}/t"
    assert tables.load_if_empty(df, path) and not tables.load_if_empty(df.limit(1), path) and spark.read.parquet(path).count() == 2
    tables.create_empty(spark, f"file://{tmp_path}/e", "routed")
    assert tables.read_table(spark, f"file://{tmp_path}/e", "routed").count() == 0
    tables.write_json_text(df, f"file://{tmp_path}/j")
    assert {json.loads(r.value)["k"] for r in spark.read.text(f"file://{tmp_path}/j").collect()} == {"a", "b"}


def test_stream_of_grades(spark, tmp_path):
    schema = "item_id string, order_label string, mode string, rubric_version string, verdict string, version int"
    source, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    first = [("a", "original", "agent", "v", "accept", 1), ("b", "original", "agent", "v", "accept", 1)]
    spark.createDataFrame(first, schema).coalesce(1).write.json(source)
    for more in ([], [("a", "original", "agent", "v", "reject", 2)]):
        if more:
            spark.createDataFrame(more, schema).coalesce(1).write.mode("append").json(source)
        incremental.upsert_stream(spark.readStream.schema(schema).json(source), out, f"file://{tmp_path}/cp").awaitTermination()
    assert {r.item_id: r.verdict for r in incremental.current(spark, out).collect()} == {"a": "reject", "b": "accept"}
    late = incremental.upsert_stream(spark.readStream.schema(schema).json(source), out, f"file://{tmp_path}/new")
    with pytest.raises(StreamingQueryException, match="older checkpoint"):
        late.awaitTermination()
    assert {r.item_id: r.verdict for r in incremental.current(spark, out).collect()} == {"a": "reject", "b": "accept"}


def test_white_space_of_any_script(spark):
    rows = [(1, "A\u00a0 b\u2003"), (2, "\t a \n\u3000B \x1f"), (3, "\u2028"), (4, None), (5, "")]
    t = F.col("t")
    got = {r.i: (r.n, r.w, r.s) for r in spark.createDataFrame(rows, "i int, t string").select("i", C.norm_text(t).alias("n"), C.word_count(t).alias("w"), C.strip_text(t).alias("s")).collect()}
    assert got[1] == ("a b", 2, "A\u00a0 b") and got[2] == ("a b", 2, "a \n\u3000B") and got[3] == ("", 0, "") and got[5] == ("", 0, "")
    assert got[4][0] is None and got[4][2] is None


def test_reasons_of_white_space_alone_are_none(spark):
    def verdict(reason):
        return json.dumps({"dimension_scores": {d: 3 for d in RUBRIC}, "verdict": "accept", "confidence": 0.5, "reason": reason})

    rows = [(1, verdict("\n\t")), (2, verdict("x\n")), (3, verdict("\u00a0")), (4, verdict(" two words\t"))]
    got = {r.i: (r.valid, r.error, r.reason) for r in grading.validate_verdicts(spark.createDataFrame(rows, "i int, payload string")).collect()}
    assert got == {1: (False, "reason", ""), 2: (True, None, "x"), 3: (False, "reason", ""), 4: (True, None, "two words")}
    rows = [(1, json.dumps({"decision": "uphold", "confidence": 1, "reason": "\r\n"})), (2, json.dumps({"decision": "overturn", "confidence": 0, "reason": "\ty\n"}))]
    got = {r.i: (r.valid, r.reason) for r in grading.validate_reviews(spark.createDataFrame(rows, "i int, payload string")).collect()}
    assert got == {1: (False, ""), 2: (True, "y")}
    events = json.dumps([{"type": "escalation", "reason": "\n\u2003"}])
    df = spark.createDataFrame([("i", "original", "agent", "v", events)], "item_id string, order_label string, mode string, rubric_version string, trace string")
    assert traces.terminal_outcome(df).first().reason == "(no reason given)"


def test_defaults_are_the_operating_point():
    p = Params()
    assert len([1 for h in p.sweep_high for low in p.sweep_low if low < h]) == 63
