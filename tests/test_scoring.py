"""Grading runs: tries, evidence, budgets, and a journal that survives lost workers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from votelens.operators import scoring as S
from votelens.params import RUBRIC

from .plans import exchanges, planned_whole

GOOD = {"dimension_scores": dict.fromkeys(RUBRIC, 4), "verdict": "accept", "confidence": 0.8, "reason": "fine"}
REQUEST = {
    "item_id": "i1", "order_label": "original", "mode": "agent", "rubric_version": "v", "annotator_id": "ann", "response_a": "long a", "response_b": "long b",
    "history": [{"item_id": f"o{i}", "vote": "A", "justification": "j"} for i in range(10)], "peers": [{"judge": "e1", "vote": "B"}],
}


def scripted(*replies):
    def model(request, rounds):
        reply = replies[min(len(rounds), len(replies) - 1)]
        if isinstance(reply, Exception):
            raise reply
        return S.Reply(tuple(S.Action(*a) for a in reply), 10, 1)

    return model


def kinds(rounds):
    return [e["type"] for r in rounds for e in r["events"]]


@pytest.mark.parametrize(("field", "value"), [
    ("dimension_scores", {**dict.fromkeys(RUBRIC, 4), "effort": 6}), ("dimension_scores", {**dict.fromkeys(RUBRIC, 4), "effort": 1.5}), ("dimension_scores", None),
    ("verdict", "maybe"), ("confidence", 1.4), ("confidence", "x"), ("reason", " "), ("dimension_scores", {"effort": 3}),
])
def test_an_invalid_verdict_is_tried_again(field, value):
    bad = {**GOOD, field: value}
    assert S.verdict_problem(GOOD) is None and S.verdict_problem(bad) in (field, "dimensions")
    rounds = list(S.run(REQUEST, scripted([("emit_verdict", bad)], [("emit_verdict", GOOD)])))
    assert kinds(rounds) == ["invalid_verdict", "verdict"] and [r["outcome"] for r in rounds] == [None, "verdict"]
    failed = list(S.run(REQUEST, scripted([("emit_verdict", bad)])))
    assert len(failed) == 3 and failed[-1]["outcome"] == "failed" and failed[-1]["error"] == S.verdict_problem(bad)


def test_calls_that_raise_or_ask_for_nothing():
    rounds = list(S.run(REQUEST, scripted(TimeoutError("slow"), [], [("flag_for_review", {"reason": " "})])))
    assert [r["outcome"] for r in rounds] == [None, None, "escalation"] and json.loads(rounds[-1]["payload"])["reason"] == "(no reason given)"
    rounds = list(S.run(REQUEST, scripted(TimeoutError("slow"))))
    assert len(rounds) == 3 and rounds[-1]["error"] == "TimeoutError: slow" and rounds[-1]["outcome"] == "failed"


def test_evidence_and_its_budget():
    asked = [
        ("get_annotator_history", {"annotator_id": "ann", "limit": 3}), ("get_annotator_history", {"annotator_id": "other"}), ("get_peer_judgments", {"item_id": "i1"}),
        ("get_full_response", {"which": "b"}), ("get_weather", {}), ("get_full_response", {"which": "c"}), ("get_peer_judgments", {"item_id": "i1"}),
    ]
    rounds = list(S.run(REQUEST, scripted(asked, [("get_peer_judgments", {"item_id": "i1"}), ("emit_verdict", GOOD)])))
    said = [json.loads(e["text"]) for r in rounds for e in r["events"] if e["type"] == "tool_result"]
    assert len(said) == 6 and len(said[0]["submissions"]) == 3 and said[2]["peer_votes"] == [{"judge": "e1", "vote": "B"}] and said[3] == {"which": "B", "full_text": "long b"}
    assert [s.get("error") for s in (said[1], said[4], said[5])] == ["only annotator ann is in scope for this item", "unknown tool get_weather", "which must be 'a' or 'b'"]
    assert kinds(rounds)[-4:] == ["tool_refused", "budget_exhausted", "tool_refused", "verdict"]
    assert rounds[-1]["budget_exhausted"] and rounds[-1]["n_tool_calls"] == 6
    single = list(S.run({**REQUEST, "mode": "single"}, scripted([("get_peer_judgments", {"item_id": "i1"})], [("emit_verdict", GOOD)])))
    assert kinds(single) == ["tool_refused", "verdict"] and not single[-1]["budget_exhausted"]


def requests(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("i"), "id").alias("item_id"), F.lit("original").alias("order_label"), F.lit("single").alias("mode"), F.lit("v").alias("rubric_version"),
    ).repartition(4)


def test_a_lost_worker_costs_its_wave_alone(spark, tmp_path):
    """Every call leaves a mark.  A worker dies in a late wave; the next job finishes without calling journaled runs again."""
    marks, fuse = tmp_path / "calls", tmp_path / "fuse"
    marks.mkdir()
    fuse.touch()

    def make_model():
        def model(request, rounds):
            if request["item_id"] == "i7" and fuse.exists():
                os._exit(1)
            with open(marks / request["item_id"], "a") as f:
                f.write("x")
            if int(request["item_id"][1:]) % 10 == 3:
                raise OSError("always")
            return S.Reply((S.Action("emit_verdict", GOOD),), 10, 1)

        return model

    path = f"file://{tmp_path}/journal"
    work = requests(spark, 60)
    with pytest.raises(Exception, match="(?i)python worker|crash|EOF"):
        S.grade_all(work, make_model, path, waves=6)
    journaled = {r["item_id"] for r in S.read_journal(work, path).select("item_id").distinct().collect()}
    fuse.unlink()
    before = {i: (marks / i).read_text() for i in journaled}
    journal = S.grade_all(work, make_model, path, waves=6)
    assert all((marks / i).read_text() == said for i, said in before.items())
    assert S.graded(journal).count() == 54
    assert {(r["item_id"], r["calls"], r["error"]) for r in S.failures(journal).collect()} == {(f"i{i}", 3, "OSError: always") for i in range(3, 60, 10)}
    n = S.call_rows(journal, "m").count()
    assert n == 54 + 6 * 3 and S.grade_all(work, make_model, path).count() == n
    again = S.grade_all(work, make_model, path, again=True)
    assert again.count() == n + 18 and S.call_rows(again, "m").select("call_id").distinct().count() == n + 18
    assert {r["calls"] for r in S.failures(again).collect()} == {3} and S.run_traces(again).count() == 60
    assert {r["attempts"] for r in S.call_rows(again, "m").where("item_id = 'i13'").collect()} == set(range(1, 7))


def test_a_worker_holds_few_runs_at_a_time(spark):
    """Rounds leave the worker in frames of bounded size, so its memory does not grow with the batches it is given."""
    n = 5 * S.REQUESTS // 2
    requests = spark.range(n).selectExpr("cast(id AS string) AS item_id", "'original' AS order_label", "'single' AS mode", "'v' AS rubric_version", "1 AS pass")
    sizes = []

    class Requests:  # takes the work as Spark would
        def mapInPandas(self, work, schema):
            sizes.extend(len(f) for f in work(iter([requests.toPandas()])))

    S.journal_of(Requests(), lambda: scripted([("emit_verdict", GOOD)]))
    assert sizes == [S.REQUESTS, S.REQUESTS, S.REQUESTS // 2]
    assert S.journal_of(requests, lambda: scripted([("emit_verdict", GOOD)])).select("item_id").distinct().count() == n


def test_requests_are_made_once_for_all_waves(spark, tmp_path):
    """What there is to do is found once, not anew for each wave; and a run's rounds are gathered in one shuffle."""
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    work = requests(spark, 60)
    counting = work.mapInPandas(counted, work.schema)
    journal = S.grade_all(counting, lambda: scripted([("emit_verdict", GOOD)]), f"file://{tmp_path}/journal", waves=6)
    assert made.value == 60 and S.graded(journal).count() == 60
    with planned_whole(spark):
        assert len(exchanges(S.run_traces(journal))) == 1
