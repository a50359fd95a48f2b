"""The whole job, its gates, and its resumption."""

import os

import pytest

from votelens.operators import scoring as S
from votelens.params import RUBRIC
from votelens.plans import run as R
from votelens.sources.fixtures import Fixtures

from .oracle import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")


def make(calls, broken=lambda request: False):
    """A model that rejects short texts, looks at peers first, and leaves a mark for each call."""

    def make_model():
        def model(request, rounds):
            with open(calls, "a") as f:
                f.write(f"{request['item_id']} {request['order_label']} {request['mode']}\n")
            if broken(request):
                raise OSError("no")
            if request["mode"] != "single" and not rounds:
                return S.Reply((S.Action("get_peer_judgments", {"item_id": request["item_id"]}),), 100, 5)
            if request["mode"] == "agent" and request["item_id"].endswith("3"):
                return S.Reply((S.Action("flag_for_review", {"reason": "unsure"}),), 10, 5)
            if request["mode"] == "verifier":
                said = {"decision": "uphold" if request["grader_verdict"] == "accept" else "overturn", "confidence": 0.7, "reason": "seen"}
                return S.Reply((S.Action("emit_review", said),), 10, 5)
            few = len(request["justification"].split()) < 10
            said = {"dimension_scores": dict.fromkeys(RUBRIC, 3), "verdict": "reject" if few else "accept", "confidence": 0.9, "reason": "length"}
            return S.Reply((S.Action("emit_verdict", said),), 10, 5)

        return model

    return make_model


@pytest.fixture(scope="module")
def tables(spark):
    f = Fixtures(spark, str(DATA))
    some = "cast(item_id as int) < 40"
    return f.items().where(some).cache(), f.submissions().where(some).cache(), f.item_peers().where(some).cache()


def test_whole_job(spark, tables, tmp_path):
    items, submissions, peers = tables
    calls, path = tmp_path / "calls", f"file://{tmp_path}/journal"
    with pytest.raises(R.GateClosed, match="smoke test: failed runs: 1"):
        R.grade_in_stages(items, submissions, peers, make(calls, lambda r: r["item_id"] == "0"), path, smoke=5, waves=2)
    assert len(calls.read_text().split("\n")) == 3 + 2 * 4 + 1  # three tries of one, two calls of four, and no more
    with pytest.raises(R.GateClosed, match="single: failed runs: 2"):
        R.grade_in_stages(items, submissions, peers, make(calls, lambda r: r["item_id"] == "7" and r["mode"] == "single"), path, smoke=5, waves=2, again=True)
    before = calls.read_text()
    grades, journal = R.grade_in_stages(items, submissions, peers, make(calls), path, smoke=5, waves=2, again=True)
    new = calls.read_text()[len(before) :].splitlines()
    assert not any("single" in c and not c.startswith("7 ") for c in new)  # the first arm was done, but for what had failed
    n = items.count()
    done = {r["mode"]: r["count"] for r in grades.groupBy("mode").count().collect()}
    assert done == {"single": 2 * n, "agent": 2 * n, "verifier": 2 * n}
    results = R.evaluate(submissions, grades, journal, "grader-large")
    assert results.routed.count() == 3 * n and results.sweep.count() == 189 and results.layer0.count() == 4 and results.marginal.count() == 3
    escalated = sum(r["item_id"].endswith("3") for r in items.collect())
    assert results.escalations.first()["n_agent_escalated"] == escalated
    traces = {(r["mode"], r["escalated"]): r["count"] for r in results.traces.groupBy("mode", "escalated").count().collect()}
    assert traces["verifier", True] == 2 * escalated == traces["agent", True] and traces["verifier", False] == 2 * (n - escalated)
    assert results.call_log.select("call_id").distinct().count() == results.call_log.count() == len(calls.read_text().splitlines())
    assert results.ablation.where("defect_type = 'Overall'").count() == 1
    results.release()
    size = os.path.getsize(calls)
    R.grade_in_stages(items, submissions, peers, make(calls), path, smoke=5, waves=2)
    assert os.path.getsize(calls) == size  # nothing left to call


def test_items_need_submissions(spark, tables, tmp_path):
    items, submissions, peers = tables
    with pytest.raises(R.GateClosed, match="without a submission: 1,"):
        R.grade_in_stages(items, submissions.where("item_id <> '4'"), peers, make(tmp_path / "c"), f"file://{tmp_path}/j")
