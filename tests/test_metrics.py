"""Scores, routes and metrics on records that can be checked by eye."""

import pytest
from pyspark.sql import functions as F

from votelens.functions import columns as C
from votelens.operators import evaluation as E
from votelens.params import Params

# score, escalated, is_defective, defect_type: one mode
RECORDS = [
    (0.1, False, True, "RUSHED"), (0.2, False, True, "RUSHED"), (0.25, False, True, "BOILERPLATE"), (0.9, False, True, "POSITION_BIAS"), (0.5, False, True, "POSITION_BIAS"),
    (None, True, True, "SELF_CONTRADICTION"), (0.8, False, True, "SELF_CONTRADICTION"), (0.15, False, False, None), (0.95, False, False, None), (0.75, False, False, None), (0.5, False, False, None), (None, True, False, None),
]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(f"i{k}", "agent", *r) for k, r in enumerate(RECORDS)], "item_id string, mode string, score double, escalated boolean, is_defective boolean, defect_type string")


def test_operating_point(scored):
    m = E.flag_metrics(scored, ["mode"], Params(high=0.75, low=0.25)).first()
    assert (m.n_items, m.n_flagged, m.n_escalated) == (12, 4, 2)
    assert (m.precision, m.recall, m.catch_rate) == (3 / 4, 3 / 7, 4 / 7)
    assert m.review_load == 4 / 12


def test_by_type(scored):
    rows = {r.defect_type: r for r in E.recall_by_type(scored, ["mode"], Params(high=0.75, low=0.25)).collect()}
    assert [rows[t].recall for t in ("RUSHED", "BOILERPLATE", "POSITION_BIAS", "SELF_CONTRADICTION")] == [1, 1, 0, 0]
    assert rows["SELF_CONTRADICTION"].catch_rate == 1 / 2
    none = E.recall_by_type(scored.where("defect_type is null"), ["mode"]).collect()
    assert len(none) == 4 and all(r.recall is None and r.n_type == 0 for r in none)


def test_thresholds_at_the_edges(scored):
    low = E.flag_metrics(scored, ["mode"], Params(high=0.75, low=0.01)).first()
    assert low.precision is None and low.catch_rate == 1 / 7
    high = E.flag_metrics(scored, ["mode"], Params(high=0.99, low=0.98)).first()
    assert (high.n_flagged, high.precision, high.recall, high.catch_rate) == (10, 6 / 10, 6 / 7, 1)
    assert E.flag_metrics(scored.limit(0), ["mode"]).count() == 0


def test_scores_and_routes(spark):
    cases = [("accept", 0.9, False, 0.9), ("reject", 0.9, False, 1 - 0.9), ("accept", 0.9, True, 0.5 + 0.4 * (1 - 0.6)), ("reject", 0.65, False, 0.35)]
    df = spark.createDataFrame(cases, "verdict string, confidence double, flipped boolean, want double")
    out = df.withColumn("score", C.acceptance_score(F.col("verdict"), F.col("confidence"), F.col("flipped"))).withColumn("route", C.route_label(F.col("score"))).collect()
    assert all(r.score == pytest.approx(r.want, abs=1e-15) for r in out)
    assert [r.route for r in out] == ["auto_accept", "auto_reject", "human_review", "auto_reject"]
    edge = spark.createDataFrame([(0.75,), (0.35,), (0.36,)], "s double").select(C.route_label(F.col("s")).alias("r")).collect()
    assert [r.r for r in edge] == ["auto_accept", "auto_reject", "human_review"]


def test_sweep_is_monotone_and_whole(spark, scored):
    costs = spark.createDataFrame([("agent", 1.0)], "mode string, cost_per_1000_usd double")
    rows = E.calibration_sweep(scored, costs).collect()
    assert len(rows) == 63 and sum(r.operating for r in rows) == 1
    by_high = {}
    for r in sorted(rows, key=lambda r: (r.high, r.low)):
        assert r.n_flagged >= by_high.get(r.high, 0)
        by_high[r.high] = r.n_flagged


def test_escalation_overrides(spark):
    grades = spark.createDataFrame(
        [("a", "original", "agent", "v", "accept", 0.9, "one", False), ("a", "swapped", "agent", "v", None, None, "two", True), ("b", "original", "agent", "v", "accept", 0.9, "r", None),
         ("b", "swapped", "agent", "v", "reject", 0.6, "r", None), ("c", "original", "agent", "v", "accept", 0.9, "r", False)],
        "item_id string, order_label string, mode string, rubric_version string, verdict string, confidence double, reason string, escalated boolean",
    )
    rows = {r.item_id: r for r in E.route_items(grades).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"].path, rows["a"].confidence, rows["a"].flipped, rows["a"].reason, rows["a"].verdict_original) == ("AGENT_ESCALATED", None, None, "one", "accept")
    assert rows["b"].flipped and rows["b"].path == "THRESHOLD_ROUTED"
    truth = spark.createDataFrame([("a", "x", True, "RUSHED"), ("b", "y", False, None)], "item_id string, annotator_id string, is_defective boolean, defect_type string")
    assert {r.item_id: r.flipped for r in E.scored_records(grades, truth).collect()} == {"a": False, "b": True}


def test_sweep_of_real_scores(spark):
    """As many different scores as records: counts as by hand, no join with the grid, and buckets as few as thresholds allow."""
    from .plans import nodes, planned_whole

    n = 20_000
    kind = F.when(F.col("id") % 5 == 0, F.element_at(F.array(*map(F.lit, ("RUSHED", "BOILERPLATE", "POSITION_BIAS", "SELF_CONTRADICTION"))), (F.col("id") % 4 + 1).cast("int")))
    records = spark.range(n).select(
        F.col("id").cast("string").alias("item_id"), F.when(F.col("id") % 2 == 0, "agent").otherwise("single").alias("mode"),
        F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e9).alias("score"), (F.col("id") % 17 == 0).alias("escalated"), kind.isNotNull().alias("is_defective"), kind.alias("defect_type"),
    )
    edges = spark.createDataFrame([(f"e{t}", "agent", t, False, True, "RUSHED") for t in (*Params().sweep_low, *Params().sweep_high)], records.schema)
    records = records.unionByName(edges)
    assert E.bucketed(records).count() <= 2 * (10 * 8 + 2) * 2
    sweep = E.calibration_sweep(records, spark.createDataFrame([("agent", 1000, ), ("single", 5000)], "mode string, micro_usd long"))
    with planned_whole(spark):
        assert not any("NestedLoop" in name or "Cartesian" in name for name, *_ in nodes(sweep))
    rows = [tuple(r) for r in records.collect()]
    got = sweep.collect()
    assert len(got) == 126
    for r in got[::9]:
        mine = [x for x in rows if x[1] == r.mode]
        flagged = [x for x in mine if not x[3] and x[2] is not None and x[2] <= r.low]
        middle = [x for x in mine if x[3] or (x[2] is not None and r.low < x[2] < r.high)]
        bad = sum(x[4] for x in mine)
        assert (r.n_items, r.n_flagged, r.n_escalated) == (len(mine), len(flagged), sum(x[3] for x in mine))
        assert (r.precision, r.recall, r.review_load) == (sum(x[4] for x in flagged) / len(flagged), sum(x[4] for x in flagged) / bad, len(middle) / len(mine))
        rushed = [x for x in mine if x[5] == "RUSHED"]
        assert r.recall_RUSHED == sum(x in flagged for x in rushed) / max(1, len(rushed)) if rushed else r.recall_RUSHED is None
        assert r.cost_per_1000_usd == {"agent": 1000, "single": 5000}[r.mode] / (r.n_items * 1000)
