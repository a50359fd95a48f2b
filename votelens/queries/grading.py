"""Grading: payload checks, batch scoring, the verifier's arm."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votelens.operators import grading as G
from votelens.operators import scoring as S
from votelens.operators.preparation import order_views
from votelens.queries.preparation import _VIEWS
from votelens.queries.sql import statement
from votelens.schemas import RUN_KEY
from votelens.sources import tables
from votelens.sources.fixtures import MODEL, Fixtures


def validate_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return G.validate_verdicts(Fixtures(spark, sf).payloads()).select("item_id", "order_label", "mode", "valid", "error", "verdict", "confidence", "reason")


def dimension_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    found = G.dimension_mismatch(G.validate_verdicts(Fixtures(spark, sf).payloads()))
    return found.select("item_id", "order_label", "mode", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


def dimension_extra(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts that score a dimension which the rubric has not."""
    p = Fixtures(spark, sf).payloads()
    more = p.withColumn("payload", F.when(F.col("seed") % 9 == 0, F.regexp_replace("payload", '"specificity":2', '"specificity":2,"tone":1,"length":0')).otherwise(F.col("payload")))
    found = G.dimension_mismatch(G.validate_verdicts(more))
    return found.select("item_id", "order_label", "mode", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


def validate_reviews(spark: SparkSession, sf: str) -> DataFrame:
    c = F.round(F.col("confidence") * 100).cast("int")
    confidence = F.when(c % 7 == 1, F.concat(F.lit("1."), c.cast("string"))).otherwise(F.concat(F.lit("0."), c.cast("string")))
    payload = F.concat(
        F.lit('{"decision":"'), F.when(c % 7 == 0, "unsure").otherwise(F.col("decision")), F.lit('","confidence":'), confidence,
        F.lit(',"reason":"'), F.when(c % 7 == 2, "  ").otherwise(F.concat(F.lit(" "), "reason")), F.lit('"}'),
    )
    return G.validate_reviews(Fixtures(spark, sf).reviews().select("item_id", "order_label", payload.alias("payload"))).drop("payload")


def retry_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return G.retry_resolve(Fixtures(spark, sf).attempts()).select("item_id", "order_label", "mode", "failed", "attempt", "verdict", "last_error")


def _views(f: Fixtures) -> DataFrame:
    return order_views(f.items(), f.submissions())


def _length_scorer() -> G.Scorer:
    """A scorer as a caller would supply one: rejects texts of few words."""

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        few = frame["justification"].map(lambda t: len(t.split()) < 10)
        return pd.DataFrame({
            "item_id": frame["item_id"], "order_label": frame["order_label"], "verdict": few.map({True: "reject", False: "accept"}), "confidence": few.map({True: 0.9, False: 0.75}),
        })

    return score


def batch_grade(spark: SparkSession, sf: str) -> DataFrame:
    views = _views(Fixtures(spark, sf)).select("item_id", "order_label", "justification")
    return G.batch_grade(views, _length_scorer, "item_id string, order_label string, verdict string, confidence double")


def _replay() -> S.Model:
    """Says what was recorded: a fault on the first call, evidence calls one by one, then an escalation or one payload a try."""

    def reply(request: dict[str, Any], rounds: list[dict[str, Any]]) -> S.Reply:
        tokens = (500 + len(rounds), 40)
        if request["faulty"] and not rounds:
            raise ConnectionError("connection reset")
        tools = sum(e["type"] in ("tool_call", "tool_refused") for r in rounds for e in r["events"])
        if tools < request["n_tool_calls"]:
            return S.Reply((S.Action("get_full_response", {"which": "c"}),), *tokens)
        if request["gives_up"]:
            return S.Reply((S.Action("flag_for_review", {"reason": "  "}),), *tokens)
        tries = sum(r["error"] is not None for r in rounds)
        said = json.loads(request["replies"][tries])
        if request["mode"] == "verifier":  # a review says the like in other words
            said["decision"] = {"accept": "uphold", "reject": "overturn"}.get(said.pop("verdict", None))
            return S.Reply((S.Action("emit_review", said),), *tokens)
        return S.Reply((S.Action("emit_verdict", said),), *tokens)

    return reply


def _recorded(f: Fixtures) -> DataFrame:
    """Requests with the replies that were recorded for them."""
    replies = f.attempts().groupBy(*RUN_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("attempt", "payload"))), lambda x: x["payload"]).alias("replies"))
    runs = f.runs().select(
        *RUN_KEY, "n_tool_calls", (F.col("seed") % 23 == 0).alias("faulty"), ((F.col("mode") != "single") & (F.col("seed") % 13 == 0)).alias("gives_up"),
    )
    return runs.join(replies, list(RUN_KEY))


def _journal(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    requests, path = _recorded(Fixtures(spark, sf)), tables.scratch(spark, "journal")
    return S.grade_all(requests, _replay, path, waves=3), path


def grading_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Grades of whole runs, of which some calls fail."""
    return S.graded(_journal(spark, sf)[0]).drop("dimension_scores", "rubric_version")


def grading_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return S.reviewed(_journal(spark, sf)[0]).drop("rubric_version")


def grading_failures(spark: SparkSession, sf: str) -> DataFrame:
    return S.failures(_journal(spark, sf)[0]).drop("rubric_version")


def grading_traces(spark: SparkSession, sf: str) -> DataFrame:
    traces = S.run_traces(_journal(spark, sf)[0])
    kinds = F.transform(F.from_json("trace", "array<struct<type:string>>"), lambda e: e["type"])
    return traces.select("item_id", "order_label", "mode", "n_tool_calls", "hit_cap", "escalated", "tokens_in", F.array_join(kinds, ",").alias("events"))


def grading_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls by pass: a repeated job calls nothing again, and a further pass only what failed."""
    _, path = _journal(spark, sf)
    requests = _recorded(Fixtures(spark, sf))
    S.grade_all(requests, _replay, path, waves=2)
    whole = F.transform("replies", lambda x: F.to_json(F.struct(F.lit(4).alias("n"))))  # never valid: fails a second time
    journal = S.grade_all(requests.withColumn("replies", whole).withColumn("n_tool_calls", F.lit(0)).withColumn("faulty", F.lit(False)), _replay, path, waves=2, again=True)
    calls = S.call_rows(journal, MODEL)
    first = journal.groupBy(*RUN_KEY).agg(F.max("pass").alias("passes"))
    return calls.groupBy(*RUN_KEY).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_distinct("call_id").alias("n_ids"), F.max("attempts").alias("last_attempt")
    ).join(first, list(RUN_KEY)).drop("rubric_version")


def combine_reviews(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    agent = f.grades().where("mode = 'agent' and not escalated").select("item_id", "order_label", F.col("verdict").alias("grader_verdict"), F.col("confidence").alias("grader_confidence"))
    reviews = f.reviews().select("item_id", "order_label", "decision", F.col("confidence").alias("review_confidence"))
    verdict, confidence = G.combined()
    return agent.join(reviews, ["item_id", "order_label"]).select("item_id", "order_label", verdict.alias("verdict"), confidence.alias("confidence"))


def verifier_grades(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return G.verifier_grades(f.grades(), f.reviews())


def overturn_rate(spark: SparkSession, sf: str) -> DataFrame:
    return G.overturn_rate(Fixtures(spark, sf).reviews())


QUERIES = {q.__name__: q for q in (
    validate_verdicts, dimension_mismatch, dimension_extra, validate_reviews, retry_resolve, batch_grade, grading_runs, grading_reviews, grading_failures, grading_traces, grading_calls, combine_reviews,
    verifier_grades, overturn_rate,
)}


_SEEN = f"""(SELECT *, len(list_filter(regexp_split_to_array(justification, '\\s+'), lambda w: w <> '')) < 10 AS few,
    CASE vote WHEN 'A' THEN length(replace(justification, 'Response A', '')) > length(replace(justification, 'Response B', '')) ELSE length(replace(justification, 'Response B', '')) > length(replace(justification, 'Response A', '')) END AS against FROM {_VIEWS})"""


_PAYLOAD_ERROR = "CASE seed % 11 WHEN 0 THEN 'dimension_scores' WHEN 1 THEN 'confidence' WHEN 2 THEN 'verdict' WHEN 3 THEN 'reason' END"
_RC = "(50 + seed % 50)"
_COMBINED_V = "CASE WHEN r.decision = 'uphold' THEN g.verdict WHEN g.verdict = 'accept' THEN 'reject' ELSE 'accept' END"
_COMBINED_C = "CASE WHEN r.decision = 'uphold' THEN (g.confidence + r.confidence) / cast(2 as double) ELSE r.confidence * (cast(1 as double) - cast(0.4 as double)) END"

# What a recorded run comes to: f faults first, t evidence calls within the budget (asked for one by one), then tries.
_RUNS = """(SELECT *, CASE WHEN esc THEN 'escalation' WHEN v > 0 THEN CASE mode WHEN 'verifier' THEN 'review' ELSE 'verdict' END ELSE 'failed' END AS outcome, f + t + CASE WHEN esc THEN 1 WHEN v > 0 THEN v - f ELSE 3 - f END AS n_calls,
    CASE b WHEN 0 THEN 'dimension_scores' WHEN 1 THEN 'confidence' WHEN 2 THEN CASE mode WHEN 'verifier' THEN 'decision' ELSE 'verdict' END WHEN 3 THEN 'reason' WHEN 4 THEN 'dimensions' END AS problem,
    CASE mode WHEN 'verifier' THEN 'review' ELSE 'verdict' END AS ending,
    CASE WHEN esc THEN 0 WHEN v > 0 THEN v - f - 1 ELSE 3 - f END AS bad FROM
    (SELECT *, CASE WHEN b IN (0, 1, 3, 4) THEN 0 WHEN b <> 2 THEN f + 1 WHEN 1 + seed % 3 > f THEN 1 + seed % 3 ELSE 0 END AS v FROM
    (SELECT *, CASE WHEN mode = 'verifier' AND seed % 11 IN (0, 4) THEN 10 ELSE seed % 11 END AS b, CASE WHEN seed % 23 = 0 THEN 1 ELSE 0 END AS f, n_tool_calls AS t, mode <> 'single' AND seed % 13 = 0 AS esc,
        CASE mode WHEN 'agent' THEN n_tool_calls >= 6 WHEN 'verifier' THEN n_tool_calls >= 3 ELSE false END AS spent FROM run)))"""
_TOOL_ROUNDS = "repeat(',api_round,tool_call,tool_result', cast(t AS int)) || CASE WHEN spent THEN ',budget_exhausted' ELSE '' END"

ORACLES = {name: statement(sql) for name, sql in {
    "validate_verdicts": f"""SELECT item_id, order_label, mode, seed % 11 > 3 AS valid, {_PAYLOAD_ERROR} AS error, CASE WHEN seed % 11 = 2 THEN 'maybe' WHEN seed % 10 < 3 THEN 'reject' ELSE 'accept' END AS verdict,
        CASE WHEN seed % 11 = 1 THEN cast(1.4 as double) ELSE cast(10 + seed % 90 as double) / cast(100 as double) END AS confidence, CASE WHEN seed % 11 = 3 THEN '' ELSE 'because' END AS reason FROM run0""",
    "dimension_mismatch": "SELECT item_id, order_label, mode, CASE WHEN seed % 11 = 4 THEN 'effort' ELSE '' END AS missing, '' AS extra FROM run0",
    "dimension_extra": "SELECT item_id, order_label, mode, CASE WHEN seed % 11 = 4 THEN 'effort' ELSE '' END AS missing, CASE WHEN seed % 9 = 0 THEN 'length,tone' ELSE '' END AS extra FROM run0",
    "validate_reviews": f"""SELECT item_id, order_label, {_RC} % 7 > 2 AS valid, CASE {_RC} % 7 WHEN 0 THEN 'decision' WHEN 1 THEN 'confidence' WHEN 2 THEN 'reason' END AS error,
        CASE WHEN {_RC} % 7 = 0 THEN 'unsure' ELSE decision END AS decision, CASE WHEN {_RC} % 7 = 1 THEN cast('1.' || {_RC} as double) ELSE cast('0.' || {_RC} as double) END AS confidence,
        CASE WHEN {_RC} % 7 = 2 THEN '' ELSE reason END AS reason FROM review""",
    "retry_resolve": """SELECT item_id, order_label, mode, bad AS failed, CASE WHEN NOT bad THEN CASE WHEN seed % 11 = 2 THEN 1 + seed % 3 ELSE 1 END END AS attempt,
        CASE WHEN NOT bad THEN CASE WHEN seed % 11 = 2 THEN 'accept' WHEN seed % 10 < 3 THEN 'reject' ELSE 'accept' END END AS verdict,
        CASE seed % 11 WHEN 0 THEN 'dimension_scores' WHEN 1 THEN 'confidence' WHEN 3 THEN 'reason' WHEN 4 THEN 'dimensions' END AS last_error FROM (SELECT *, seed % 11 IN (0, 1, 3, 4) AS bad FROM run0)""",
    "batch_grade": f"SELECT item_id, order_label, CASE WHEN few THEN 'reject' ELSE 'accept' END AS verdict, CASE WHEN few THEN cast(0.9 as double) ELSE cast(0.75 as double) END AS confidence FROM {_SEEN}",
    "grading_runs": f"""SELECT item_id, order_label, mode, CASE WHEN NOT esc THEN CASE WHEN b = 2 THEN 'accept' WHEN seed % 10 < 3 THEN 'reject' ELSE 'accept' END END AS verdict,
        CASE WHEN NOT esc THEN cast(10 + seed % 90 as double) / cast(100 as double) END AS confidence, CASE WHEN esc THEN '(no reason given)' ELSE 'because' END AS reason, esc AS escalated,
        spent AND NOT esc AS budget_exhausted FROM {_RUNS} WHERE outcome <> 'failed' AND mode <> 'verifier'""",
    "grading_reviews": f"""SELECT item_id, order_label, CASE WHEN NOT esc THEN CASE WHEN b = 2 THEN 'uphold' WHEN seed % 10 < 3 THEN 'overturn' ELSE 'uphold' END END AS decision,
        CASE WHEN NOT esc THEN cast(10 + seed % 90 as double) / cast(100 as double) END AS confidence, CASE WHEN esc THEN '(no reason given)' ELSE 'because' END AS reason, esc AS escalated,
        spent AS budget_exhausted FROM {_RUNS} WHERE outcome <> 'failed' AND mode = 'verifier'""",
    "grading_failures": f"SELECT item_id, order_label, mode, cast(n_calls as int) AS calls, problem AS error FROM {_RUNS} WHERE outcome = 'failed'",
    "grading_traces": f"""SELECT item_id, order_label, mode, cast(t as int) AS n_tool_calls, spent AS hit_cap, esc AS escalated, cast(500 * (n_calls - f) + n_calls * (n_calls - 1) // 2 as int) AS tokens_in,
        ltrim(CASE WHEN f = 1 THEN ',api_round,call_failed' ELSE '' END || {_TOOL_ROUNDS} || repeat(',api_round,invalid_' || ending, cast(bad as int))
        || CASE outcome WHEN 'failed' THEN '' ELSE ',api_round,' || outcome END, ',') AS events FROM {_RUNS}""",
    "grading_calls": f"""SELECT item_id, order_label, mode, n_calls + x AS n_calls, n_calls + x AS n_ids, cast(n_calls + x as int) AS last_attempt, CASE WHEN x > 0 THEN 2 ELSE 1 END AS passes
        FROM (SELECT *, CASE WHEN outcome = 'failed' THEN 3 ELSE 0 END AS x FROM {_RUNS})""",
    "combine_reviews": f"SELECT g.item_id, g.order_label, {_COMBINED_V} AS verdict, {_COMBINED_C} AS confidence FROM grade g JOIN review r ON r.item_id = g.item_id AND r.order_label = g.order_label WHERE g.mode = 'agent' AND NOT g.escalated",
    "verifier_grades": f"""SELECT g.item_id, g.order_label, 'verifier' AS mode, g.rubric_version, CASE WHEN NOT e THEN g.dimension_scores END AS dimension_scores, CASE WHEN NOT e THEN {_COMBINED_V} END AS verdict,
        CASE WHEN NOT e THEN round_even({_COMBINED_C}, 4) END AS confidence, CASE WHEN g.escalated THEN g.reason WHEN r.escalated THEN r.reason ELSE '[' || r.decision || '] ' || r.reason END AS reason,
        e AS escalated, g.escalated AS inherited FROM (SELECT *, escalated AS ge FROM grade WHERE mode = 'agent') g JOIN review r ON r.item_id = g.item_id AND r.order_label = g.order_label,
        LATERAL (SELECT g.escalated OR r.escalated AS e)""",
    "overturn_rate": "SELECT count(*) AS n_reviews, count(*) FILTER (WHERE decision = 'overturn') AS n_overturned, count(*) FILTER (WHERE decision = 'overturn') / cast(count(*) as double) AS overturn_rate FROM review WHERE NOT escalated",
}.items()}
