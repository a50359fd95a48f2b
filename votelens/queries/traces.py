"""Trace analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votelens.operators import traces as X
from votelens.queries.sql import statement
from votelens.sources.fixtures import Fixtures


def tool_usage(spark: SparkSession, sf: str) -> DataFrame:
    return X.tool_usage(Fixtures(spark, sf).traces())


def tool_call_counts(spark: SparkSession, sf: str) -> DataFrame:
    return X.tool_call_counts(Fixtures(spark, sf).traces())


def tool_calls_by_type(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return X.tool_calls_by_type(f.traces(), f.truth())


def trace_audit(spark: SparkSession, sf: str) -> DataFrame:
    return X.trace_audit(Fixtures(spark, sf).traces())


def tool_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Twice as many requests as the runs made, so that some are refused."""
    t = Fixtures(spark, sf).tool_events().select("item_id", "order_label", "mode", "rubric_version", "i", "name")
    more = t.selectExpr("item_id", "order_label", "mode", "rubric_version", "i + 10 AS i", "name")
    return X.tool_budget(t.unionByName(more)).select("item_id", "order_label", "mode", "i", "name", "executed", "forced")


def trace_events(spark: SparkSession, sf: str) -> DataFrame:
    return X.trace_events(Fixtures(spark, sf).traces()).select("item_id", "order_label", "mode", "pos", "type", "name", "reason", "tokens_in", "tokens_out", "chars", "preview")


def trace_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    """Stored columns that were changed after the run: which the events give away."""
    t = Fixtures(spark, sf).traces()
    h = F.length("trace") % 7
    told = t.withColumn("n_tool_calls", F.when(h == 0, F.col("n_tool_calls") + 1).otherwise(F.col("n_tool_calls"))).withColumn("hit_cap", (h == 1) != F.col("hit_cap")).withColumn("escalated", (h == 2) != F.col("escalated"))
    audited = X.trace_audit(told).select("item_id", "order_label", "mode", "agrees")
    return audited.join(told.select("item_id", "order_label", "mode", (h > 2).alias("untouched")), ["item_id", "order_label", "mode"]).groupBy("mode", "untouched", "agrees").agg(F.count(F.lit(1)).alias("n"))


def protocol_breaches(spark: SparkSession, sf: str) -> DataFrame:
    return X.protocol_breaches(Fixtures(spark, sf).odd_traces()).drop("rubric_version")


def odd_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """How runs ended of which some broke the protocol, with every kind of end."""
    return X.terminal_outcome(Fixtures(spark, sf).odd_traces()).drop("rubric_version")


def terminal_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return X.terminal_outcome(Fixtures(spark, sf).traces()).drop("rubric_version")


def inherited_traces(spark: SparkSession, sf: str) -> DataFrame:
    return X.inherited_traces(Fixtures(spark, sf).grades())


QUERIES = {q.__name__: q for q in (tool_usage, tool_call_counts, tool_calls_by_type, trace_audit, tool_budget, trace_events, trace_disagreements, protocol_breaches, odd_outcomes, terminal_outcome, inherited_traces)}

_ESC = "(mode <> 'single' AND seed % 13 = 0)"
_SAID = f"CASE WHEN {_ESC} AND seed % 2 = 0 THEN '  ' ELSE 'reason ' || (seed % 7) END"
_EVENTS = f"""(SELECT r.item_id, r.order_label, r.mode, 2 * i AS pos, 'api_round' AS type, NULL AS name, NULL AS reason, tokens_in, tokens_out FROM round r
    UNION ALL SELECT item_id, order_label, mode, 2 * i + 1, 'tool_call', name, NULL, NULL, NULL FROM tool
    UNION ALL SELECT item_id, order_label, mode, 2 * n_tool_calls + 1, CASE WHEN {_ESC} THEN 'escalation' ELSE 'verdict' END, NULL, {_SAID}, NULL, NULL FROM run)"""

_ODD = """(SELECT *, seed % 13 AS odd, CASE mode WHEN 'agent' THEN 6 WHEN 'verifier' THEN 3 ELSE 0 END AS budget, n_tool_calls AS n, 3 * n_tool_calls + CASE WHEN hit_cap THEN 1 ELSE 0 END AS lead FROM run)"""
_KEY = "item_id, order_label, mode"
_END = "CASE seed % 3 WHEN 0 THEN 'verdict' WHEN 1 THEN 'review' ELSE 'escalation' END"

ORACLES = {name: statement(sql) for name, sql in {
    "inherited_traces": """SELECT item_id, order_label, 'verifier' AS mode, rubric_version, '[{"type":"inherited_escalation","reason":"' || reason || '"}]' AS trace, 0 AS n_tool_calls, false AS hit_cap, true AS escalated,
        0 AS tokens_in, 0 AS tokens_out, cast(0 as double) AS latency_ms FROM grade WHERE mode = 'agent' AND escalated""",
    "tool_usage": "SELECT count(*) AS n_runs, sum(n_tool_calls) / cast(count(*) as double) AS mean_tool_calls, count(*) FILTER (WHERE hit_cap) / cast(count(*) as double) AS cap_share FROM run WHERE mode = 'agent'",
    "tool_call_counts": "SELECT name, count(*) AS n FROM tool WHERE mode = 'agent' GROUP BY name",
    "tool_calls_by_type": "SELECT coalesce(defect_type, 'CLEAN') AS defect_type, count(*) AS n_runs, sum(n_tool_calls) / cast(count(*) as double) AS mean_tool_calls FROM run r JOIN sub s ON s.item_id = r.item_id WHERE mode = 'agent' GROUP BY 1",
    "trace_audit": f"""SELECT r.item_id, r.order_label, r.mode, r.rubric_version, r.n_tool_calls AS n_calls, r.hit_cap AS capped, (r.mode <> 'single' AND seed % 13 = 0) AS gave_up, t.tokens_in, t.tokens_out, true AS agrees FROM run r
        JOIN (SELECT item_id, order_label, mode, cast(sum(tokens_in) as bigint) AS tokens_in, cast(sum(tokens_out) as bigint) AS tokens_out FROM round GROUP BY 1, 2, 3) t
        ON t.item_id = r.item_id AND t.order_label = r.order_label AND t.mode = r.mode""",
    "tool_budget": """SELECT item_id, order_label, mode, i, name, n <= b AS executed, n >= b AS forced FROM (SELECT *, row_number() OVER (PARTITION BY item_id, order_label, mode ORDER BY i) AS n,
        CASE mode WHEN 'verifier' THEN 3 ELSE 6 END AS b FROM (SELECT item_id, order_label, mode, i, name FROM tool UNION ALL SELECT item_id, order_label, mode, i + 10, name FROM tool))""",
    "trace_events": f"SELECT item_id, order_label, mode, pos, type, name, reason, tokens_in, tokens_out, length(reason) AS chars, substring(reason, 1, 200) AS preview FROM {_EVENTS}",
    "trace_disagreements": f"""SELECT mode, h > 2 AS untouched, h > 2 AS agrees, count(*) AS n FROM (SELECT mode, (2 + sum(length) + count(*) - 1) % 7 AS h FROM
        (SELECT item_id, order_label, mode, length(CASE type WHEN 'api_round' THEN '{{"type":"api_round","tokens_in":' || tokens_in || ',"tokens_out":' || tokens_out || '}}'
            WHEN 'tool_call' THEN '{{"type":"tool_call","name":"' || name || '"}}' ELSE '{{"type":"' || type || '","reason":"' || reason || '"}}' END) AS length FROM {_EVENTS}) GROUP BY item_id, order_label, mode)
        GROUP BY 1, 2, 3""",
    "protocol_breaches": f"""SELECT {_KEY}, cast(lead as int) AS pos, 'no end' AS rule FROM {_ODD} WHERE odd = 0
        UNION ALL SELECT {_KEY}, cast(lead + 2 as int), 'after the end' FROM {_ODD} WHERE odd = 1
        UNION ALL SELECT {_KEY}, 0, rule FROM {_ODD}, (VALUES ('before any round'), ('result without its call')) r(rule) WHERE odd = 2
        UNION ALL SELECT {_KEY}, 2, 'call without its result' FROM {_ODD} WHERE odd = 3 AND n > 0
        UNION ALL SELECT {_KEY}, 1, 'budget not spent' FROM {_ODD} WHERE odd = 4 AND budget > 0
        UNION ALL SELECT {_KEY}, cast(3 * k + 2 as int), 'call after budget spent' FROM {_ODD}, generate_series(0, 6) g(k) WHERE odd = 4 AND k < n
        UNION ALL SELECT {_KEY}, cast(3 * n + 1 as int), 'spent twice' FROM {_ODD} WHERE odd = 4 AND hit_cap
        UNION ALL SELECT {_KEY}, cast(3 * k + 1 as int), 'call over budget' FROM {_ODD}, generate_series(0, 13) g(k) WHERE odd = 5 AND k >= budget AND k < n + 7
        UNION ALL SELECT {_KEY}, 1, 'inherited with rounds' FROM {_ODD} WHERE odd = 6
        UNION ALL SELECT {_KEY}, 0, 'unreadable' FROM {_ODD} WHERE odd = 7""",
    "odd_outcomes": f"""SELECT {_KEY}, outcome, CASE WHEN outcome = 'none' THEN NULL WHEN seed % 2 = 0 THEN 'said' WHEN outcome = 'escalation' THEN '(no reason given)' END AS reason,
        CASE WHEN odd = 7 THEN NULL WHEN odd = 4 THEN true WHEN odd IN (5, 6) THEN false ELSE hit_cap END AS budget_exhausted
        FROM (SELECT *, CASE odd WHEN 0 THEN 'none' WHEN 1 THEN 'verdict' WHEN 5 THEN 'verdict' WHEN 6 THEN 'escalation' WHEN 7 THEN 'none' ELSE {_END} END AS outcome FROM {_ODD})""",
    "terminal_outcome": f"SELECT item_id, order_label, mode, CASE WHEN {_ESC} THEN 'escalation' ELSE 'verdict' END AS outcome, CASE WHEN {_ESC} AND seed % 2 = 0 THEN '(no reason given)' ELSE 'reason ' || (seed % 7) END AS reason, false AS budget_exhausted FROM run",
}.items()}
