"""Analytics over the JSON traces of grading runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votelens.functions.columns import ratio, strip_text
from votelens.params import DEFAULT, Params
from votelens.schemas import RUN_KEY, TRACE_EVENTS


def parsed(traces: DataFrame) -> DataFrame:
    """Traces with `events`, typed."""
    return traces.withColumn("events", F.from_json("trace", TRACE_EVENTS))


def trace_events(traces: DataFrame) -> DataFrame:
    """One row per event, in order, with the chars and the first 200 chars of what it says."""
    exploded = parsed(traces).select(*RUN_KEY, F.posexplode("events").alias("pos", "e"))
    said = F.coalesce("e.preview", "e.reason")
    return exploded.select(*RUN_KEY, "pos", "e.type", "e.name", "e.reason", "e.tokens_in", "e.tokens_out", F.length(said).alias("chars"), F.substring(said, 1, 200).alias("preview"))


def tool_usage(traces: DataFrame) -> DataFrame:
    """Of the agent arm: n_runs, mean tool calls, share of runs that hit the cap."""
    return traces.where("mode = 'agent'").agg(
        F.count(F.lit(1)).alias("n_runs"), ratio(F.sum("n_tool_calls"), F.count(F.lit(1))).alias("mean_tool_calls"), ratio(F.count_if("hit_cap"), F.count(F.lit(1))).alias("cap_share")
    )


def tool_call_counts(traces: DataFrame) -> DataFrame:
    calls = F.explode(F.filter(F.from_json("trace", "array<struct<type:string,name:string>>"), lambda e: e["type"] == "tool_call")).alias("e")
    return traces.where("mode = 'agent'").select(calls).groupBy(F.col("e.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def tool_calls_by_type(traces: DataFrame, truth: DataFrame) -> DataFrame:
    joined = traces.where("mode = 'agent'").select("item_id", "n_tool_calls").join(truth.select("item_id", F.coalesce("defect_type", F.lit("CLEAN")).alias("defect_type")), "item_id")
    return joined.groupBy("defect_type").agg(F.count(F.lit(1)).alias("n_runs"), ratio(F.sum("n_tool_calls"), F.count(F.lit(1))).alias("mean_tool_calls"))


def trace_audit(traces: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """What the events say of a run (tool calls, cap, escalation, tokens), and whether the stored columns agree."""
    e = F.col("events")

    def total(name: str) -> Column:
        return F.aggregate(e, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x[name], F.lit(0)))

    calls = F.size(F.filter(e, lambda x: x["type"] == "tool_call"))
    cap = F.when(F.col("mode") == "agent", p.max_tool_calls).when(F.col("mode") == "verifier", p.verifier_tool_calls)
    out = parsed(traces).select(
        *RUN_KEY, calls.alias("n_calls"), F.coalesce(calls >= cap, F.lit(False)).alias("capped"),
        F.exists(e, lambda x: x["type"].isin("escalation", "inherited_escalation")).alias("gave_up"),
        total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"), "n_tool_calls", "hit_cap", "escalated",
    )
    agrees = (F.col("n_calls") == F.col("n_tool_calls")) & (F.col("capped") == F.col("hit_cap")) & (F.col("gave_up") == F.col("escalated"))
    return out.withColumn("agrees", agrees).drop("n_tool_calls", "hit_cap", "escalated")


# The events that end a run, and those that only a grader's own round makes.
ENDS = ("verdict", "review", "escalation", "inherited_escalation")
IN_ROUND = ("tool_call", "tool_result", "tool_refused", "invalid_verdict", "invalid_review", "call_failed", "budget_exhausted", "verdict", "review", "escalation")


def protocol_breaches(traces: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """run key, pos, rule: each event that a run may not have where it stands, and runs without an end (pos is their length).

    The events are folded, in order, through a small automaton whose state is the calls so far, whether the budget was
    declared spent, which call awaits its result, and how the run ended.  Rules: `before any round`, `after the end`,
    `call over budget`, `call after budget spent`, `result without its call`, `call without its result`, `budget not spent`,
    `spent twice`, `inherited with rounds`, `no end`, and `unreadable` for a trace that is no list of events.  A run is one
    row, and none is joined or gathered.
    """
    budget = F.when(F.col("mode") == "agent", p.max_tool_calls).when(F.col("mode") == "verifier", p.verifier_tool_calls).otherwise(0)
    start = F.struct(
        F.lit(0).alias("pos"), F.lit(0).alias("calls"), F.lit(0).alias("rounds"), F.lit(False).alias("spent"), F.lit(None).cast("string").alias("waiting"), F.lit(False).alias("ended"),
        F.array().cast("array<struct<pos:int,rule:string>>").alias("found"),
    )

    def step(s: Column, e: Column) -> Column:
        kind, call, result = e["type"], e["type"] == "tool_call", e["type"] == "tool_result"
        kept = s["waiting"].isNotNull() & ~(result & e["name"].eqNullSafe(s["waiting"]))
        broken = {
            "after the end": s["ended"], "before any round": kind.isin(*IN_ROUND) & (s["rounds"] == 0), "call after budget spent": call & s["spent"],
            "call over budget": call & ~s["spent"] & (s["calls"] >= budget), "result without its call": result & ~e["name"].eqNullSafe(s["waiting"]),
            "call without its result": kept & ~result, "budget not spent": (kind == "budget_exhausted") & (s["calls"] < budget), "spent twice": (kind == "budget_exhausted") & s["spent"],
            "inherited with rounds": (kind == "inherited_escalation") & (s["rounds"] > 0),
        }
        marks = F.array_compact(F.array(*[F.when(test, F.struct(s["pos"].alias("pos"), F.lit(rule).alias("rule"))) for rule, test in broken.items()]))
        return F.struct(
            (s["pos"] + 1).alias("pos"), (s["calls"] + call.cast("int")).alias("calls"), (s["rounds"] + (kind == "api_round").cast("int")).alias("rounds"),
            (s["spent"] | (kind == "budget_exhausted")).alias("spent"), F.when(call, e["name"]).alias("waiting"), (s["ended"] | kind.isin(*ENDS)).alias("ended"),
            F.concat(s["found"], marks).alias("found"),
        )

    def finish(s: Column) -> Column:
        last = F.when(~s["ended"], F.array(F.struct(s["pos"].alias("pos"), F.lit("no end").alias("rule")))).otherwise(F.array().cast("array<struct<pos:int,rule:string>>"))
        return F.concat(s["found"], last)

    unreadable = F.array(F.struct(F.lit(0).alias("pos"), F.lit("unreadable").alias("rule")))

    def folded(s: Column) -> Column:
        whole, size = s["whole"], F.size(s["events"])
        return F.when(s["events"].isNull() | (F.size(whole) < size), unreadable).otherwise(F.aggregate(whole, start, step, finish))

    # a lambda's argument is computed once; exploded as an expression, as Spark would also filter by a column, and compute it anew for that
    events = F.transform(F.array(F.from_json("trace", TRACE_EVENTS)), lambda e: F.struct(e.alias("events"), F.filter(e, lambda x: x["type"].isNotNull()).alias("whole")))
    return traces.select(*RUN_KEY, F.explode(F.element_at(F.transform(events, folded), 1)).alias("f")).select(*RUN_KEY, "f.*")


def tool_budget(requests: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Requested evidence calls in order: the first of a run up to its arm's budget are executed, later ones are refused;
    `forced` once the budget is used up.  A run is one small window."""
    budget = F.when(F.col("mode") == "verifier", p.verifier_tool_calls).otherwise(p.max_tool_calls)
    n = F.count(F.lit(1)).over(Window.partitionBy(*RUN_KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("n", n).withColumn("executed", F.col("n") <= budget).withColumn("forced", F.col("n") >= budget)


def inherited_traces(grades: DataFrame) -> DataFrame:
    """The verifier arm's traces of runs that the agent had escalated: one event, no calls, no tokens."""
    event = F.struct(F.lit("inherited_escalation").alias("type"), F.col("reason").alias("reason"))
    return grades.where("mode = 'agent' and escalated").select(
        "item_id", "order_label", F.lit("verifier").alias("mode"), "rubric_version", F.to_json(F.array(event)).alias("trace"), F.lit(0).alias("n_tool_calls"),
        F.lit(False).alias("hit_cap"), F.lit(True).alias("escalated"), F.lit(0).alias("tokens_in"), F.lit(0).alias("tokens_out"), F.lit(0.0).alias("latency_ms"),
    )


def terminal_outcome(traces: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """How each run ended: outcome (verdict, review, escalation or none), reason, budget_exhausted."""
    ends = F.filter("events", lambda x: x["type"].isin("verdict", "review", "escalation", "inherited_escalation"))
    last = F.try_element_at(ends, F.lit(-1))
    said = F.nullif(strip_text(last["reason"]), F.lit(""))
    outcome = F.when(last["type"].isNull(), "none").when(last["type"] == "inherited_escalation", "escalation").otherwise(last["type"])
    return parsed(traces).select(
        *RUN_KEY, outcome.alias("outcome"), F.when(outcome == "escalation", F.coalesce(said, F.lit(p.no_reason))).otherwise(said).alias("reason"),
        F.exists("events", lambda x: x["type"] == "budget_exhausted").alias("budget_exhausted"),
    )
