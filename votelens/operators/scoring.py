"""Whole grading runs by a caller's model: retries, evidence, budgets, a journal, and the tables that a run leaves.

A run is one (item, order, mode, rubric version).  Each call of the model is a row of the journal, with what was said and what
came of it; grades, traces, the call log and failures are plain queries over the journal.  A run that fails is a row like any
other, and the rest go on.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.operators.grading import validate_reviews, validate_verdicts
from votelens.operators.preparation import evidence_error
from votelens.params import DEFAULT, RUBRIC, Params
from votelens.schemas import RUN_KEY
from votelens.sources.tables import exists, scratch

# ---------------------------------------------------------------- what a caller supplies


@dataclass(frozen=True)
class Action:
    """What a model asks for: an evidence tool by its name, `emit_verdict` (`emit_review` of a verifier's run), or
    `flag_for_review`, with arguments."""

    name: str
    args: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Reply:
    actions: tuple[Action, ...]
    tokens_in: int = 0
    tokens_out: int = 0


#: Called with the request's columns and all rounds so far (each with its events); may raise, which counts as a failed try.
Model = Callable[[dict[str, Any], list[dict[str, Any]]], Reply]

# ---------------------------------------------------------------- one run


def _number(value: Any) -> float | None:
    try:
        return None if isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return None


def _said(args: dict[str, Any], field: str, allowed: tuple[str, str]) -> str | None:
    if args.get(field) not in allowed:
        return field
    confidence = _number(args.get("confidence"))
    if confidence is None or not 0 <= confidence <= 1:
        return "confidence"
    return None if str(args.get("reason") or "").strip() else "reason"


def verdict_problem(args: dict[str, Any]) -> str | None:
    """The first field of a verdict that breaks a rule; the rules are those of `grading.validate_verdicts`."""
    scores = args.get("dimension_scores")
    values = [_number(v) for v in scores.values()] if isinstance(scores, dict) else [None]
    if any(v is None or v != v // 1 or not 0 <= v <= 5 for v in values):
        return "dimension_scores"
    return _said(args, "verdict", ("accept", "reject")) or (None if set(scores) == set(RUBRIC) else "dimensions")


def review_problem(args: dict[str, Any]) -> str | None:
    """The same of a review; the rules are those of `grading.validate_reviews`."""
    return _said(args, "decision", ("uphold", "overturn"))


#: How a run may end by what it emits: the event, the fields that it tells, and the rules.
ENDINGS = {"emit_verdict": ("verdict", ("verdict", "confidence", "reason"), verdict_problem), "emit_review": ("review", ("decision", "confidence", "reason"), review_problem)}


def look_up(request: dict[str, Any], action: Action, p: Params) -> str:
    """The evidence that an action asks for, out of the request's own bundle, or why it may not be had."""
    args = action.args
    error = evidence_error(action.name, args, request)
    if error:
        return json.dumps({"error": error})
    if action.name == "get_annotator_history":
        limit = min(int(args.get("limit") or p.history_limit), p.history_cap)
        return json.dumps({"annotator_id": request["annotator_id"], "submissions": [dict(h) for h in list(request["history"])[:limit]]})
    if action.name == "get_peer_judgments":
        return json.dumps({"item_id": request["item_id"], "peer_votes": [dict(v) for v in request["peers"]]})
    return json.dumps({"which": args["which"].upper(), "full_text": request[f"response_{args['which']}"]})


def run(request: dict[str, Any], model: Model, p: Params = DEFAULT) -> Iterator[dict[str, Any]]:
    """The rounds of one run, each as soon as it is over: round, tokens, latency, events, outcome.

    `outcome` is null until the last round, which has verdict, review, escalation or failed.  A call that raises, gives no action or
    gives a verdict that breaks a rule is a failed try, of which a run has `max_attempts`.  Evidence is given up to the
    mode's budget, and refused beyond; once it is used up only a verdict is asked for (`budget_exhausted`).
    """
    budget = {"agent": p.max_tool_calls, "verifier": p.verifier_tool_calls}.get(request["mode"], 0)
    rounds: list[dict[str, Any]] = []
    failures = n_calls = 0
    forced = False
    while True:
        began = time.monotonic()
        events: list[dict[str, Any]] = []
        outcome = payload = error = None
        try:
            reply = model(request, rounds)
        except Exception as e:  # noqa: BLE001  (whatever a client raises is a row, not the end of the job)
            reply, error = Reply(()), f"{type(e).__name__}: {e}"
            events.append({"type": "call_failed", "error": error})
        else:
            error = None if reply.actions else "no action"
        for action in reply.actions:
            if action.name == ("emit_review" if request["mode"] == "verifier" else "emit_verdict"):
                kind, told, problem = ENDINGS[action.name]
                error = problem(action.args)
                if error:
                    events.append({"type": f"invalid_{kind}", "error": error})
                    continue
                outcome, payload = kind, json.dumps(action.args)
                events.append({"type": kind, **{k: action.args[k] for k in told}, "budget_exhausted": forced})
            elif action.name == "flag_for_review":
                outcome, payload = "escalation", json.dumps({"reason": str(action.args.get("reason") or "").strip() or p.no_reason})
                events.append({"type": "escalation", "reason": json.loads(payload)["reason"]})
            elif n_calls >= budget:
                events.append({"type": "tool_refused", "name": action.name})
            else:
                n_calls += 1
                found = look_up(request, action, p)
                events.append({"type": "tool_call", "name": action.name, "args": json.dumps(action.args)})
                events.append({"type": "tool_result", "name": action.name, "chars": len(found), "preview": found[:200], "text": found})
            if outcome:
                break
        if error and not outcome:
            failures += 1
            outcome = "failed" if failures >= p.max_attempts else None
        if budget and n_calls >= budget and not forced and not outcome:
            forced = True
            events.append({"type": "budget_exhausted"})
        this = {
            "round": len(rounds) + 1, "tokens_in": reply.tokens_in, "tokens_out": reply.tokens_out, "latency_ms": round((time.monotonic() - began) * 1000, 1),
            "events": events, "n_tool_calls": n_calls, "budget_exhausted": forced, "error": error, "outcome": outcome, "payload": payload,
        }
        rounds.append(this)
        yield this
        if outcome:
            return


# ---------------------------------------------------------------- the journal

JOURNAL = (
    "item_id string, order_label string, mode string, rubric_version string, pass int, round int, tokens_in int, tokens_out int, latency_ms double, "
    "events string, n_tool_calls int, budget_exhausted boolean, error string, outcome string, payload string"
)


def _told(rounds: Iterator[dict[str, Any]]) -> Iterator[tuple[Any, ...]]:
    """Rounds as the journal has them, from `round` on: events as JSON, after the round's own, without the full texts that only the model saw."""
    for r in rounds:
        first = {"type": "api_round", "tokens_in": r["tokens_in"], "tokens_out": r["tokens_out"], "latency_ms": r["latency_ms"]}
        said = [{k: v for k, v in e.items() if k != "text"} if "text" in e else e for e in r["events"]]
        yield (
            r["round"], r["tokens_in"], r["tokens_out"], r["latency_ms"], json.dumps([first, *said]), r["n_tool_calls"], r["budget_exhausted"], r["error"], r["outcome"],
            r["payload"],
        )


#: A worker holds the rounds of so many requests at a time, however many rows a batch has.
REQUESTS = 256


def journal_of(requests: DataFrame, make_model: Callable[[], Model], p: Params = DEFAULT) -> DataFrame:
    """The rounds of each request's run; one model per partition."""
    names = [c.split()[0] for c in JOURNAL.split(", ")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            for at in range(0, len(frame), REQUESTS):
                rows: list[tuple[Any, ...]] = []
                for request in frame.iloc[at : at + REQUESTS].to_dict("records"):
                    key = (*(request[k] for k in RUN_KEY), request["pass"])
                    rows += [key + told for told in _told(run(request, model, p))]
                yield pd.DataFrame(rows, columns=names)

    return requests.mapInPandas(work, JOURNAL)


def read_journal(requests: DataFrame, path: str) -> DataFrame:
    spark = requests.sparkSession
    return spark.read.schema(JOURNAL).parquet(path) if exists(spark, path) else spark.createDataFrame([], JOURNAL)


#: Each core gets about so many tasks of a wave, so that none waits long for the last.
TURNS = 4
WAVE = "_wave"


def grade_all(
    requests: DataFrame, make_model: Callable[[], Model], path: str, p: Params = DEFAULT, waves: int = 8, tasks: int | None = None, again: bool = False,
) -> DataFrame:
    """Runs every request that the journal under `path` has no end of, and gives back the journal.

    Work goes in `waves` (by a hash of the key), each a job that adds its rounds to the journal when it ends; so what is
    lost with the driver is one wave, and with an executor its unfinished tasks, and no run that is in the journal is called
    again.  What there is to do is found once and stored by wave: neither the requests nor the journal are read for each.
    `tasks` bounds how many clients run at a time.  With `again`, failed runs are tried anew, as a further pass.
    Requests have the run's key and what the model needs; for evidence, the columns of `evidence.evidence_bundle`.
    """
    spark = requests.sparkSession
    known = read_journal(requests, path).where("outcome is not null")
    ended = known.groupBy(*RUN_KEY).agg(F.max(F.struct("pass", F.col("outcome").alias("ended"))).alias("last")).select(*RUN_KEY, "last.*")
    todo = requests.join(ended, [*RUN_KEY], "left")
    todo = todo.where(F.col("ended").isNull() | ((F.col("ended") == "failed") & F.lit(again))).drop("ended")
    todo = todo.withColumn("pass", (F.coalesce("pass", F.lit(0)) + 1).cast("int")).withColumn(WAVE, F.pmod(F.xxhash64(*RUN_KEY), F.lit(waves)).cast("int"))
    at = scratch(spark, "requests")
    todo.write.partitionBy(WAVE).parquet(at)
    left = spark.read.schema(todo.schema).parquet(at)
    for wave, n in sorted(tuple(r) for r in left.groupBy(WAVE).count().collect()):  # at most a row for each wave
        dealt = tasks or min(TURNS * spark.sparkContext.defaultParallelism, -(-n // REQUESTS))
        journal_of(left.where(F.col(WAVE) == wave).drop(WAVE).repartition(dealt, *RUN_KEY), make_model, p).write.mode("append").parquet(path)
    return read_journal(requests, path)


# ---------------------------------------------------------------- what runs leave


def call_id(*more: Column | str) -> Column:
    """An id that a repeated write of the same call has too."""
    return F.sha1(F.concat_ws("|", *RUN_KEY, *more))


def call_rows(journal: DataFrame, model: str, mock: bool = False) -> DataFrame:
    """The call log: a row per call of the model; of a run's calls, `attempts` counts from 1 over all passes."""
    earlier = F.row_number().over(_run_window())
    return journal.select(
        call_id(F.col("pass").cast("string"), F.col("round").cast("string")).alias("call_id"), *RUN_KEY, F.lit("grade").alias("purpose"), F.lit(model).alias("model"),
        F.lit(mock).alias("mock"), "tokens_in", "tokens_out", "latency_ms", earlier.alias("attempts"),
    )


def _run_window():
    from pyspark.sql import Window

    return Window.partitionBy(*RUN_KEY).orderBy("pass", "round")


def _last_pass(journal: DataFrame) -> DataFrame:
    """A row per run: its last pass's rounds together, gathered in one shuffle.  A pass has at most its budget and its tries of them."""
    one = F.struct("pass", "round", "events", "tokens_in", "tokens_out", "latency_ms", "n_tool_calls", "budget_exhausted", "error", "outcome", "payload")
    runs = journal.groupBy(*RUN_KEY).agg(F.array_sort(F.collect_list(one)).alias("rounds"))
    last = runs.withColumn("rounds", F.filter("rounds", lambda r: r["pass"] == F.element_at("rounds", -1)["pass"]))
    return last.withColumn("end", F.element_at("rounds", -1)).where(F.col("end")["outcome"].isNotNull())


def graded(journal: DataFrame) -> DataFrame:
    """The rows of `grades` that runs with a verdict or an escalation give; a verifier's runs give reviews instead."""
    ended = _last_pass(journal).where("mode <> 'verifier'").where(F.col("end")["outcome"] != "failed").select(
        *RUN_KEY, F.col("end")["payload"].alias("payload"), F.col("end")["outcome"].alias("outcome"), F.col("end")["budget_exhausted"].alias("budget_exhausted")
    )
    checked = validate_verdicts(ended)
    escalated = F.col("outcome") == "escalation"
    return checked.select(
        *RUN_KEY, F.when(~escalated, F.to_json("scores")).alias("dimension_scores"), F.when(~escalated, F.col("verdict")).alias("verdict"),
        F.when(~escalated, F.col("confidence")).alias("confidence"), "reason", escalated.alias("escalated"), (F.col("budget_exhausted") & ~escalated).alias("budget_exhausted"),
    )


def reviewed(journal: DataFrame) -> DataFrame:
    """item_id, order_label, rubric_version, decision, confidence, reason, escalated, budget_exhausted of the verifier's runs."""
    ended = _last_pass(journal).where("mode = 'verifier'").where(F.col("end")["outcome"] != "failed")
    told = ended.select(*RUN_KEY, F.col("end")["payload"].alias("payload"), (F.col("end")["outcome"] == "escalation").alias("escalated"), F.col("end")["budget_exhausted"].alias("budget_exhausted"))
    return validate_reviews(told).select("item_id", "order_label", "rubric_version", "decision", "confidence", "reason", "escalated", "budget_exhausted")


def run_traces(journal: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The rows of `traces`: all events of a run in order, as JSON, with its totals; failed runs have theirs too."""
    rounds, end = F.col("rounds"), F.col("end")

    def total(name: str, zero: Column) -> Column:
        return F.aggregate(rounds, zero, lambda acc, r: acc + r[name])

    inner = F.transform(rounds, lambda r: F.substring(r["events"], F.lit(2), F.length(r["events"]) - 2))
    budget = F.when(F.col("mode") == "agent", p.max_tool_calls).when(F.col("mode") == "verifier", p.verifier_tool_calls)
    return _last_pass(journal).select(
        *RUN_KEY, F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]")).alias("trace"), end["n_tool_calls"].alias("n_tool_calls"),
        F.coalesce(end["n_tool_calls"] >= budget, F.lit(False)).alias("hit_cap"), (end["outcome"] == "escalation").alias("escalated"),
        total("tokens_in", F.lit(0)).alias("tokens_in"), total("tokens_out", F.lit(0)).alias("tokens_out"), total("latency_ms", F.lit(0.0)).alias("latency_ms"),
    )


def failures(journal: DataFrame) -> DataFrame:
    """A row per run whose last pass failed: its key, how many calls that pass made, and the last error."""
    return _last_pass(journal).where(F.col("end")["outcome"] == "failed").select(
        *RUN_KEY, F.size("rounds").alias("calls"), F.col("end")["error"].alias("error")
    )


