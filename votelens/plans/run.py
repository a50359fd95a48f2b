"""The whole job in stages with gates: from submissions to grades, routes, flags and metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votelens.operators import checks, evaluation, evidence, grading, scoring, signals
from votelens.operators.preparation import order_views
from votelens.operators.traces import inherited_traces
from votelens.params import DEFAULT, MODES, ORDERS, RUBRIC_VERSION, Params


class GateClosed(RuntimeError):
    """A stage left something undone, so the next one did not begin."""


def require_none(df: DataFrame, what: str) -> None:
    """Stops at a table that must be empty, with how many rows it has and one of them."""
    n = df.count()
    if n:
        raise GateClosed(f"{what}: {n}, such as {df.first().asDict()}")


@dataclass(frozen=True)
class Results:
    """Tables of a run; `scored` and `flags` are the bases of the metrics and are kept."""

    grades: DataFrame
    call_log: DataFrame
    traces: DataFrame
    routed: DataFrame
    scored: DataFrame
    flags: DataFrame
    sweep: DataFrame
    ablation: DataFrame
    marginal: DataFrame
    layer0: DataFrame
    escalations: DataFrame

    def release(self) -> None:
        for f in fields(self):
            getattr(self, f.name).unpersist()


def requests_for(bundle: DataFrame, mode: str) -> DataFrame:
    """A request per view and arm; without evidence for the arm that may not look anything up."""
    return bundle.withColumn("mode", F.lit(mode)).withColumn("rubric_version", F.lit(RUBRIC_VERSION))


def _gate(requests: DataFrame, journal: DataFrame, what: str) -> None:
    """Every request has an end that is not a failure."""
    key = ["item_id", "order_label", "mode", "rubric_version"]
    require_none(scoring.failures(journal).join(requests.select(*key), key, "left_semi"), f"{what}: failed runs")
    done = journal.where("outcome is not null").select(*key)
    require_none(requests.select(*key).join(done, key, "left_anti"), f"{what}: runs without an end")


def grade_in_stages(
    items: DataFrame, submissions: DataFrame, peers: DataFrame, make_model: Callable[[], scoring.Model], path: str, modes: tuple[str, ...] = MODES,
    smoke: int = 10, p: Params = DEFAULT, waves: int = 8, again: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(grades, journal) of all arms.  Each stage begins only if the one before left nothing undone:

    every item has a submission; `smoke` items pass the first arm in the original order; each arm grades all items in both
    orders; the verifier reviews what the agent graded.  A stage that was stopped resumes from the journal under `path`;
    with `again`, runs that failed are tried anew.
    """
    require_none(items.select("item_id").join(submissions.select("item_id"), "item_id", "left_anti"), "items without a submission")
    views = order_views(items, submissions)
    bundle = evidence.evidence_bundle(views, submissions, peers)
    first = "agent" if "agent" in modes else modes[0]
    if smoke and first != "verifier":
        some = requests_for(bundle.join(F.broadcast(items.select("item_id").orderBy("item_id").limit(smoke)), "item_id"), first).where(F.col("order_label") == ORDERS[0])
        _gate(some, scoring.grade_all(some, make_model, path, p, 1, again=again), "smoke test")
    journal = scoring.read_journal(items, path)
    for mode in modes:
        if mode == "verifier":
            done = scoring.graded(journal)
            require_none(checks.pending_work(items, done, ("agent",)), "verifier: items without an agent's grade")
            said = evidence.verify_requests(done, bundle).select("item_id", "order_label", "grader_verdict", "grader_confidence", "dimension_scores", "reason")
            requests = requests_for(bundle.join(said, ["item_id", "order_label"]), mode)
        else:
            requests = requests_for(bundle, mode)
        journal = scoring.grade_all(requests, make_model, path, p, waves, again=again)
        _gate(requests, journal, mode)
    grades = scoring.graded(journal)
    if "verifier" in modes:
        exhausted = scoring.reviewed(journal).select("item_id", "order_label", "budget_exhausted")
        arm = grading.verifier_grades(grades, scoring.reviewed(journal), p).drop("inherited").join(exhausted, ["item_id", "order_label"], "left")
        grades = grades.unionByName(arm.withColumn("budget_exhausted", F.coalesce("budget_exhausted", F.lit(False)) & ~F.col("escalated")).select(*grades.columns))
    return grades, journal


def evaluate(submissions: DataFrame, grades: DataFrame, journal: DataFrame, model: str, mock: bool = False, p: Params = DEFAULT) -> Results:
    """Routes, flags and metrics of graded items.

    Grades, records and flags feed several reports, so they are persisted (to disk where memory is short) instead of being
    made anew for each.
    """
    keep = StorageLevel.MEMORY_AND_DISK
    grades = grades.persist(keep)
    truth = submissions.select("item_id", "annotator_id", "vote", "is_defective", "defect_type")
    scored = evaluation.scored_records(grades, truth, p).persist(keep)
    flags = signals.annotator_flags(submissions, p).persist(keep)
    call_log = scoring.call_rows(journal, model, mock)
    costs = checks.arm_spending(call_log)
    traces = scoring.run_traces(journal, p)
    inherited = _inherited(grades, traces)
    return Results(
        grades=grades, call_log=checks.with_cost(call_log, p), traces=traces.unionByName(inherited), routed=evaluation.route_items(grades, p), scored=scored, flags=flags,
        sweep=evaluation.calibration_sweep(scored, costs, p), ablation=evaluation.ablation_table(scored, p),
        marginal=evaluation.marginal_cost(evaluation.with_arm_cost(evaluation.flag_metrics(scored, ["mode"], p), costs)),
        layer0=evaluation.layer0_effect(evaluation.pooled_by_flag(scored, flags), costs, p), escalations=evaluation.escalation_report(scored, p),
    )


def _inherited(grades: DataFrame, traces: DataFrame) -> DataFrame:
    """Traces of the verifier's runs that the agent's escalations stand for, where there is a verifier's arm."""
    arm = grades.where("mode = 'verifier'").select("item_id", "order_label")
    return inherited_traces(grades.join(arm, ["item_id", "order_label"], "left_semi")).select(*traces.columns)
