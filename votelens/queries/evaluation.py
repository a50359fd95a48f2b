"""Scores, routes and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votelens.functions import columns as C
from votelens.operators import checks
from votelens.operators import evaluation as E
from votelens.operators.signals import annotator_flags, overlaid
from votelens.params import DEFAULT, DEFECT_TYPES
from votelens.queries.signals import ARM
from votelens.queries.sql import TYPES, by_type, metrics, score, statement
from votelens.sources import tables
from votelens.sources.fixtures import Fixtures


def _scored(f: Fixtures) -> DataFrame:
    return E.scored_records(f.grades(), f.truth())


def _pool_by_flag(f: Fixtures) -> DataFrame:
    return E.pooled_by_flag(_scored(f), annotator_flags(f.submissions()))


def paired_grades(spark: SparkSession, sf: str) -> DataFrame:
    return E.paired_grades(Fixtures(spark, sf).grades())


def acceptance_score(spark: SparkSession, sf: str) -> DataFrame:
    g = Fixtures(spark, sf).grades().where("not escalated")
    both = F.explode(F.array(F.lit(False), F.lit(True)))
    return g.withColumn("flipped", both).select(
        "item_id", "order_label", "mode", "flipped", C.acceptance_score(F.col("verdict"), F.col("confidence"), F.col("flipped")).alias("score")
    )


def route_items(spark: SparkSession, sf: str) -> DataFrame:
    return E.route_items(Fixtures(spark, sf).grades())


def route_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.route_summary(route_items(spark, sf))


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return route_items(spark, sf).where("route = 'human_review'").select("item_id", "mode", "path", "confidence", "reason")


def scored_records(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(Fixtures(spark, sf))


def flag_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Over all arms' records together."""
    return E.flag_metrics(_scored(Fixtures(spark, sf)).withColumn("arms", F.lit("all")), ["arms"])


def operating_point(spark: SparkSession, sf: str) -> DataFrame:
    return E.flag_metrics(_scored(Fixtures(spark, sf)), ["mode"])


def recall_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return E.recall_by_type(_scored(Fixtures(spark, sf)), ["mode"])


def calibration_sweep(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return E.calibration_sweep(_scored(f), checks.arm_spending(f.call_log()))


def csv_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep as CSV, read back."""
    path = tables.scratch(spark, "calibration")
    sweep = calibration_sweep(spark, sf)
    tables.write_csv(sweep, path)
    return spark.read.schema(sweep.schema).csv(path, header=True)


def ablation_table(spark: SparkSession, sf: str) -> DataFrame:
    return E.ablation_table(_scored(Fixtures(spark, sf)))


def marginal_cost(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return E.marginal_cost(E.with_arm_cost(E.flag_metrics(_scored(f), ["mode"]), checks.arm_spending(f.call_log())))


def layer0_effect(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return E.layer0_effect(_pool_by_flag(f), checks.arm_spending(f.call_log()))


def layer0_deltas(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    pool = _pool_by_flag(f)
    return E.layer0_deltas(pool, overlaid(pool))


def escalation_report(spark: SparkSession, sf: str) -> DataFrame:
    return E.escalation_report(_scored(Fixtures(spark, sf)))


def escalated_detail(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    said = F.array_join(F.transform("orders", lambda o: F.concat_ws(":", o["order"], F.coalesce(o["verdict"], F.lit("none")), o["escalated"].cast("string"))), ",")
    return E.escalated_detail(_scored(f), f.grades()).select("item_id", "defect_type", said.alias("orders"))


def missed_items(spark: SparkSession, sf: str) -> DataFrame:
    return E.missed_items(_scored(Fixtures(spark, sf)), "POSITION_BIAS").select("item_id", "mode", "score")


QUERIES = {q.__name__: q for q in (
    paired_grades, acceptance_score, route_items, route_summary, review_queue, scored_records, flag_metrics, operating_point, recall_by_type,
    calibration_sweep, csv_sweep, ablation_table, marginal_cost, layer0_effect, layer0_deltas, escalation_report, escalated_detail, missed_items,
)}

_SCORE = score("verdict_original", "confidence", "verdict_original <> verdict_swapped")
_ROUTED = f"""(SELECT item_id, mode, rubric_version, verdict_original, verdict_swapped, CASE WHEN NOT escalated THEN verdict_original <> verdict_swapped END AS flipped, score AS confidence,
    CASE WHEN escalated THEN 'human_review' WHEN score >= cast(0.75 as double) THEN 'auto_accept' WHEN score <= cast(0.35 as double) THEN 'auto_reject' ELSE 'human_review' END AS route,
    CASE WHEN escalated THEN 'AGENT_ESCALATED' WHEN score >= cast(0.75 as double) OR score <= cast(0.35 as double) THEN 'AUTO' ELSE 'THRESHOLD_ROUTED' END AS path, reason
    FROM (SELECT *, CASE WHEN NOT escalated THEN {_SCORE} END AS score FROM paired))"""
_TYPED = f"""(SELECT m.mode, t.defect_type, coalesce(n_type, 0) AS n_type, recall, catch_rate FROM (SELECT DISTINCT mode FROM scored) m CROSS JOIN {TYPES}
    LEFT JOIN ({by_type('scored', 'mode')}) x ON x.mode = m.mode AND x.defect_type = t.defect_type)"""


def _sweep() -> str:
    grid = ", ".join(f"(cast({hi} as double), cast({lo} as double))" for hi in DEFAULT.sweep_high for lo in DEFAULT.sweep_low if lo < hi)
    flag = "(NOT escalated AND score <= low)"
    typed = ", ".join(
        f"count(*) FILTER (WHERE defect_type = '{t}' AND {flag}) / cast(nullif(count(*) FILTER (WHERE defect_type = '{t}'), 0) as double) AS recall_{t}, "
        f"count(*) FILTER (WHERE defect_type = '{t}' AND (escalated OR {flag})) / cast(nullif(count(*) FILTER (WHERE defect_type = '{t}'), 0) as double) AS catch_{t}"
        for t in DEFECT_TYPES
    )
    base = metrics("scored", "mode, high, low", "high", "low").replace("FROM scored", f"FROM scored CROSS JOIN (VALUES {grid}) g(high, low)").replace(" AS review_load", f" AS review_load, {typed}")
    return f"SELECT s.*, a.cost_per_1000_usd, high = cast(0.75 as double) AND low = cast(0.35 as double) AS operating FROM ({base}) s JOIN {ARM} a ON a.mode = s.mode"


def _marginal() -> str:
    gain = "nullif(greatest((b.{0} - a.{0}) * cast(100 as double), 0), 0)"
    return f"""SELECT b.mode || '_vs_' || a.mode AS pair, (cb.cost_per_1000_usd - ca.cost_per_1000_usd) / {gain.format('recall')} AS per_recall_point,
        (cb.cost_per_1000_usd - ca.cost_per_1000_usd) / {gain.format('catch_rate')} AS per_catch_point FROM ({metrics('scored', 'mode')}) a JOIN ({metrics('scored', 'mode')}) b
        ON (a.mode, b.mode) IN (('single', 'agent'), ('single', 'verifier'), ('agent', 'verifier')) JOIN {ARM} ca ON ca.mode = a.mode JOIN {ARM} cb ON cb.mode = b.mode"""


_ABLATION = f"""SELECT defect_type, {", ".join(f"max(CASE WHEN mode = '{m}' THEN {c} END) AS {n}" for m, c, n in (
    ('single', 'recall', 'recall_single'), ('agent', 'recall', 'recall_agent'), ('agent', 'catch_rate', 'catch_agent'), ('verifier', 'recall', 'recall_verifier'), ('verifier', 'catch_rate', 'catch_verifier')))}
    FROM (SELECT mode, defect_type, recall, catch_rate FROM ({by_type('scored', 'mode')}) UNION ALL SELECT mode, 'Overall', recall, catch_rate FROM ({metrics('scored', 'mode')})) GROUP BY defect_type"""
_MID = "(NOT escalated AND score > cast(0.35 as double) AND score < cast(0.75 as double))"

ORACLES = {name: statement(sql) for name, sql in {
    "paired_grades": "SELECT item_id, mode, rubric_version, verdict_original, verdict_swapped, confidence, reason, escalated FROM paired",
    "acceptance_score": f"SELECT item_id, order_label, mode, flipped, {score('verdict', 'confidence', 'flipped')} AS score FROM grade CROSS JOIN (VALUES (true), (false)) f(flipped) WHERE NOT escalated",
    "route_items": f"SELECT * FROM {_ROUTED}",
    "route_summary": f"SELECT mode, route, path, count(*) AS n FROM {_ROUTED} GROUP BY 1, 2, 3",
    "review_queue": f"SELECT item_id, mode, path, confidence, reason FROM {_ROUTED} WHERE route = 'human_review'",
    "scored_records": "SELECT item_id, mode, score, flipped, escalated, is_defective, defect_type, annotator_id FROM scored",
    "flag_metrics": metrics("(SELECT *, 'all' AS arms FROM scored)", "arms"),
    "operating_point": metrics("scored", "mode"),
    "recall_by_type": f"SELECT * FROM {_TYPED}",
    "calibration_sweep": _sweep(),
    "csv_sweep": _sweep(),
    "ablation_table": _ABLATION,
    "marginal_cost": _marginal(),
    "layer0_effect": f"""SELECT m.*, a.cost_per_1000_usd FROM (SELECT *, false AS layer0 FROM ({metrics('scored', 'mode')}) UNION ALL SELECT *, true FROM ({metrics('overlaid', 'mode')})) m
        JOIN {ARM} a ON a.mode = m.mode WHERE m.mode <> 'verifier'""",
    "layer0_deltas": f"""SELECT x.mode, x.defect_type, x.recall AS before, y.recall AS after FROM ({by_type('scored', 'mode')}) x JOIN ({by_type('overlaid', 'mode')}) y
        ON y.mode = x.mode AND y.defect_type = x.defect_type WHERE x.mode <> 'verifier' AND x.recall <> y.recall""",
    "escalation_report": f"""SELECT count(*) FILTER (WHERE escalated) AS n_agent_escalated, count(*) FILTER (WHERE {_MID}) AS n_threshold_routed,
        count(*) FILTER (WHERE escalated AND is_defective) AS escalated_defective, count(*) FILTER (WHERE {_MID} AND is_defective) AS threshold_defective FROM scored WHERE mode = 'agent'""",
    "escalated_detail": """SELECT g.item_id, s.defect_type, string_agg(order_label || ':' || coalesce(verdict, 'none') || ':' || cast(g.escalated as varchar), ',' ORDER BY order_label) AS orders
        FROM grade g JOIN scored s ON s.item_id = g.item_id AND s.mode = 'agent' AND s.escalated WHERE g.mode = 'agent' GROUP BY 1, 2""",
    "missed_items": "SELECT item_id, mode, score FROM scored WHERE defect_type = 'POSITION_BIAS' AND NOT escalated AND score > cast(0.35 as double)",
}.items()}
