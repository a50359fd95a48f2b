"""Annotator signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votelens.operators import checks, evaluation
from votelens.operators import signals as S
from votelens.params import ITEM_DEFECT_TYPES
from votelens.queries.sql import statement
from votelens.sources import placed
from votelens.sources.fixtures import Fixtures


def annotator_signals(spark: SparkSession, sf: str) -> DataFrame:
    return S.annotator_signals(Fixtures(spark, sf).submissions())


def annotator_flags(spark: SparkSession, sf: str) -> DataFrame:
    return S.annotator_flags(Fixtures(spark, sf).submissions())


def layer0_overlay(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return S.layer0_overlay(evaluation.scored_records(f.grades(), f.truth()), S.annotator_flags(f.submissions())).select(
        "item_id", "mode", "annotator_id", "score", "flipped", "escalated", "is_defective", "defect_type", "agg_flagged"
    )


def annotator_load(spark: SparkSession, sf: str) -> DataFrame:
    return S.annotator_load(Fixtures(spark, sf).truth())


def annotator_roster(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return S.annotator_roster(f.annotators(), f.truth().where("vote = 'B'").select("item_id", "annotator_id"))


def clean_submissions(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return S.clean_submissions(f.truth(), f.annotators()).select("item_id", "annotator_id", "vote")


def defect_truth(spark: SparkSession, sf: str) -> DataFrame:
    return S.defect_truth(Fixtures(spark, sf).truth(), ITEM_DEFECT_TYPES)


def defect_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.defect_counts(defect_truth(spark, sf))


def mode_cost(spark: SparkSession, sf: str) -> DataFrame:
    return checks.mode_cost(Fixtures(spark, sf).call_log())


def arm_cost(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return checks.arm_cost(f.call_log(), evaluation.scored_records(f.grades(), f.truth()))


def _done(f: Fixtures) -> DataFrame:
    return f.grades().where("not (item_id like '%3' and order_label = 'swapped' and mode <> 'single')")


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return checks.completeness(f.truth(), _done(f))


def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return checks.pending_work(f.truth(), _done(f))


BUCKETS = 8


def placed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Both orders' grades paired, from a table stored by item."""
    grades = placed.store_by_item(Fixtures(spark, sf).grades(), BUCKETS)
    return evaluation.paired_grades(grades)


def placed_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records with their truth, of two tables stored by item."""
    f = Fixtures(spark, sf)
    return evaluation.scored_records(placed.store_by_item(f.grades(), BUCKETS), placed.store_by_item(f.truth(), BUCKETS))


def placed_pending(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return placed.pending_by_item(placed.store_by_item(f.truth(), BUCKETS), placed.store_by_item(_done(f), BUCKETS))


def missing_deps(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return checks.missing_deps(f.truth().select("item_id"), f.truth().where("item_id not like '%9'"), _done(f))


def peer_agreement(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return S.peer_agreement(f.item_peers(), f.truth())


QUERIES = {q.__name__: q for q in (
    annotator_signals, annotator_flags, layer0_overlay, annotator_load, annotator_roster, clean_submissions, defect_truth, defect_counts, mode_cost,
    arm_cost, completeness, pending_work, placed_pairs, placed_records, placed_pending, missing_deps, peer_agreement,
)}

_TRUTH = "(SELECT item_id, defect_type, CASE WHEN defect_type IN ('RUSHED', 'SELF_CONTRADICTION') THEN 'item' ELSE 'annotator' END AS scope FROM sub WHERE is_defective)"
_GONE = "(item_id LIKE '%3' AND order_label = 'swapped' AND mode <> 'single')"
_SPENT = "(SELECT m.mode, cast(coalesce(sum(micro), 0) as bigint) AS micro_usd FROM (VALUES ('single'), ('agent'), ('verifier')) m(mode) LEFT JOIN calls c ON c.mode = m.mode GROUP BY m.mode)"
ARM = f"""(SELECT a.mode, micro_usd, n_items, micro_usd / cast(n_items * 1000 as double) AS cost_per_1000_usd FROM
    (SELECT x.mode, cast(sum(s.micro_usd) as bigint) AS micro_usd FROM {_SPENT} x JOIN {_SPENT} s ON s.mode = x.mode OR (x.mode = 'verifier' AND s.mode = 'agent') GROUP BY x.mode) a
    JOIN (SELECT mode, count(*) AS n_items FROM scored GROUP BY mode) n ON n.mode = a.mode)"""

ORACLES = {name: statement(sql) for name, sql in {
    "annotator_signals": "SELECT * FROM signal",
    "annotator_flags": "SELECT annotator_id, n_items, side_ratio, dup_ratio, reason, flagged FROM flags",
    "layer0_overlay": "SELECT item_id, mode, annotator_id, score, flipped, escalated, is_defective, defect_type, agg_flagged FROM overlaid",
    "annotator_load": "SELECT count(*) AS n_annotators, cast(sum(n) as bigint) AS n_items, min(n) AS least, max(n) AS most, cast(sum(bad) as bigint) AS n_defective FROM (SELECT annotator_id, count(*) AS n, count(*) FILTER (WHERE is_defective) AS bad FROM sub GROUP BY 1)",
    "annotator_roster": "SELECT a.annotator_id, a.is_defective, a.defect_type, count(s.item_id) AS n_items FROM ann a LEFT JOIN sub s ON s.annotator_id = a.annotator_id AND s.vote = 'B' GROUP BY 1, 2, 3",
    "clean_submissions": "SELECT item_id, s.annotator_id, vote FROM sub s JOIN ann a ON a.annotator_id = s.annotator_id WHERE NOT a.is_defective",
    "defect_truth": f"SELECT * FROM {_TRUTH}",
    "defect_counts": f"SELECT scope, defect_type, count(*) AS n FROM {_TRUTH} GROUP BY 1, 2",
    "mode_cost": f"SELECT * FROM {_SPENT}",
    "arm_cost": f"SELECT * FROM {ARM}",
    "completeness": f"SELECT mode, count(*) AS n_grades, (SELECT count(*) * 2 FROM sub) AS expected, count(*) = (SELECT count(*) * 2 FROM sub) AS complete FROM grade WHERE NOT {_GONE} GROUP BY mode",
    "pending_work": f"SELECT item_id, order_label, mode FROM grade WHERE {_GONE}",
    "placed_pairs": "SELECT item_id, mode, rubric_version, verdict_original, verdict_swapped, confidence, reason, escalated FROM paired",
    "placed_records": "SELECT item_id, mode, score, flipped, escalated, is_defective, defect_type, annotator_id FROM scored",
    "placed_pending": f"SELECT item_id, order_label, mode FROM grade WHERE {_GONE}",
    "missing_deps": f"SELECT item_id, 'submission' AS missing FROM sub WHERE item_id LIKE '%9' UNION ALL SELECT item_id, 'agent grade: ' || order_label FROM grade WHERE {_GONE} AND mode = 'agent'",
    "peer_agreement": "SELECT * FROM agree",
}.items()}
