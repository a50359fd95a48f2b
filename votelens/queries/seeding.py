"""Seeded assignment and defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from votelens.operators import seeding as D
from votelens.operators.signals import clean_submissions
from votelens.params import BOILERPLATE_TEMPLATES, DEFAULT, RUSHED_TEXTS
from votelens.queries.preparation import _SWAP, _with
from votelens.queries.sql import h, statement
from votelens.sources.fixtures import Fixtures


def assign_items(spark: SparkSession, sf: str) -> DataFrame:
    return D.assign_items(Fixtures(spark, sf).truth())


def pick_defective(spark: SparkSession, sf: str) -> DataFrame:
    return D.pick_defective(Fixtures(spark, sf).annotators())


def injection_plan(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return D.injection_plan(clean_submissions(f.truth(), f.annotators()))


def _injected(spark: SparkSession, sf: str) -> DataFrame:
    return D.inject_item_defects(Fixtures(spark, sf).submissions(), injection_plan(spark, sf))


def seed_rushed(spark: SparkSession, sf: str) -> DataFrame:
    return _injected(spark, sf).where("defect_type = 'RUSHED'").select("item_id", "vote", "justification")


def seed_contradiction(spark: SparkSession, sf: str) -> DataFrame:
    return _injected(spark, sf).where("defect_type = 'SELF_CONTRADICTION'").select("item_id", "vote", "justification")


def _annotator_defects(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return D.seed_annotator_defects(f.submissions(), f.items(), f.annotators().where("is_defective").select("annotator_id", "defect_type"))


def seed_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    return _annotator_defects(spark, sf).where("defect_type = 'BOILERPLATE'").select("item_id", "annotator_id", "vote", "justification")


def seed_position_bias(spark: SparkSession, sf: str) -> DataFrame:
    return _annotator_defects(spark, sf).where("defect_type = 'POSITION_BIAS'").select("item_id", "annotator_id", "vote", "justification")


QUERIES = {q.__name__: q for q in (assign_items, pick_defective, injection_plan, seed_rushed, seed_contradiction, seed_boilerplate, seed_position_bias)}

_N = DEFAULT.n_annotators
_SHIFTS = ", ".join(f"({i}, 'ann_{i:02d}', {d})" for i, d in enumerate(D.load_shifts(_N)))
_PLAN = """plan AS (SELECT item_id, CASE WHEN rk % 2 = 1 THEN 'RUSHED' ELSE 'SELF_CONTRADICTION' END AS defect_type FROM (SELECT s.item_id, row_number() OVER (ORDER BY sha1('42|inject|' || s.item_id), s.item_id) AS rk,
    count(*) OVER () AS n FROM sub s JOIN ann a ON a.annotator_id = s.annotator_id WHERE NOT a.is_defective) WHERE rk <= n * 25 // 100)"""
_RUSHED = "CASE " + h("'rushed|' || item_id") + " % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(RUSHED_TEXTS)) + " END"

ORACLES = {
    "assign_items": _with(f"""ranked AS (SELECT item_id, row_number() OVER (ORDER BY sha1('42|assign|' || item_id), item_id) AS rk FROM sub),
        loads AS (SELECT i, annotator_id, n // {_N} + CASE WHEN i < n % {_N} THEN 1 ELSE 0 END + CASE WHEN n // {_N} >= 2 THEN shift ELSE 0 END AS c FROM (VALUES {_SHIFTS}) v(i, annotator_id, shift) CROSS JOIN (SELECT count(*) AS n FROM sub)),
        bounds AS (SELECT annotator_id, sum(c) OVER (ORDER BY i) - c AS above, sum(c) OVER (ORDER BY i) AS upto FROM loads)""",
        "SELECT item_id, annotator_id FROM ranked JOIN bounds ON rk > above AND rk <= upto"),
    "pick_defective": statement("""SELECT annotator_id, CASE WHEN rk <= 2 THEN 'BOILERPLATE' ELSE 'POSITION_BIAS' END AS defect_type FROM (SELECT annotator_id,
        row_number() OVER (ORDER BY sha1('42|defective|' || annotator_id)) AS rk FROM ann) WHERE rk <= 4"""),
    "injection_plan": _with(_PLAN, "SELECT * FROM plan"),
    "seed_rushed": _with(_PLAN, f"SELECT item_id, vote, replace({_RUSHED}, '{{v}}', vote) AS justification FROM sub s JOIN plan p USING (item_id) WHERE p.defect_type = 'RUSHED'"),
    "seed_contradiction": _with(_PLAN, f"SELECT item_id, vote, {_SWAP} AS justification FROM sub s JOIN plan p USING (item_id) WHERE p.defect_type = 'SELF_CONTRADICTION'"),
    "seed_boilerplate": statement(f"""SELECT s.item_id, s.annotator_id, i.human_gold_vote AS vote, CASE WHEN s.annotator_id = 'src17' THEN '{BOILERPLATE_TEMPLATES[0]}' ELSE '{BOILERPLATE_TEMPLATES[1]}' END AS justification
        FROM sub s JOIN item i ON i.item_id = s.item_id WHERE s.annotator_id IN ('src5', 'src17')"""),
    "seed_position_bias": statement("SELECT item_id, annotator_id, 'A' AS vote, justification FROM sub WHERE annotator_id IN ('src3', 'src11')"),
}
