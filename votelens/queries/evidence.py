"""Evidence: histories, peers, bundles and dossiers.  Nested results are joined to text, so that SQL can tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votelens.operators import evaluation
from votelens.operators import evidence as V
from votelens.operators.preparation import order_views, verifier_request
from votelens.queries.evaluation import _ROUTED
from votelens.params import EVIDENCE_TOOLS
from votelens.queries.preparation import _SWAP, _VIEWS, _request
from votelens.queries.sql import statement
from votelens.sources.fixtures import Fixtures


def _listed(array: str, *fields: str) -> Column:
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("none")) for f in fields])), ",")


def annotator_history(spark: SparkSession, sf: str) -> DataFrame:
    return V.annotator_history(Fixtures(spark, sf).submissions())


def history_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return V.history_patterns(Fixtures(spark, sf).submissions())


def peer_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return V.peer_bundle(Fixtures(spark, sf).item_peers()).select("item_id", "order_label", _listed("peers", "judge", "vote").alias("peers"))


def evidence_bundle(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    bundle = V.evidence_bundle(order_views(f.items(), f.submissions()), f.submissions(), f.item_peers())
    texts = F.sha1(F.array_join(F.transform("history", lambda h: h["justification"]), "|"))
    return bundle.select(
        "item_id", "order_label", "vote", F.length("response_a").alias("chars_a"), F.length("response_b").alias("chars_b"),
        _listed("history", "item_id", "vote").alias("history"), texts.alias("history_sha1"), _listed("peers", "judge", "vote").alias("peers"),
    )


def item_dossier(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    grades = f.grades()
    found = V.item_dossier(f.items().where("human_gold_vote = 'A'"), f.truth(), grades, evaluation.route_items(grades))
    return found.select(
        "item_id", "question_id", "annotator_id", "vote", "defect_type", _listed("grades", "mode", "order_label", "verdict", "escalated").alias("grades"),
        _listed("routes", "mode", "route", "path").alias("routes"),
    )


def verify_requests(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return V.verify_requests(f.grades(), order_views(f.items(), f.submissions())).select(
        "item_id", "order_label", "annotator_id", "vote", "grader_verdict", "grader_confidence", "dimension_scores", "reason"
    )


def verifier_requests(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    asked = V.verify_requests(f.grades(), order_views(f.items(), f.submissions()))
    return asked.select("item_id", "order_label", verifier_request().alias("request"))


def example_trace(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return V.example_trace(f.traces(), f.truth(), f.grades()).select("item_id")


QUERIES = {q.__name__: q for q in (annotator_history, history_patterns, peer_bundle, evidence_bundle, item_dossier, verify_requests, verifier_requests, example_trace)}

_ORDERED = "(SELECT h.item_id, order_label, pos, other_id, CASE WHEN order_label = 'swapped' THEN CASE other_vote WHEN 'A' THEN 'B' ELSE 'A' END ELSE other_vote END AS vote, CASE WHEN order_label = 'swapped' THEN " + _SWAP.replace("justification", "other_text") + " ELSE other_text END AS txt FROM hist h CROSS JOIN (VALUES ('original'), ('swapped')) o(order_label))"
_PEERS = """(SELECT item_id, order_label, string_agg(judge || ':' || CASE WHEN order_label = 'swapped' THEN CASE vote WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE vote END ELSE vote END, ',' ORDER BY judge,
    CASE WHEN order_label = 'swapped' THEN CASE vote WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE vote END ELSE vote END) AS peers FROM peer CROSS JOIN (VALUES ('original'), ('swapped')) o(order_label) GROUP BY 1, 2)"""

ORACLES = {name: statement(sql) for name, sql in {
    "annotator_history": "SELECT item_id, annotator_id, pos, other_id, other_vote, other_text FROM hist",
    "history_patterns": "SELECT * FROM pattern",
    "peer_bundle": f"SELECT * FROM {_PEERS}",
    "evidence_bundle": f"""SELECT v.item_id, v.order_label, v.vote, length(response_a) AS chars_a, length(response_b) AS chars_b, coalesce(h.history, '') AS history,
        sha1(coalesce(h.texts, '')) AS history_sha1, coalesce(p.peers, '') AS peers FROM {_VIEWS} v LEFT JOIN (SELECT item_id, order_label, string_agg(other_id || ':' || vote, ',' ORDER BY pos) AS history,
        string_agg(txt, '|' ORDER BY pos) AS texts FROM {_ORDERED} GROUP BY 1, 2) h ON h.item_id = v.item_id AND h.order_label = v.order_label
        LEFT JOIN {_PEERS} p ON p.item_id = v.item_id AND p.order_label = v.order_label""",
    "item_dossier": f"""SELECT i.item_id, i.question_id, s.annotator_id, s.vote, s.defect_type, g.grades, r.routes FROM item i LEFT JOIN sub s ON s.item_id = i.item_id
        LEFT JOIN (SELECT item_id, string_agg(mode || ':' || order_label || ':' || coalesce(verdict, 'none') || ':' || cast(escalated as varchar), ',' ORDER BY mode, order_label) AS grades FROM grade GROUP BY 1) g ON g.item_id = i.item_id
        LEFT JOIN (SELECT item_id, string_agg(mode || ':' || route || ':' || path, ',' ORDER BY mode) AS routes FROM {_ROUTED} GROUP BY 1) r ON r.item_id = i.item_id WHERE i.human_gold_vote = 'A'""",
    "verify_requests": f"""SELECT v.item_id, v.order_label, v.annotator_id, v.vote, g.verdict AS grader_verdict, g.confidence AS grader_confidence, g.dimension_scores, g.reason FROM grade g
        JOIN {_VIEWS} v ON v.item_id = g.item_id AND v.order_label = g.order_label WHERE g.mode = 'agent' AND NOT g.escalated""",
    "verifier_requests": f"""SELECT item_id, order_label, {_request()} || '\n\n## Verdict under review\nVerdict: ' || grader_verdict || '\nConfidence: ' || cast(grader_confidence as varchar) || '\nScores: ' || dimension_scores
        || '\nReason: ' || reason || '\n\nTry to overturn this verdict. You may call {", ".join(EVIDENCE_TOOLS)}, 3 times in all, then uphold or overturn it, or flag for review.' AS request
        FROM (SELECT v.*, false AS tools, g.verdict AS grader_verdict, g.confidence AS grader_confidence, g.dimension_scores, g.reason FROM grade g
        JOIN {_VIEWS} v ON v.item_id = g.item_id AND v.order_label = g.order_label WHERE g.mode = 'agent' AND NOT g.escalated)""",
    "example_trace": """SELECT g.item_id FROM grade g JOIN sub s ON s.item_id = g.item_id WHERE mode = 'agent' AND order_label = 'original' AND defect_type = 'SELF_CONTRADICTION'
        AND (verdict = 'reject' OR escalated) ORDER BY g.item_id LIMIT 1""",
}.items()}
