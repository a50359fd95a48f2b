"""The ten tables: columns, keys and allowed values."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(columns: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (c.split() for c in columns.split(", "))])


RUN_KEY = ("item_id", "order_label", "mode", "rubric_version")

TABLES: dict[str, T.StructType] = {
    "items": _schema("item_id string, question_id int, judge string, turn int, model_a string, model_b string, question string, response_a string, response_b string, human_gold_vote string"),
    "peer_votes": _schema("item_id string, judge string, vote string"),
    "annotators": _schema("annotator_id string, is_defective boolean, defect_type string"),
    "assignments": _schema("item_id string, annotator_id string"),
    "submissions": _schema("item_id string, annotator_id string, vote string, justification string, is_defective boolean, defect_type string"),
    "defects": _schema("item_id string, defect_type string, scope string, injected_at timestamp"),
    "grades": _schema("item_id string, order_label string, mode string, rubric_version string, dimension_scores string, verdict string, confidence double, reason string, escalated boolean, budget_exhausted boolean, graded_at timestamp"),
    "traces": _schema("item_id string, order_label string, mode string, rubric_version string, trace string, n_tool_calls int, hit_cap boolean, escalated boolean, tokens_in int, tokens_out int, latency_ms double, created_at timestamp"),
    "call_log": _schema("call_id string, item_id string, purpose string, mode string, order_label string, rubric_version string, model string, mock boolean, tokens_in int, tokens_out int, latency_ms double, cost_usd double, attempts int, created_at timestamp"),
    "routed": _schema("item_id string, mode string, rubric_version string, verdict_original string, verdict_swapped string, flipped boolean, confidence double, route string, path string, reason string"),
}

KEYS: dict[str, tuple[str, ...]] = {
    "items": ("item_id",), "peer_votes": ("item_id", "judge"), "annotators": ("annotator_id",), "assignments": ("item_id",),
    "submissions": ("item_id",), "defects": ("item_id",), "grades": RUN_KEY, "traces": RUN_KEY, "call_log": ("call_id",),
    "routed": ("item_id", "mode"),
}

ALLOWED: dict[str, dict[str, tuple[str, ...]]] = {
    "items": {"human_gold_vote": ("A", "B")},
    "peer_votes": {"vote": ("A", "B", "tie")},
    "annotators": {"defect_type": ("BOILERPLATE", "POSITION_BIAS")},
    "submissions": {"vote": ("A", "B")},
    "defects": {"scope": ("item", "annotator")},
    "grades": {"order_label": ("original", "swapped"), "mode": ("single", "agent", "verifier"), "verdict": ("accept", "reject")},
    "routed": {"route": ("auto_accept", "auto_reject", "human_review"), "path": ("AUTO", "THRESHOLD_ROUTED", "AGENT_ESCALATED", "BOTH")},
}

#: Trace events of all kinds, with the fields that any of them has.
TRACE_EVENTS = (
    "array<struct<type:string,name:string,reason:string,verdict:string,decision:string,confidence:double,"
    "tokens_in:int,tokens_out:int,latency_ms:double,chars:int,preview:string,budget_exhausted:boolean,error:string>>"
)
