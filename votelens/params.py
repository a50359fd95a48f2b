"""Parameters of the quality-assurance jobs, and the fixed texts they use."""

from __future__ import annotations

from dataclasses import dataclass

# Labels of the data model.
MODES = ("single", "agent", "verifier")
ORDERS = ("original", "swapped")
DEFECT_TYPES = ("RUSHED", "BOILERPLATE", "POSITION_BIAS", "SELF_CONTRADICTION")
ITEM_DEFECT_TYPES = ("RUSHED", "SELF_CONTRADICTION")
ANNOTATOR_DEFECT_TYPES = ("BOILERPLATE", "POSITION_BIAS")
EVIDENCE_TOOLS = ("get_annotator_history", "get_peer_judgments", "get_full_response")

# Short texts that replace a justification ({v} is the vote), and reused templates.
RUSHED_TEXTS = ("{v} is just better.", "{v} obviously.", "Went with {v}, reads better.", "{v}. No contest.")
BOILERPLATE_TEMPLATES = (
    "The response I picked is more helpful, better structured, and more accurate overall, so it was the clear choice.",
    "I chose this one because it answers the question well and is easy to follow from start to finish.",
)

# The rubric's dimensions and their weights.
RUBRIC_VERSION = "rubric_v1"
RUBRIC = {"decision_plausibility": 0.35, "justification_alignment": 0.30, "specificity": 0.20, "effort": 0.15}


@dataclass(frozen=True)
class Rubric:
    """What a grader goes by: its dimensions as (name, weight, what 5 and 0 mean), and when to accept or reject."""

    version: str
    dimensions: tuple[tuple[str, float, str], ...]
    verdict_rule: str


#: A rubric of the fixed dimensions, in words of our own; a caller passes another to the request texts.
DEFAULT_RUBRIC = Rubric(
    RUBRIC_VERSION,
    tuple((name, RUBRIC[name], told) for name, told in (
        ("decision_plausibility", "could a careful reader of both responses have voted so? 5: surely, 0: the vote ignores a plain difference."),
        ("justification_alignment", "does the text speak for the response that got the vote? 5: throughout, 0: it speaks for the other, or of neither."),
        ("specificity", "does the text name things in the responses that one can check? 5: several, 0: it would fit any pair."),
        ("effort", "were both responses read? 5: the text weighs both, 0: a single line that shows neither."),
    )),
    "Accept work that is done in good faith and grounded in the responses. Reject hasty work, reused texts, votes that follow a side, and texts that "
    "contradict the vote. Confidence is yours in the verdict, not the annotator's in the vote.",
)


@dataclass(frozen=True)
class Params:
    """Thresholds and limits; the defaults are the published operating point."""

    high: float = 0.75
    low: float = 0.35
    flip_penalty: float = 0.6
    overturn_penalty: float = 0.4
    min_items: int = 8
    side_ratio_flag: float = 0.95
    dup_ratio_flag: float = 0.5
    max_tool_calls: int = 6
    verifier_tool_calls: int = 3
    truncate_chars: int = 200
    history_limit: int = 10
    history_cap: int = 20
    max_attempts: int = 3
    sweep_high: tuple[float, ...] = (0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90)
    sweep_low: tuple[float, ...] = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50)
    #: USD per million tokens, (input, output), by model; a model that is not listed costs nothing.
    prices: tuple[tuple[str, int, int], ...] = (("grader-large", 3, 15),)
    #: Fixed value: the reason of an escalation that gives none.
    no_reason: str = "(no reason given)"
    n_annotators: int = 15
    item_defect_percent: int = 25
    seed: int = 42


DEFAULT = Params()
