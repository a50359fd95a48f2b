"""The domain's tables as SQL, for the oracles: common table expressions that mirror `votelens.sources.fixtures`."""

from __future__ import annotations

import re

from votelens.params import BOILERPLATE_TEMPLATES, RUBRIC, RUBRIC_VERSION


def h(text: str) -> str:
    return f"cast('0x' || substring(sha1({text}), 1, 8) as bigint)"


def score(verdict: str, confidence: str, flipped: str) -> str:
    plain = f"(CASE WHEN {verdict} = 'accept' THEN {confidence} ELSE cast(1 as double) - {confidence} END)"
    return f"(CASE WHEN {flipped} THEN cast(0.5 as double) + ({plain} - cast(0.5 as double)) * (cast(1 as double) - cast(0.6 as double)) ELSE {plain} END)"


def _scores() -> str:
    return "'{' || " + " || ',' || ".join(f"'\"{d}\":' || ((seed + {i}) % 6)" for i, d in enumerate(RUBRIC)) + " || '}'"


ORDERS = "(VALUES ('original'), ('swapped')) o(order_label)"
MODES = "(VALUES ('single'), ('agent'), ('verifier')) m(mode)"
TYPES = "(VALUES ('RUSHED'), ('BOILERPLATE'), ('POSITION_BIAS'), ('SELF_CONTRADICTION')) t(defect_type)"
TOOL = "CASE (seed + i) % 3 WHEN 0 THEN 'get_full_response' WHEN 1 THEN 'get_peer_judgments' ELSE 'get_annotator_history' END"

TABLES: dict[str, str] = {
    "nconv": "SELECT count(DISTINCT conv_id) AS n FROM conversations",
    "msg": "SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role <> 'system'",
    "conv": "SELECT conv_id, count(*) AS n_msg, max(CASE WHEN rn = 1 THEN text END) AS c0, max(CASE WHEN rn = 2 THEN text END) AS c1 FROM msg GROUP BY conv_id",
    "raw0": """SELECT event_id AS pos, event_id % 40 AS question_id, CASE WHEN (event_id // 40) % 4 = 3 THEN 2 ELSE 1 END AS turn,
        'expert_' || (user_id % 30) AS judge, cast(json_extract_string(props, '$.k') as bigint) % 4 AS a,
        (cast(json_extract_string(props, '$.k') as bigint) % 4 + 1 + (event_id // 160) % 3) % 4 AS b,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 'model_a' WHEN event_type IN ('click', 'view') THEN 'model_b' ELSE 'tie' END AS winner FROM events""",
    "raw": """SELECT pos, question_id, turn, judge, 'm' || a AS model_a, 'm' || b AS model_b, winner, coalesce(ca.n_msg, 0) AS n_a, coalesce(cb.n_msg, 0) AS n_b,
        ca.c0 AS a0, ca.c1 AS a1, cb.c1 AS b1 FROM raw0 CROSS JOIN nconv LEFT JOIN conv ca ON ca.conv_id = (question_id * 4 + a) % nconv.n
        LEFT JOIN conv cb ON cb.conv_id = (question_id * 4 + b) % nconv.n""",
    "extracted": """SELECT substring(sha1(question_id || '|' || model_a || '|' || model_b || '|' || judge || '|' || turn), 1, 12) AS item_id, pos, question_id, judge, turn, model_a, model_b,
        a0 AS question, a1 AS response_a, b1 AS response_b, CASE WHEN winner = 'model_a' THEN 'A' ELSE 'B' END AS human_gold_vote
        FROM raw WHERE turn = 1 AND winner IN ('model_a', 'model_b') AND n_a >= 2 AND n_b >= 2""",
    "jitems": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos DESC) AS rn FROM extracted) WHERE rn = 1",
    "sub0": f"""SELECT d.doc_id, text, source, CASE WHEN source IN ('src3', 'src11') THEN 'POSITION_BIAS' WHEN source IN ('src5', 'src17') THEN 'BOILERPLATE'
        WHEN quality = 0 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'RUSHED' ELSE 'SELF_CONTRADICTION' END END AS defect_type,
        CASE WHEN {h("'vote|' || d.doc_id")} % 2 = 0 THEN 'A' ELSE 'B' END AS v FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "sub1": "SELECT *, CASE WHEN defect_type = 'POSITION_BIAS' THEN 'A' ELSE v END AS vote FROM sub0",
    "sub": f"""SELECT cast(doc_id as varchar) AS item_id, source AS annotator_id, vote, CASE WHEN defect_type = 'BOILERPLATE' THEN '{BOILERPLATE_TEMPLATES[0]}'
        WHEN defect_type = 'RUSHED' THEN vote || ' obviously.' ELSE 'I preferred Response ' || CASE WHEN defect_type = 'SELF_CONTRADICTION' THEN CASE vote WHEN 'A' THEN 'B' ELSE 'A' END ELSE vote END
        || ' because ' || text END AS justification, defect_type IS NOT NULL AS is_defective, defect_type FROM sub1""",
    "ann": """SELECT DISTINCT source AS annotator_id, source IN ('src3', 'src11', 'src5', 'src17') AS is_defective,
        CASE WHEN source IN ('src3', 'src11') THEN 'POSITION_BIAS' WHEN source IN ('src5', 'src17') THEN 'BOILERPLATE' END AS defect_type FROM documents""",
    "item0": f"""SELECT doc_id, doc_id % 4 AS a, (doc_id % 4 + 1 + (doc_id // 4) % 3) % 4 AS b, doc_id % nconv.n AS ca, (doc_id + 1) % nconv.n AS cb,
        {h("'gold|' || doc_id")} % 2 = 0 AS gold FROM documents CROSS JOIN nconv""",
    "item": """SELECT cast(doc_id as varchar) AS item_id, doc_id % 40 AS question_id, 'expert_' || (doc_id % 30) AS judge, 1 AS turn, 'm' || a AS model_a, 'm' || b AS model_b,
        coalesce(x.c0, '') AS question, coalesce(x.c1, '') AS response_a, coalesce(y.c1, '') AS response_b, CASE WHEN gold THEN 'A' ELSE 'B' END AS human_gold_vote
        FROM item0 LEFT JOIN conv x ON x.conv_id = ca LEFT JOIN conv y ON y.conv_id = cb""",
    "peer": f"""SELECT cast(doc_id as varchar) AS item_id, 'expert_' || ((doc_id + 7 * j + 1) % 30) AS judge,
        CASE {h("'peer|' || doc_id || '|' || j")} % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS vote FROM documents, (VALUES (0), (1), (2)) n(j) WHERE j < doc_id % 4""",
    "run0": f"SELECT cast(doc_id as varchar) AS item_id, order_label, mode, '{RUBRIC_VERSION}' AS rubric_version, {h('doc_id || chr(124) || order_label || chr(124) || mode')} AS seed FROM documents, {ORDERS}, {MODES}",
    "grade": f"""SELECT item_id, order_label, mode, rubric_version, CASE WHEN NOT esc THEN {_scores()} END AS dimension_scores,
        CASE WHEN NOT esc THEN CASE WHEN seed % 10 < 3 THEN 'reject' ELSE 'accept' END END AS verdict,
        CASE WHEN NOT esc THEN cast(55 + seed % 40 as double) / cast(100 as double) END AS confidence, 'reason ' || (seed % 7) AS reason, esc AS escalated,
        mode <> 'single' AND seed % 17 = 0 AS budget_exhausted FROM (SELECT *, mode <> 'single' AND seed % 13 = 0 AS esc FROM run0)""",
    "run": """SELECT *, CASE mode WHEN 'agent' THEN n_tool_calls >= 6 WHEN 'verifier' THEN n_tool_calls >= 3 ELSE false END AS hit_cap FROM
        (SELECT *, CASE mode WHEN 'single' THEN 0 WHEN 'agent' THEN seed % 7 ELSE seed % 4 END AS n_tool_calls FROM run0)""",
    "round": """SELECT item_id, order_label, mode, rubric_version, i, 500 + (seed + 37 * i) % 3000 AS tokens_in, 40 + (seed + i) % 200 AS tokens_out
        FROM run, (VALUES (0), (1), (2), (3), (4), (5), (6)) n(i) WHERE i <= n_tool_calls""",
    "calls": "SELECT *, CASE WHEN (tokens_in + i) % 50 = 0 THEN 0 ELSE 3 * tokens_in + 15 * tokens_out END AS micro FROM round",
    "tool": f"SELECT item_id, order_label, mode, rubric_version, i, {TOOL} AS name, seed FROM run, (VALUES (0), (1), (2), (3), (4), (5)) n(i) WHERE i < n_tool_calls",
    "review": f"""SELECT item_id, order_label, '{RUBRIC_VERSION}' AS rubric_version, CASE WHEN seed % 10 < 3 THEN 'overturn' ELSE 'uphold' END AS decision,
        cast(50 + seed % 50 as double) / cast(100 as double) AS confidence, 'checked ' || (seed % 5) AS reason, seed % 29 = 0 AS escalated, seed FROM
        (SELECT cast(doc_id as varchar) AS item_id, order_label, {h("'rev|' || doc_id || '|' || order_label")} AS seed FROM documents, {ORDERS})""",
    "paired": """SELECT o.item_id, o.mode, o.rubric_version, o.verdict AS verdict_original, s.verdict AS verdict_swapped, o.confidence, o.reason,
        coalesce(o.escalated, false) OR coalesce(s.escalated, false) AS escalated FROM grade o JOIN grade s ON s.item_id = o.item_id AND s.mode = o.mode
        AND s.rubric_version = o.rubric_version AND s.order_label = 'swapped' WHERE o.order_label = 'original'""",
    "scored": f"""SELECT p.item_id, p.mode, CASE WHEN NOT escalated THEN {score('verdict_original', 'confidence', 'verdict_original <> verdict_swapped')} END AS score,
        coalesce(verdict_original <> verdict_swapped, false) AS flipped, escalated, is_defective, defect_type, annotator_id FROM paired p JOIN sub USING (item_id)""",
    "normed": "SELECT annotator_id, vote, trim(regexp_replace(lower(justification), '\\s+', ' ', 'g')) AS txt FROM sub",
    "signal": """SELECT annotator_id, n_items, greatest(n_a, n_b) / cast(n_items as double) AS side_ratio, top / cast(n_items as double) AS dup_ratio FROM
        (SELECT annotator_id, count(*) AS n_items, count(*) FILTER (WHERE vote = 'A') AS n_a, count(*) FILTER (WHERE vote = 'B') AS n_b FROM normed GROUP BY 1)
        JOIN (SELECT annotator_id, max(c) AS top FROM (SELECT annotator_id, txt, count(*) AS c FROM normed GROUP BY 1, 2) GROUP BY 1) USING (annotator_id)""",
    "flags": """SELECT *, reason IS NOT NULL AS flagged FROM (SELECT *, CASE WHEN n_items < 8 THEN NULL ELSE nullif(concat_ws('+',
        CASE WHEN side_ratio >= cast(0.95 as double) THEN 'constant_side' END, CASE WHEN dup_ratio >= cast(0.5 as double) THEN 'justification_reuse' END), '') END AS reason FROM signal)""",
    "overlaid": """SELECT s.* REPLACE (CASE WHEN f.flagged THEN cast(0 as double) ELSE score END AS score, CASE WHEN f.flagged THEN false ELSE escalated END AS escalated),
        coalesce(f.flagged, false) AS agg_flagged FROM scored s LEFT JOIN flags f USING (annotator_id)""",
    "hist0": "SELECT item_id, annotator_id, vote, justification, row_number() OVER (PARTITION BY annotator_id ORDER BY item_id) AS rk FROM sub",
    "hist": """SELECT s.item_id, s.annotator_id, x.item_id AS other_id, x.vote AS other_vote, x.justification AS other_text, x.rk - CASE WHEN x.rk > s.rk THEN 1 ELSE 0 END AS pos
        FROM hist0 s JOIN hist0 x ON x.annotator_id = s.annotator_id AND x.rk <= 11 AND x.item_id <> s.item_id WHERE x.rk - CASE WHEN x.rk > s.rk THEN 1 ELSE 0 END <= 10""",
    "pattern": """SELECT item_id, count(*) AS n_history, count(*) >= 5 AND count(DISTINCT other_text) = 1 AS reused_text, count(*) >= 6 AND count(DISTINCT other_vote) = 1 AS constant_side FROM hist GROUP BY item_id""",
    "agree": """SELECT s.item_id, count(*) FILTER (WHERE p.vote <> 'tie') AS n_votes, count(*) FILTER (WHERE p.vote = s.vote) AS n_agree FROM sub s JOIN peer p ON p.item_id = s.item_id GROUP BY s.item_id""",
    "feat": r"""SELECT item_id, annotator_id, vote, justification, len(list_filter(regexp_split_to_array(justification, '\s+'), lambda w: w <> '')) AS n_words,
        (length(justification) - length(replace(justification, 'Response A', ''))) // 10 AS n_a, (length(justification) - length(replace(justification, 'Response B', ''))) // 10 AS n_b FROM sub""",
}


def metrics(source: str, by: str, high: str = "0.75", low: str = "0.35") -> str:
    hi, lo = f"cast({high} as double)", f"cast({low} as double)"
    flag = f"(NOT escalated AND score <= {lo})"
    return f"""SELECT {by}, count(*) AS n_items, count(*) FILTER (WHERE {flag}) AS n_flagged, count(*) FILTER (WHERE escalated) AS n_escalated,
        count(*) FILTER (WHERE {flag} AND is_defective) / cast(nullif(count(*) FILTER (WHERE {flag}), 0) as double) AS "precision",
        count(*) FILTER (WHERE {flag} AND is_defective) / cast(nullif(count(*) FILTER (WHERE is_defective), 0) as double) AS recall,
        count(*) FILTER (WHERE is_defective AND (escalated OR score <= {lo})) / cast(nullif(count(*) FILTER (WHERE is_defective), 0) as double) AS catch_rate,
        count(*) FILTER (WHERE escalated OR (score > {lo} AND score < {hi})) / cast(nullif(count(*), 0) as double) AS review_load FROM {source} GROUP BY {by}"""


def by_type(source: str, by: str, low: str = "0.35") -> str:
    lo = f"cast({low} as double)"
    return f"""SELECT {by}, defect_type, count(*) AS n_type, count(*) FILTER (WHERE NOT escalated AND score <= {lo}) / cast(count(*) as double) AS recall,
        count(*) FILTER (WHERE escalated OR score <= {lo}) / cast(count(*) as double) AS catch_rate FROM {source} WHERE defect_type IS NOT NULL GROUP BY {by}, defect_type"""


def needed(body: str) -> list[str]:
    """The tables that a statement asks for, with those they ask for, in order of definition."""
    found: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in TABLES:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b(?=\s|,|$)", text):
                found.add(name)
                todo.append(TABLES[name])
    return [n for n in TABLES if n in found]


def statement(body: str) -> str:
    """The statement with the tables it needs."""
    names = needed(body)
    head = "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in names) + "\n" if names else ""
    return head + body
