"""From raw judgments to items, peer votes and order-swapped views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votelens.functions.columns import other_side, seeded_rank_key, stable_id, swap_letters, truncate_text, winner_vote
from votelens.params import DEFAULT, DEFAULT_RUBRIC, EVIDENCE_TOOLS, Params, Rubric


def extract_items(raw: DataFrame) -> DataFrame:
    """First-turn judgments with a winner and two whole conversations."""
    a, b = F.col("conversation_a"), F.col("conversation_b")
    usable = (F.col("turn") == 1) & F.col("winner").isin("model_a", "model_b") & (F.size(a) >= 2) & (F.size(b) >= 2)
    return raw.where(usable).select(
        stable_id(*(F.col(c) for c in ("question_id", "model_a", "model_b", "judge", "turn"))).alias("item_id"), "pos",
        "question_id", "judge", "turn", "model_a", "model_b", a[0]["content"].alias("question"), a[1]["content"].alias("response_a"),
        b[1]["content"].alias("response_b"), winner_vote(F.col("winner")).alias("human_gold_vote"),
    )


def last_by(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row per key, the one with the highest position.  A partial maximum, so no key gathers its rows in a task."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), position).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def dedupe_items(extracted: DataFrame) -> DataFrame:
    """The last judgment of each stable id."""
    return last_by(extracted, ["item_id"], "pos")


def sample_items(items: DataFrame, n: int, seed: int = DEFAULT.seed) -> DataFrame:
    """The same n items on every run, whatever their order."""
    return items.orderBy(seeded_rank_key(seed, "sample", F.col("item_id")), "item_id").limit(n)


def peer_votes(raw: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, judge, vote of the other judges on an item's pair of responses.

    Votes are first reduced to one per (question, pair, judge): the last one of the pair itself, the first one of the
    reversed pair, which is used, flipped, where its judge has no vote on the pair itself.
    """
    votes = raw.where("turn = 1").withColumn("vote", winner_vote(F.col("winner"))).where("vote is not null")
    cell = ["question_id", "model_a", "model_b", "judge"]
    reduced = votes.groupBy(*cell).agg(F.max_by("vote", "pos").alias("last"), F.min_by("vote", "pos").alias("first"))
    same = reduced.select(*cell, F.col("last").alias("vote"), F.lit(0).alias("rank"))
    reverse = reduced.select(
        "question_id", F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), "judge",
        other_side(F.col("first")).alias("vote"), F.lit(1).alias("rank"),
    )
    one = same.unionByName(reverse).groupBy(*cell).agg(F.min_by("vote", "rank").alias("vote"))
    pairs = items.select("item_id", "question_id", "model_a", "model_b", F.col("judge").alias("own"))
    return pairs.join(one, ["question_id", "model_a", "model_b"]).where("judge <> own").select("item_id", "judge", "vote")


def order_views(items: DataFrame, submissions: DataFrame) -> DataFrame:
    """Each item with its submission, as shown and with both responses exchanged: one join, of which each row gives both."""
    other, said = other_side(F.col("vote")), swap_letters(F.col("justification"))
    orders = {
        "original": ("model_a", "model_b", "response_a", "response_b", "human_gold_vote", "vote", "justification"),
        "swapped": ("model_b", "model_a", "response_b", "response_a", other_side(F.col("human_gold_vote")), other, said),
    }
    names = orders["original"]
    views = [
        F.struct(F.lit(order).alias("order_label"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(columns, names, strict=True)])
        for order, columns in orders.items()
    ]
    joined = items.join(submissions, "item_id").select("item_id", "annotator_id", "question", F.explode(F.array(*views)).alias("v"))
    return joined.select("item_id", "annotator_id", "question", "v.*")


def rubric_text(rubric: Rubric = DEFAULT_RUBRIC) -> str:
    """The rubric's dimensions, a line each, and its verdict rule."""
    lines = [f"- {name} (weight {weight}): {told}" for name, weight, told in rubric.dimensions]
    return "\n".join([*lines, "", f"Verdict rule: {rubric.verdict_rule}"])


def grade_request(tools: Column | bool, p: Params = DEFAULT, rubric: Rubric = DEFAULT_RUBRIC) -> Column:
    """The text that asks a grader about a view, with or without evidence tools."""
    head = [
        F.lit("Grade the quality of this annotation, not the responses.\n\n## Question\n"), F.col("question"),
        F.lit("\n\n## Response A\n"), truncate_text(F.col("response_a"), p.truncate_chars),
        F.lit("\n\n## Response B\n"), truncate_text(F.col("response_b"), p.truncate_chars),
        F.lit("\n\n## Submission\nAnnotator: "), F.col("annotator_id"), F.lit("\nItem: "), F.col("item_id"), F.lit("\nVote: Response "), F.col("vote"),
        F.lit("\nJustification: "), F.col("justification"), F.lit(f"\n\n## Rubric ({rubric.version})\n{rubric_text(rubric)}\n\n"),
    ]
    with_tools = F.lit(f"You may call {', '.join(EVIDENCE_TOOLS)}, {p.max_tool_calls} times in all, then emit a verdict or flag for review.")
    end = F.when(F.lit(tools) if isinstance(tools, bool) else tools, with_tools).otherwise(F.lit("Emit a verdict on this context alone."))
    return F.concat(*head, end)


def verifier_request(p: Params = DEFAULT, rubric: Rubric = DEFAULT_RUBRIC) -> Column:
    """The text that asks a reviewer about a grader's verdict on a view."""
    said = [
        F.lit("\n\n## Verdict under review\nVerdict: "), F.col("grader_verdict"), F.lit("\nConfidence: "), F.col("grader_confidence").cast("string"),
        F.lit("\nScores: "), F.col("dimension_scores"), F.lit("\nReason: "), F.col("reason"),
        F.lit(f"\n\nTry to overturn this verdict. You may call {', '.join(EVIDENCE_TOOLS)}, {p.verifier_tool_calls} times in all, then uphold or overturn it, or flag for review."),
    ]
    return F.concat(grade_request(False, p, rubric), *said)


def annotator_request() -> Column:
    """The text that asks for the justification of a given vote."""
    return F.concat(
        F.lit("You compared two responses and hold that Response "), F.col("vote"), F.lit(" is better.\n\n## Question\n"), F.col("question"), F.lit("\n\n## Response A\n"), F.col("response_a"),
        F.lit("\n\n## Response B\n"), F.col("response_b"), F.lit("\n\nSay why in two to four sentences. Name both as Response A and Response B."),
    )


# What a tool call out of its run's scope is told.
SCOPE_ERRORS = {
    "get_annotator_history": "only annotator {annotator_id} is in scope for this item",
    "get_peer_judgments": "only item {item_id} is in scope",
    "get_full_response": "which must be 'a' or 'b'",
    "": "unknown tool {name}",
}


def evidence_error(name: str, args: dict, run: dict) -> str | None:
    """Why a run may not make a tool call; None if it may.  `evidence_scope` says the same of a table of calls."""
    allowed = {
        "get_annotator_history": args.get("annotator_id") == run.get("annotator_id"), "get_peer_judgments": args.get("item_id") == run.get("item_id"),
        "get_full_response": args.get("which") in ("a", "b"),
    }
    if allowed.get(name):
        return None
    return SCOPE_ERRORS[name if name in allowed else ""].format(name=name, **{k: run.get(k) for k in ("annotator_id", "item_id")})


def _told(name: str) -> Column:
    """A message of SCOPE_ERRORS, of a row's columns."""
    before, _, rest = SCOPE_ERRORS[name].partition("{")
    column, _, after = rest.partition("}")
    return F.concat(F.lit(before), F.col(column), F.lit(after)) if column else F.lit(before)


def evidence_scope(requests: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Tool arguments against the run's own item and annotator: error (null if in scope) and the row limit that holds."""
    wrong = {
        "get_annotator_history": ~F.col("arg_annotator").eqNullSafe(F.col("annotator_id")), "get_peer_judgments": ~F.col("arg_item").eqNullSafe(F.col("item_id")),
        "get_full_response": ~F.coalesce(F.col("arg_which").isin("a", "b"), F.lit(False)),
    }
    error = F.when(~F.col("name").isin(*EVIDENCE_TOOLS), _told(""))
    for name, test in wrong.items():
        error = error.when((F.col("name") == name) & test, _told(name))
    limit = F.least(F.coalesce("arg_limit", F.lit(p.history_limit)), F.lit(p.history_cap))
    return requests.withColumn("error", error).withColumn("row_limit", F.when(F.col("name") == "get_annotator_history", limit))


def upsert_latest(current: DataFrame, changes: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Insert or replace: of each key the row with the highest version."""
    return last_by(current.unionByName(changes), keys, version)


def insert_ignore(current: DataFrame, more: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Insert or ignore: new keys only; of several new rows the first."""
    others = [c for c in more.columns if c not in keys]
    first = more.groupBy(*keys).agg(F.min_by(F.struct(*others), position).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in others])
    return current.unionByName(first.join(current.select(*keys), keys, "left_anti"))


def fetch_ordered(df: DataFrame, key: str = "item_id", limit: int | None = None) -> DataFrame:
    ordered = df.orderBy(key)
    return ordered.limit(limit) if limit else ordered


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
