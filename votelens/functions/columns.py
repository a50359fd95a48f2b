"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from votelens.params import DEFAULT, Params


def ratio(part: Column, whole: Column) -> Column:
    """A double, null on an empty denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def hash_bucket(text: Column) -> Column:
    """The first 8 hex digits of the SHA-1 as a long."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("bigint")


def stable_id(question_id: Column, model_a: Column, model_b: Column, judge: Column, turn: Column) -> Column:
    """12 hex digits that name a judgment; missing parts count as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (question_id, model_a, model_b, judge, turn)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def winner_vote(winner: Column) -> Column:
    return F.when(winner == "model_a", "A").when(winner == "model_b", "B").when(winner == "tie", "tie")


def other_side(vote: Column) -> Column:
    return F.when(vote == "A", "B").when(vote == "B", "A").otherwise(vote)


def swap_letters(text: Column) -> Column:
    """Exchanges the mentions of both responses: between mentions of A, each of B becomes A; the parts are joined by B."""
    between = F.transform(F.split(text, "Response A"), lambda part: F.replace(part, F.lit("Response B"), F.lit("Response A")))
    return F.array_join(between, "Response B")


# The note that follows a text cut short, before and after the whole text's length.
TRUNCATED = ("… [TRUNCATED — ", " chars total]")


def truncate_text(text: Column, chars: int = DEFAULT.truncate_chars) -> Column:
    note = F.concat(F.lit(TRUNCATED[0]), F.length(text).cast("string"), F.lit(TRUNCATED[1]))
    return F.when(F.length(text) <= chars, text).otherwise(F.concat(F.substring(text, 1, chars), note))


def clip_text(text: Column, chars: int = 400) -> Column:
    return F.when(F.length(text) <= chars, text).otherwise(F.concat(F.substring(text, 1, chars), F.lit("…")))


#: White space of any script, and the four control characters that separate records.
SPACE = r"(?U)[\s\x1C-\x1F]+"


def strip_text(text: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(text, rf"\A{SPACE}|{SPACE}\z", "")


def norm_text(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != ""))


def cost_micro_usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Millionths of a dollar, exactly; a missing price is none."""
    return (tokens_in * F.coalesce(price_in, F.lit(0)) + tokens_out * F.coalesce(price_out, F.lit(0))).cast("long")


def acceptance_score(verdict: Column, confidence: Column, flipped: Column, penalty: float = DEFAULT.flip_penalty) -> Column:
    """Near 1 for a sure accept, near 0 for a sure reject; a verdict that flips with the order is drawn to 0.5."""
    score = F.when(verdict == "accept", confidence).otherwise(F.lit(1.0) - confidence)
    return F.when(flipped, F.lit(0.5) + (score - F.lit(0.5)) * F.lit(1.0 - penalty)).otherwise(score)


def route_label(score: Column, p: Params = DEFAULT) -> Column:
    return F.when(score >= F.lit(p.high), "auto_accept").when(score <= F.lit(p.low), "auto_reject").otherwise("human_review")


def seeded_rank_key(seed: int, salt: str, key: Column) -> Column:
    """Rows in the order of this value are shuffled, alike on every run."""
    return F.sha1(F.concat(F.lit(f"{seed}|{salt}|"), key))
