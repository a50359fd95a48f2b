"""Verdict payloads, batch scoring and the verifier's arm."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.functions.columns import ratio, strip_text
from votelens.params import DEFAULT, RUBRIC, Params
from votelens.schemas import RUN_KEY

VERDICT = "struct<dimension_scores:map<string,string>,verdict:string,confidence:string,reason:string>"
REVIEW = "struct<decision:string,confidence:string,reason:string>"

# ---------------------------------------------------------------- validation


def _confidence(text: Column) -> Column:
    return text.try_cast("double")


def validate_verdicts(payloads: DataFrame) -> DataFrame:
    """Adds valid, error (the first field that breaks a rule), verdict, confidence, reason (stripped), scores.

    Scores are whole numbers from 0 to 5, also when written as text or with a zero fraction; they are parsed as text
    first, as one odd value would otherwise void the whole map.
    """
    p = F.from_json("payload", VERDICT)
    scores = F.transform_values("_p.dimension_scores", lambda k, v: v.try_cast("double"))
    good_score = F.forall(F.map_values("_scores"), lambda v: F.coalesce((v == F.floor(v)) & v.between(0, 5), F.lit(False)))
    confidence = _confidence(F.col("_p.confidence"))
    error = (
        F.when(F.col("_p").isNull() | F.col("_p.dimension_scores").isNull() | ~good_score, "dimension_scores")
        .when(~F.coalesce(F.col("_p.verdict").isin("accept", "reject"), F.lit(False)), "verdict")
        .when(~F.coalesce(confidence.between(0, 1), F.lit(False)), "confidence")
        .when(F.coalesce(strip_text(F.col("_p.reason")), F.lit("")) == "", "reason")
    )
    out = payloads.withColumn("_p", p).withColumn("_scores", scores).withColumn("error", error)
    return out.select(
        *payloads.columns, F.col("error").isNull().alias("valid"), "error", F.col("_p.verdict").alias("verdict"), confidence.alias("confidence"),
        strip_text(F.col("_p.reason")).alias("reason"), F.transform_values("_scores", lambda k, v: v.try_cast("int")).alias("scores"),
    )


def dimension_mismatch(validated: DataFrame) -> DataFrame:
    """Adds missing and extra, the sorted dimensions that the rubric has and the verdict has not, and the reverse."""
    rubric, got = F.array(*map(F.lit, RUBRIC)), F.map_keys("scores")
    return validated.withColumn("missing", F.array_sort(F.array_except(rubric, got))).withColumn("extra", F.array_sort(F.array_except(got, rubric)))


def validate_reviews(payloads: DataFrame) -> DataFrame:
    p = F.from_json("payload", REVIEW)
    confidence = _confidence(F.col("_p.confidence"))
    error = (
        F.when(~F.coalesce(F.col("_p.decision").isin("uphold", "overturn"), F.lit(False)), "decision")
        .when(~F.coalesce(confidence.between(0, 1), F.lit(False)), "confidence")
        .when(F.coalesce(strip_text(F.col("_p.reason")), F.lit("")) == "", "reason")
    )
    return payloads.withColumn("_p", p).withColumn("error", error).select(
        *payloads.columns, F.col("error").isNull().alias("valid"), "error", F.col("_p.decision").alias("decision"), confidence.alias("confidence"), strip_text(F.col("_p.reason")).alias("reason")
    )


def retry_resolve(attempts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per run: the first of at most `max_attempts` attempts that is valid; else failed, with the last error."""
    checked = dimension_mismatch(validate_verdicts(attempts.where(F.col("attempt") <= p.max_attempts)))
    whole = (F.size("missing") == 0) & (F.size("extra") == 0)
    error = F.coalesce("error", F.when(~whole, "dimensions"))
    found = F.when(error.isNull(), F.struct("attempt", "verdict", "confidence", "reason"))
    return checked.groupBy(*RUN_KEY).agg(F.min(found).alias("r"), F.max_by(error, "attempt").alias("last_error")).select(
        *RUN_KEY, F.col("r").isNull().alias("failed"), "r.attempt", "r.verdict", "r.confidence", "r.reason",
        F.when(F.col("r").isNull(), F.col("last_error")).alias("last_error"),
    )


# ---------------------------------------------------------------- batch scoring

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def batch_grade(requests: DataFrame, make_scorer: Callable[[], Scorer], schema: str, workers: int | None = None) -> DataFrame:
    """Runs a caller's scorer over all requests, one client per partition; `workers` bounds how many run at a time."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            yield scorer(frame)

    return (requests.repartition(workers) if workers else requests).mapInPandas(work, schema)


# ---------------------------------------------------------------- verifier


def combined(p: Params = DEFAULT) -> tuple[Column, Column]:
    """verdict and confidence after a review: upheld, the mean of both; overturned, the reverse at a discount."""
    upheld = F.col("decision") == "uphold"
    other = F.when(F.col("grader_verdict") == "accept", "reject").otherwise("accept")
    mean = (F.col("grader_confidence") + F.col("review_confidence")) / F.lit(2.0)
    return F.when(upheld, F.col("grader_verdict")).otherwise(other), F.when(upheld, mean).otherwise(F.col("review_confidence") * F.lit(1.0 - p.overturn_penalty))


def verifier_grades(grades: DataFrame, reviews: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The verifier arm's grades: the agent's escalations are inherited, the reviewer's escalate, the rest are combined."""
    agent = grades.where("mode = 'agent'").select(
        "item_id", "order_label", "rubric_version", "dimension_scores", F.col("verdict").alias("grader_verdict"), F.col("confidence").alias("grader_confidence"),
        F.col("reason").alias("grader_reason"), F.coalesce("escalated", F.lit(False)).alias("inherited"),
    )
    review = reviews.select("item_id", "order_label", "decision", F.col("confidence").alias("review_confidence"), F.col("reason").alias("review_reason"), F.col("escalated").alias("gave_up"))
    joined = agent.join(review, ["item_id", "order_label"], "left").where("inherited or gave_up is not null")
    verdict, confidence = combined(p)
    escalated = F.col("inherited") | F.col("gave_up")
    reason = F.when(F.col("inherited"), F.col("grader_reason")).when(F.col("gave_up"), F.col("review_reason")).otherwise(F.concat(F.lit("["), "decision", F.lit("] "), "review_reason"))
    return joined.select(
        "item_id", "order_label", F.lit("verifier").alias("mode"), "rubric_version", F.when(~escalated, F.col("dimension_scores")).alias("dimension_scores"),
        F.when(~escalated, verdict).alias("verdict"), F.when(~escalated, F.bround(confidence, 4)).alias("confidence"), reason.alias("reason"), escalated.alias("escalated"), "inherited",
    )


def overturn_rate(reviews: DataFrame) -> DataFrame:
    done = reviews.where("not escalated")
    return done.agg(F.count(F.lit(1)).alias("n_reviews"), F.count_if(F.col("decision") == "overturn").alias("n_overturned"), ratio(F.count_if(F.col("decision") == "overturn"), F.count(F.lit(1))).alias("overturn_rate"))
