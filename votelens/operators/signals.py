"""Layer 0: what an annotator's votes and texts show without any grader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votelens.functions.columns import norm_text, ratio
from votelens.params import DEFAULT, Params


def annotator_signals(submissions: DataFrame) -> DataFrame:
    """annotator_id, n_items, side_ratio, dup_ratio.

    Texts are counted by a hash of their normal form (256 bits: no two differ alike), so no text is shuffled; the second
    step has a row per annotator and different text, and partial sums keep a busy annotator from filling one task.
    """
    per_text = submissions.groupBy("annotator_id", F.sha2(norm_text(F.col("justification")), 256).alias("text_hash")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("vote") == "A").alias("a"), F.count_if(F.col("vote") == "B").alias("b")
    )
    totals = per_text.groupBy("annotator_id").agg(
        F.sum("n").alias("n_items"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("n").alias("most_used")
    )
    return totals.select(
        "annotator_id", "n_items", ratio(F.greatest("a", "b"), F.col("n_items")).alias("side_ratio"),
        ratio(F.col("most_used"), F.col("n_items")).alias("dup_ratio"),
    )


def annotator_flags(submissions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Signals with flagged and reason; thresholds meet the unrounded ratios, and few items are never flagged."""
    signals = annotator_signals(submissions)
    reasons = F.concat_ws(
        "+", F.when(F.col("side_ratio") >= F.lit(p.side_ratio_flag), "constant_side"),
        F.when(F.col("dup_ratio") >= F.lit(p.dup_ratio_flag), "justification_reuse"),
    )
    reason = F.when(F.col("n_items") >= p.min_items, F.nullif(reasons, F.lit("")))
    return signals.withColumn("reason", reason).withColumn("flagged", F.col("reason").isNotNull())


def layer0_overlay(scored: DataFrame, flags: DataFrame) -> DataFrame:
    """Items of flagged annotators get score 0 and are no longer escalated.

    Flagged annotators are joined without a hint: Spark broadcasts them if they are few, by its measured size.
    """
    bad = flags.where("flagged").select("annotator_id", F.lit(True).alias("agg_flagged"))
    joined = scored.join(bad, "annotator_id", "left").withColumn("agg_flagged", F.coalesce("agg_flagged", F.lit(False)))
    return overlaid(joined)


def overlaid(marked: DataFrame) -> DataFrame:
    """The overlay on records, or pooled records, that have agg_flagged already."""
    return marked.withColumn("score", F.when(F.col("agg_flagged"), F.lit(0.0)).otherwise(F.col("score"))).withColumn(
        "escalated", ~F.col("agg_flagged") & F.col("escalated")
    )


def peer_agreement(peers: DataFrame, submissions: DataFrame) -> DataFrame:
    """item_id, n_votes (of judges who took a side), n_agree (of those with the annotator)."""
    joined = peers.select("item_id", F.col("vote").alias("peer")).join(submissions.select("item_id", "vote"), "item_id")
    return joined.groupBy("item_id").agg(
        F.count_if(F.col("peer") != "tie").alias("n_votes"), F.count_if(F.col("peer") == F.col("vote")).alias("n_agree")
    )


def annotator_load(submissions: DataFrame) -> DataFrame:
    """How items spread: annotators, items, least and most per annotator, defective items."""
    each = submissions.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_defective").alias("bad"))
    return each.agg(
        F.count(F.lit(1)).alias("n_annotators"), F.sum("n").alias("n_items"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("bad").alias("n_defective")
    )


def annotator_roster(annotators: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every annotator with the number of assigned items, also 0."""
    counts = assignments.groupBy("annotator_id").agg(F.count("item_id").alias("n_items"))
    return annotators.join(counts, "annotator_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))


def clean_submissions(submissions: DataFrame, annotators: DataFrame) -> DataFrame:
    """Submissions of annotators that are not defective."""
    return submissions.join(annotators.where("not is_defective").select("annotator_id"), "annotator_id", "left_semi")


def defect_counts(defects: DataFrame) -> DataFrame:
    return defects.groupBy("scope", "defect_type").agg(F.count(F.lit(1)).alias("n"))


def defect_truth(submissions: DataFrame, item_types: tuple[str, ...]) -> DataFrame:
    """item_id, defect_type, scope: item for defects of one item, annotator for those of all an annotator's items."""
    scope = F.when(F.col("defect_type").isin(*item_types), "item").otherwise("annotator")
    return submissions.where("is_defective").select("item_id", "defect_type", scope.alias("scope"))
