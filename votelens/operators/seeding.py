"""Labelled test data: assignment of items, and known defects of both scopes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votelens.functions.columns import hash_bucket, seeded_rank_key, swap_letters
from votelens.params import BOILERPLATE_TEMPLATES, DEFAULT, ITEM_DEFECT_TYPES, RUSHED_TEXTS, Params


def seeded_rank(df: DataFrame, key: str, salt: str, seed: int = DEFAULT.seed, name: str = "rank") -> DataFrame:
    """Adds the rank (from 1) of each row in a seeded order that the input's order does not change.

    The order is that of a hash's hex digits.  Rows are ranked within the first three digits; the offsets of these 4096
    buckets are a running sum over a table of that size, so no task sorts all rows.
    """
    hashed = df.withColumn("_h", seeded_rank_key(seed, salt, F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_b", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return hashed.withColumn("_i", inside).join(F.broadcast(offsets), "_b").withColumn(name, F.col("_before") + F.col("_i")).drop("_h", "_b", "_i", "_before")


def load_shifts(n: int, seed: int = DEFAULT.seed) -> list[int]:
    """By how much each annotator's load differs from an even one: 0 to 2 up for one of a pair, and down for the other."""
    shifts = [0] * n
    for i in range(0, n - 1, 2):
        d = int(hashlib.sha1(f"{seed}|load|{i}".encode()).hexdigest()[:8], 16) % 3
        shifts[i], shifts[i + 1] = d, -d
    return shifts


def assign_items(items: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """item_id, annotator_id: every item once, loads even to within two items (loads under two stay even)."""
    spark = items.sparkSession
    rows = [(i, f"ann_{i:02d}", d) for i, d in enumerate(load_shifts(p.n_annotators, p.seed))]
    annotators = spark.createDataFrame(rows, "i int, annotator_id string, shift int")
    n = items.agg(F.count(F.lit(1)).alias("n"))
    base = F.floor(F.col("n") / p.n_annotators)
    load = base + F.when(F.col("i") < F.col("n") % p.n_annotators, 1).otherwise(0) + F.when(base >= 2, F.col("shift")).otherwise(0)
    upto = F.sum("load").over(Window.orderBy("i"))
    ranges = annotators.crossJoin(n).withColumn("load", load).withColumn("upto", upto).select("annotator_id", (F.col("upto") - F.col("load")).alias("above"), "upto")
    ranked = seeded_rank(items.select("item_id"), "item_id", "assign", p.seed)
    return ranked.join(F.broadcast(ranges), (F.col("rank") > F.col("above")) & (F.col("rank") <= F.col("upto"))).select("item_id", "annotator_id")


def pick_defective(annotators: DataFrame, per_type: int = 2, seed: int = DEFAULT.seed) -> DataFrame:
    """annotator_id, defect_type: the first annotators in a seeded order reuse texts, the next vote for one side."""
    ranked = seeded_rank(annotators.select("annotator_id"), "annotator_id", "defective", seed)
    kind = F.when(F.col("rank") <= per_type, "BOILERPLATE").otherwise("POSITION_BIAS")
    return ranked.where(F.col("rank") <= 2 * per_type).select("annotator_id", kind.alias("defect_type"))


def injection_plan(clean: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """item_id, defect_type for a seeded share (rounded down) of clean annotators' items; both types take turns."""
    n = clean.agg(F.floor(F.count(F.lit(1)) * p.item_defect_percent / 100).alias("n"))
    ranked = seeded_rank(clean.select("item_id"), "item_id", "inject", p.seed)
    kind = F.when(F.col("rank") % 2 == 1, ITEM_DEFECT_TYPES[0]).otherwise(ITEM_DEFECT_TYPES[1])
    return ranked.join(F.broadcast(n), F.col("rank") <= F.col("n")).select("item_id", kind.alias("defect_type"))


def inject_item_defects(submissions: DataFrame, plan: DataFrame) -> DataFrame:
    """Submissions with the planned defects; other rows as they were."""
    joined = submissions.drop("is_defective", "defect_type").join(plan, "item_id", "left")
    template = F.element_at(F.array(*map(F.lit, RUSHED_TEXTS)), (hash_bucket(F.concat(F.lit("rushed|"), "item_id")) % len(RUSHED_TEXTS) + 1).cast("int"))
    text = (
        F.when(F.col("defect_type") == "RUSHED", F.replace(template, F.lit("{v}"), F.col("vote")))
        .when(F.col("defect_type") == "SELF_CONTRADICTION", swap_letters(F.col("justification"))).otherwise(F.col("justification"))
    )
    return joined.withColumn("justification", text).withColumn("is_defective", F.col("defect_type").isNotNull())


def seed_annotator_defects(submissions: DataFrame, items: DataFrame, defective: DataFrame) -> DataFrame:
    """All items of defective annotators: a reused text with the gold vote, or the vote A.

    Reused texts go to the annotators by their rank among those who reuse; that table has few rows.
    """
    rank = F.dense_rank().over(Window.partitionBy("defect_type").orderBy("annotator_id")) - 1
    template = F.element_at(F.array(*map(F.lit, BOILERPLATE_TEMPLATES)), (F.col("rank") % len(BOILERPLATE_TEMPLATES) + 1).cast("int"))
    known = defective.withColumn("rank", rank).select("annotator_id", "defect_type", F.when(F.col("defect_type") == "BOILERPLATE", template).alias("template"))
    joined = submissions.drop("is_defective", "defect_type").join(known, "annotator_id").join(items.select("item_id", "human_gold_vote"), "item_id")
    vote = F.when(F.col("defect_type") == "BOILERPLATE", F.col("human_gold_vote")).otherwise("A")
    return joined.select("item_id", "annotator_id", vote.alias("vote"), F.coalesce("template", "justification").alias("justification"), F.lit(True).alias("is_defective"), "defect_type")
