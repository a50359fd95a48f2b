"""Scores, routes and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.functions.columns import acceptance_score, ratio, route_label
from votelens.params import DEFAULT, DEFECT_TYPES, Params

PAIR = ["item_id", "mode", "rubric_version"]


def paired_grades(grades: DataFrame) -> DataFrame:
    """Both orders of a run in one row, by one grouping instead of a self-join; runs with one order only are left out."""

    def of(order: str, column: str) -> Column:
        return F.max(F.when(F.col("order_label") == order, F.col(column)))

    both = grades.groupBy(*PAIR).agg(
        of("original", "verdict").alias("verdict_original"), of("swapped", "verdict").alias("verdict_swapped"),
        of("original", "confidence").alias("confidence"), of("original", "reason").alias("reason"),
        F.coalesce(F.bool_or("escalated"), F.lit(False)).alias("escalated"),
        F.count_if(F.col("order_label") == "original").alias("n_original"), F.count_if(F.col("order_label") == "swapped").alias("n_swapped"),
    )
    return both.where("n_original > 0 and n_swapped > 0").drop("n_original", "n_swapped")


def _score(p: Params) -> Column:
    flipped = F.col("verdict_original") != F.col("verdict_swapped")
    return F.when(~F.col("escalated"), acceptance_score(F.col("verdict_original"), F.col("confidence"), flipped, p.flip_penalty))


def route_items(grades: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The `routed` table: an escalation in either order goes to review without a score."""
    pairs = paired_grades(grades).withColumn("score", _score(p))
    route = F.when(F.col("escalated"), "human_review").otherwise(route_label(F.col("score"), p))
    path = F.when(F.col("escalated"), "AGENT_ESCALATED").when(F.col("route") == "human_review", "THRESHOLD_ROUTED").otherwise("AUTO")
    return pairs.withColumn("route", route).withColumn("path", path).select(
        *PAIR, "verdict_original", "verdict_swapped",
        F.when(~F.col("escalated"), F.col("verdict_original") != F.col("verdict_swapped")).alias("flipped"),
        F.col("score").alias("confidence"), "route", "path", "reason",
    )


def route_summary(routed: DataFrame) -> DataFrame:
    return routed.groupBy("mode", "route", "path").agg(F.count(F.lit(1)).alias("n"))


def scored_records(grades: DataFrame, truth: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """item_id, mode, score, flipped, escalated, is_defective, defect_type, annotator_id: the basis of all metrics."""
    pairs = paired_grades(grades).withColumn("score", _score(p)).withColumn(
        "flipped", F.coalesce(F.col("verdict_original") != F.col("verdict_swapped"), F.lit(False))
    )
    return pairs.select("item_id", "mode", "score", "flipped", "escalated").join(
        truth.select("item_id", F.coalesce("is_defective", F.lit(False)).alias("is_defective"), "defect_type", "annotator_id"), "item_id"
    )


def pooled(scored: DataFrame, *by: str) -> DataFrame:
    """Records that no metric tells apart, as one row with their number n: the size no longer depends on the items.

    Records that are pooled already, by more columns, are pooled further.
    """
    n = F.sum("n") if "n" in scored.columns else F.count(F.lit(1))
    return scored.groupBy(*by, "score", "escalated", "is_defective", "defect_type").agg(n.alias("n"))


def pooled_by_flag(scored: DataFrame, flags: DataFrame) -> DataFrame:
    """Records pooled by mode and by whether their annotator is flagged: both sides of the layer-0 comparison come from it."""
    bad = flags.where("flagged").select("annotator_id", F.lit(True).alias("agg_flagged"))
    return pooled(scored.join(bad, "annotator_id", "left").withColumn("agg_flagged", F.coalesce("agg_flagged", F.lit(False))), "mode", "agg_flagged")


def _sum(test: Column, n: str | Column = "n") -> Column:
    return F.coalesce(F.sum(F.when(test, F.col(n) if isinstance(n, str) else n)), F.lit(0)).cast("long")


def named_metrics(high: Column, low: Column, score: Column | None = None, escalated: Column | None = None) -> list[tuple[str, Column]]:
    """Counts and ratios over pooled records; recall has flagged items only, catch also escalated ones."""
    score = F.col("score") if score is None else score
    given_up = F.col("escalated") if escalated is None else escalated
    flagged = ~given_up & (score <= low)
    review = given_up | ((score > low) & (score < high))
    bad = F.col("is_defective")
    return [
        ("n_items", F.sum("n")), ("n_flagged", _sum(flagged)), ("n_escalated", _sum(given_up)),
        ("precision", ratio(_sum(flagged & bad), _sum(flagged))), ("recall", ratio(_sum(flagged & bad), _sum(bad))),
        ("catch_rate", ratio(_sum(bad & (given_up | flagged)), _sum(bad))), ("review_load", ratio(_sum(review), F.sum("n"))),
    ]


def metric_columns(high: Column, low: Column) -> list[Column]:
    return [column.alias(name) for name, column in named_metrics(high, low)]


def flag_metrics(scored: DataFrame, by: list[str], p: Params = DEFAULT) -> DataFrame:
    return pooled(scored, *by).groupBy(*by).agg(*metric_columns(F.lit(p.high), F.lit(p.low)))


def recall_by_type(scored: DataFrame, by: list[str], p: Params = DEFAULT) -> DataFrame:
    """by, defect_type, n_type, recall, catch_rate over the fixed types; null where a type has no items."""
    spark = scored.sparkSession
    types = spark.createDataFrame([(t,) for t in DEFECT_TYPES], "defect_type string")
    flagged = ~F.col("escalated") & (F.col("score") <= F.lit(p.low))
    pool = pooled(scored, *by)
    found = pool.where("is_defective").groupBy(*by, "defect_type").agg(
        F.sum("n").alias("n_type"), ratio(_sum(flagged), F.sum("n")).alias("recall"), ratio(_sum(flagged | F.col("escalated")), F.sum("n")).alias("catch_rate")
    )
    return pool.select(*by).distinct().crossJoin(F.broadcast(types)).join(found, [*by, "defect_type"], "left").withColumn(
        "n_type", F.coalesce("n_type", F.lit(0).cast("long"))
    )


def bucketed(scored: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """mode, under, over, escalated, n, bad, and n of each defect type: records by their place among the sorted thresholds.

    `under` is how many low thresholds are below a score, `over` how many high ones it reaches; both are null without a
    score.  So there are at most (lows + 1) x (highs + 1) rows a mode for one kind of record, whatever the scores are.
    """
    score = F.when(~F.col("escalated"), F.col("score"))

    def below(thresholds: list[float], reached: bool) -> Column:
        return sum(((score >= F.lit(t)) if reached else (score > F.lit(t))).cast("int") for t in thresholds)

    n = F.col("n") if "n" in scored.columns else F.lit(1)
    bad = F.col("is_defective")
    return scored.groupBy("mode", below(sorted(p.sweep_low), False).alias("under"), below(sorted(p.sweep_high), True).alias("over"), "escalated").agg(
        F.sum(n).alias("n"), _sum(bad, n).alias("bad"), *[_sum(bad & (F.col("defect_type") == t), n).alias(t) for t in DEFECT_TYPES]
    )


def calibration_sweep(scored: DataFrame, costs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per mode and (high, low) with low < high, with recall and catch by type, and the operating row marked.

    Counts of records by their place among the thresholds (`bucketed`) become running counts over the low and over the high
    thresholds, one row a mode; each cell of the grid reads two of them.  The cost does not depend on how many different
    scores there are, and nothing is joined with the grid.  `costs` has mode and micro_usd, or cost_per_1000_usd.
    """
    lows, highs = sorted(p.sweep_low), sorted(p.sweep_high)
    given_up = F.col("escalated")

    def running(column: str) -> Column:
        """How many have a score at or under each low threshold."""
        return F.array(*[_sum(F.col("under") <= i, column) for i in range(len(lows))]).alias(f"under_{column}")

    kinds = ("n", "bad", *DEFECT_TYPES)
    modes = bucketed(scored, p).groupBy("mode").agg(
        *[F.sum(c).alias(f"all_{c}") for c in kinds], *[_sum(given_up, c).alias(f"given_up_{c}") for c in kinds], *[running(c) for c in kinds],
        _sum(F.col("under").isNotNull(), "n").alias("with_score"), F.array(*[_sum(F.col("over") > j, "n") for j in range(len(highs))]).alias("over_n"),
    )
    grid = [F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), F.lit(h).alias("high"), F.lit(low).alias("low")) for j, h in enumerate(highs) for i, low in enumerate(lows) if low < h]
    cells = modes.select("*", F.explode(F.array(*grid)).alias("g")).select("*", "g.*")

    def flagged(column: str) -> Column:
        return F.element_at(f"under_{column}", F.col("i"))

    review = F.col("given_up_n") + F.col("with_score") - flagged("n") - F.element_at("over_n", F.col("j"))
    shares = [ratio(flagged("bad"), flagged("n")).alias("precision")]
    for column, recall, catch in (("bad", "recall", "catch_rate"), *[(t, f"recall_{t}", f"catch_{t}") for t in DEFECT_TYPES]):
        shares += [ratio(flagged(column), F.col(f"all_{column}")).alias(recall), ratio(flagged(column) + F.col(f"given_up_{column}"), F.col(f"all_{column}")).alias(catch)]
    operating = (F.col("high") == F.lit(p.high)) & (F.col("low") == F.lit(p.low))
    found = cells.select(
        "mode", "high", "low", F.col("all_n").alias("n_items"), flagged("n").alias("n_flagged"), F.col("given_up_n").alias("n_escalated"), *shares,
        ratio(review, F.col("all_n")).alias("review_load"), operating.alias("operating"),
    )
    return with_arm_cost(found, costs)


def with_arm_cost(metrics: DataFrame, costs: DataFrame) -> DataFrame:
    """`metrics` (mode, n_items) of modes that have a cost, with cost_per_1000_usd: as given, or of the arm's micro_usd."""
    if "cost_per_1000_usd" in costs.columns:
        return metrics.join(costs.select("mode", "cost_per_1000_usd"), "mode")
    return metrics.join(costs.select("mode", "micro_usd"), "mode").withColumn("cost_per_1000_usd", ratio(F.col("micro_usd"), F.col("n_items") * 1000)).drop("micro_usd")


def ablation_table(scored: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """defect_type (and Overall) by arm: recall, and catch where an arm can escalate."""
    flagged = ~F.col("escalated") & (F.col("score") <= F.lit(p.low))
    pool = pooled(scored, "mode").where("is_defective")
    cells = pool.groupingSets([["mode", "defect_type"], ["mode"]], "mode", "defect_type").agg(
        ratio(_sum(flagged), F.sum("n")).alias("recall"), ratio(_sum(flagged | F.col("escalated")), F.sum("n")).alias("catch_rate"), F.grouping("defect_type").alias("all")
    )
    row = F.when(F.col("all") == 1, "Overall").otherwise(F.col("defect_type")).alias("defect_type")

    def of(mode: str, column: str) -> Column:
        return F.max(F.when(F.col("mode") == mode, F.col(column)))

    return cells.select("mode", "recall", "catch_rate", row).groupBy("defect_type").agg(
        of("single", "recall").alias("recall_single"), of("agent", "recall").alias("recall_agent"), of("agent", "catch_rate").alias("catch_agent"),
        of("verifier", "recall").alias("recall_verifier"), of("verifier", "catch_rate").alias("catch_verifier"),
    )


def marginal_cost(metrics: DataFrame) -> DataFrame:
    """Dollars per point of recall and of catch gained per 1,000 items, arm over arm; null where nothing is gained.

    `metrics` has a row per mode, with its cost_per_1000_usd.
    """
    arms = metrics.select("mode", "recall", "catch_rate", "cost_per_1000_usd")
    a, b = (arms.select(*[F.col(c).alias(f"{c}_{x}") for c in arms.columns]) for x in "ab")
    pairs = metrics.sparkSession.createDataFrame([("single", "agent"), ("single", "verifier"), ("agent", "verifier")], "mode_a string, mode_b string")
    joined = F.broadcast(pairs).join(a, "mode_a").join(b, "mode_b")

    def per_point(column: str) -> Column:
        gain = (F.col(f"{column}_b") - F.col(f"{column}_a")) * F.lit(100.0)
        return F.when(gain > 0, (F.col("cost_per_1000_usd_b") - F.col("cost_per_1000_usd_a")) / gain)

    return joined.select(F.concat("mode_b", F.lit("_vs_"), "mode_a").alias("pair"), per_point("recall").alias("per_recall_point"), per_point("catch_rate").alias("per_catch_point"))


def layer0_effect(pool: DataFrame, costs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Arms without and with the annotator flags, which cost nothing; `pool` is of `pooled_by_flag`.

    One aggregation: both sides are sums over the same rows, where a flagged annotator's records count as rejected.
    """
    gone = F.col("agg_flagged")
    sides = {
        False: (F.col("score"), F.col("escalated")),
        True: (F.when(gone, F.lit(0.0)).otherwise(F.col("score")), ~gone & F.col("escalated")),
    }
    parts = []
    for on, (score, escalated) in sides.items():
        parts += [c.alias(f"{c_name}_{on}") for c_name, c in named_metrics(F.lit(p.high), F.lit(p.low), score, escalated)]
    names = [name for name, _ in named_metrics(F.lit(p.high), F.lit(p.low))]
    both = pool.where(F.col("mode").isin("single", "agent")).groupBy("mode").agg(*parts)
    rows = [F.struct(F.lit(on).alias("layer0"), *[F.col(f"{name}_{on}").alias(name) for name in names]) for on in sides]
    return with_arm_cost(both.select("mode", F.explode(F.array(*rows)).alias("r")).select("mode", "r.*"), costs)


def layer0_deltas(scored: DataFrame, overlaid: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Types whose recall the annotator flags move."""
    one, two = (
        recall_by_type(df.where(F.col("mode").isin("single", "agent")), ["mode"], p).select("mode", "defect_type", F.col("recall").alias(name))
        for df, name in ((scored, "before"), (overlaid, "after"))
    )
    return one.join(two, ["mode", "defect_type"]).where("before is not null and not (before <=> after)")


def escalation_report(scored: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """How many items either path sent to review, and how many of them are defective (agent arm)."""
    routed = ~F.col("escalated") & (F.col("score") > F.lit(p.low)) & (F.col("score") < F.lit(p.high))
    return scored.where("mode = 'agent'").agg(
        F.count_if("escalated").alias("n_agent_escalated"), F.count_if(routed).alias("n_threshold_routed"),
        F.count_if(F.col("escalated") & F.col("is_defective")).alias("escalated_defective"), F.count_if(routed & F.col("is_defective")).alias("threshold_defective"),
    )


def escalated_detail(scored: DataFrame, grades: DataFrame) -> DataFrame:
    """item_id, defect_type, orders (both orders' outcomes) of the agent arm's escalated items."""
    bad = scored.where("mode = 'agent' and escalated").select("item_id", "defect_type")
    outcome = F.struct(F.col("order_label").alias("order"), "verdict", "confidence", F.coalesce("escalated", F.lit(False)).alias("escalated"))
    both = grades.where("mode = 'agent'").groupBy("item_id").agg(F.array_sort(F.collect_list(outcome)).alias("orders"))
    return both.join(bad, "item_id")


def missed_items(scored: DataFrame, defect_type: str, p: Params = DEFAULT) -> DataFrame:
    return scored.where((F.col("defect_type") == defect_type) & ~F.col("escalated") & (F.col("score") > F.lit(p.low)))
