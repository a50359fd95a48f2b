"""Contracts, costs, pending work and completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from votelens.functions.columns import cost_micro_usd, ratio
from votelens.params import DEFAULT, MODES, ORDERS, Params
from votelens.schemas import ALLOWED, KEYS


def rules(name: str, df: DataFrame) -> dict[str, Column]:
    """What breaks each rule of a table that a row alone can break."""
    found = {f"allowed: {c}": F.col(c).isNotNull() & ~F.col(c).isin(*v) for c, v in ALLOWED.get(name, {}).items() if c in df.columns}
    found |= {f"not null: {c}": F.col(c).isNull() for c in KEYS[name]}
    if "confidence" in df.columns:
        found["range: confidence"] = F.col("confidence").isNotNull() & ~F.col("confidence").between(0.0, 1.0)
    if {"verdict", "escalated"} <= set(df.columns):
        found["verdict unless escalated"] = F.col("verdict").isNull() & ~F.coalesce("escalated", F.lit(False))
    return found


UNIQUE = "unique key"


def broken_keys(name: str, df: DataFrame) -> DataFrame:
    """key, rule, n: how many rows of a key break a rule; of `unique key`, how many rows share it.

    One scan and one grouping: each key's rows are counted by rule in partial sums, whatever the number of rules.
    """
    tests = rules(name, df)
    named = [F.struct(F.lit(rule).alias("rule"), F.col(f"_{i}").alias("n")) for i, rule in enumerate([*tests, UNIQUE])]
    rows = F.count(F.lit(1))
    counts = [F.count_if(test).alias(f"_{i}") for i, test in enumerate(tests.values())] + [F.when(rows > 1, rows).otherwise(F.lit(0)).alias(f"_{len(tests)}")]
    by_key = df.groupBy(*KEYS[name]).agg(*counts)
    key = F.to_json(F.struct(*KEYS[name]))
    return by_key.select(key.alias("key"), F.explode(F.filter(F.array(*named), lambda r: r["n"] > 0)).alias("r")).select("key", "r.*")


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, rule, n: how many rows break a rule, or how many keys are shared; rules that hold have no row."""
    parts = []
    for name, df in sorted(tables.items()):
        n = F.when(F.col("rule") == UNIQUE, F.count(F.lit(1))).otherwise(F.sum("n"))
        parts.append(broken_keys(name, df).groupBy("rule").agg(n.alias("n")).select(F.lit(name).alias("table_name"), "rule", "n"))
    return reduce(DataFrame.unionByName, parts)


def checked_write(name: str, df: DataFrame, path: str) -> dict[str, int]:
    """Writes good rows to `path`/ok=true, others with `violations` to ok=false, and tells rows and breaches of each rule.

    All in the one scan that writes: the counts are observed on the way.  Keys that rows share need a grouping, and are for
    `audit`.
    """
    tests = rules(name, df)
    broken = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in tests.items()]))
    marked = df.withColumn("violations", broken).withColumn("ok", F.size("violations") == 0)
    seen = Observation()
    counts = [F.count_if(F.array_contains("violations", rule)).alias(f"_{i}") for i, rule in enumerate(tests)]
    marked.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.partitionBy("ok").parquet(path)
    found = seen.get
    return {"rows": found["rows"], **{rule: found[f"_{i}"] for i, rule in enumerate(tests)}}


def with_cost(calls: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Calls with their exact cost; calls of mock runs and of models without a price cost nothing."""
    prices = calls.sparkSession.createDataFrame(list(p.prices), "model string, price_in long, price_out long")
    priced = calls.join(F.broadcast(prices), "model", "left")
    cost = F.when(F.col("mock"), F.lit(0).cast("long")).otherwise(cost_micro_usd(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")))
    return priced.withColumn("cost_micro_usd", cost).drop("price_in", "price_out")


def mode_cost(calls: DataFrame) -> DataFrame:
    """mode, micro_usd of grading calls; every mode has a row."""
    modes = calls.sparkSession.createDataFrame([(m,) for m in MODES], "mode string")
    spent = with_cost(calls).where("purpose = 'grade'").groupBy("mode").agg(F.sum("cost_micro_usd").alias("micro_usd"))
    return modes.join(spent, "mode", "left").select("mode", F.coalesce("micro_usd", F.lit(0).cast("long")).alias("micro_usd"))


def arm_spending(calls: DataFrame) -> DataFrame:
    """mode, micro_usd of the whole arm; the verifier's includes the agent's."""
    pays = F.explode(F.when(F.col("mode") == "agent", F.array(F.lit("agent"), F.lit("verifier"))).otherwise(F.array("mode")))
    return mode_cost(calls).withColumn("arm", pays).groupBy(F.col("arm").alias("mode")).agg(F.sum("micro_usd").alias("micro_usd"))


def arm_cost(calls: DataFrame, scored: DataFrame) -> DataFrame:
    """mode, micro_usd of the whole arm, n_items, cost_per_1000_usd; records may be pooled."""
    sizes = scored.groupBy("mode").agg((F.sum("n") if "n" in scored.columns else F.count(F.lit(1))).alias("n_items"))
    return arm_spending(calls).join(sizes, "mode").withColumn("cost_per_1000_usd", ratio(F.col("micro_usd"), F.col("n_items") * 1000))


def pending_work(items: DataFrame, grades: DataFrame, modes: tuple[str, ...] = MODES, orders: tuple[str, ...] = ORDERS) -> DataFrame:
    """(item, order, mode) without a grade."""
    spark = items.sparkSession
    work = spark.createDataFrame([(o, m) for o in orders for m in modes], "order_label string, mode string")
    wanted = items.select("item_id").crossJoin(F.broadcast(work))
    return wanted.join(grades.select("item_id", "order_label", "mode"), ["item_id", "order_label", "mode"], "left_anti")


def missing_deps(items: DataFrame, submissions: DataFrame, grades: DataFrame) -> DataFrame:
    """item_id, missing: no submission, or no agent grade in some order."""
    no_sub = items.select("item_id").join(submissions.select("item_id"), "item_id", "left_anti").select("item_id", F.lit("submission").alias("missing"))
    no_grade = pending_work(items, grades, ("agent",)).select("item_id", F.concat(F.lit("agent grade: "), "order_label").alias("missing"))
    return no_sub.unionByName(no_grade)


def completeness(items: DataFrame, grades: DataFrame) -> DataFrame:
    """mode, n_grades, expected, complete."""
    n = items.agg((F.count(F.lit(1)) * len(ORDERS)).alias("expected"))
    per_mode = grades.groupBy("mode").agg(F.count(F.lit(1)).alias("n_grades"))
    return per_mode.crossJoin(F.broadcast(n)).withColumn("complete", F.col("n_grades") == F.col("expected"))
