"""What a grader may look up: the annotator's other work, the peers' votes, the full texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votelens.functions.columns import other_side, swap_letters
from votelens.params import DEFAULT
from votelens.sources.tables import scratch


def first_submissions(submissions: DataFrame, k: int = DEFAULT.history_limit) -> DataFrame:
    """annotator_id, first: an annotator's first k + 1 submissions by item_id, as an array in one row.

    Only these can be anybody's history of k others.  Keys alone are ranked; then at most k + 1 texts an annotator move, once.
    """
    rank = F.row_number().over(Window.partitionBy("annotator_id").orderBy("item_id"))
    keys = submissions.select("annotator_id", "item_id").withColumn("rk", rank).where(F.col("rk") <= k + 1).select("item_id", "annotator_id")
    texts = submissions.select("item_id", F.col("vote").alias("other_vote"), F.col("justification").alias("other_text"))
    entry = F.struct(F.col("item_id").alias("other_id"), "other_vote", "other_text")
    return keys.join(texts, "item_id").groupBy("annotator_id").agg(F.array_sort(F.collect_list(entry)).alias("first"))


#: Annotators whose histories may be broadcast, and the bytes of these; the sketch that finds them tracks TRACKED values.
HEAVY_ANNOTATORS, TRACKED, BROADCAST_BYTES = 1000, 10_000, 1 << 26


def heavy_annotators(submissions: DataFrame, most: int = HEAVY_ANNOTATORS) -> tuple[list[str], bool]:
    """The annotators of most submissions, found by a sketch of bounded size, and whether they are all annotators there are.

    One pass over a single column.  The sketch may miss an annotator of few submissions, never one that holds more than a
    few of TRACKED parts of all rows.
    """
    row = submissions.select("annotator_id").agg(F.expr(f"approx_top_k(annotator_id, {most}, {TRACKED})").alias("top")).first()
    found = [t["item"] for t in row["top"]]
    return [a for a in found if a is not None], len(found) < most


def split_histories(
    submissions: DataFrame, k: int = DEFAULT.history_limit, most: int = HEAVY_ANNOTATORS, most_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame | None]:
    """(annotator_id, first) of the heavy annotators, to broadcast, and (item_id, first_too) of the other annotators' items.

    The heavy ones' arrays are stored and their bytes measured; the largest annotators that fit into `most_bytes` are taken.
    Of the others, who have few items each, the arrays meet keys alone, and move on by item: so nobody's views are gathered
    by annotator.  None for the others where there are none.
    """
    heavy, whole = heavy_annotators(submissions, most)
    of = F.col("annotator_id").isin(heavy) if heavy else F.lit(False)
    held = first_submissions(submissions.where(of), k)
    path = scratch(submissions.sparkSession, "histories")
    size = F.aggregate("first", F.lit(0).cast("long"), lambda n, x: n + 64 + F.octet_length(F.coalesce(x["other_text"], F.lit(""))))
    held.withColumn("bytes", size).write.parquet(path)
    stored = submissions.sparkSession.read.parquet(path)
    bytes_of = {r["annotator_id"]: r["bytes"] for r in stored.select("annotator_id", "bytes").collect()}  # at most `most` rows
    taken, total = [], 0
    for annotator in heavy:  # in the order of their submissions
        total += bytes_of.get(annotator, 0)
        if total > most_bytes:
            break
        taken.append(annotator)
    ours = stored.where(F.col("annotator_id").isin(taken) if taken else F.lit(False)).select("annotator_id", "first")
    if whole and len(taken) == len(heavy):
        return ours, None
    rest = submissions.where(~F.col("annotator_id").isin(taken)) if taken else submissions
    return ours, rest.select("item_id", "annotator_id").join(first_submissions(rest, k), "annotator_id").select("item_id", F.col("first").alias("first_too"))


def own_history(k: int = DEFAULT.history_limit) -> Column:
    """An item's history, of the columns item_id and first: the first k submissions but itself, in place."""
    others = F.filter("first", lambda x: x["other_id"] != F.col("item_id"))
    return F.slice(F.coalesce(others, F.array().cast("array<struct<other_id:string,other_vote:string,other_text:string>>")), 1, k)


def annotator_history(submissions: DataFrame, k: int = DEFAULT.history_limit) -> DataFrame:
    """item_id, annotator_id, pos (from 1), other_id, other_vote, other_text: an annotator's first k other submissions."""
    known = submissions.select("item_id", "annotator_id").join(first_submissions(submissions, k), "annotator_id")
    return known.select("item_id", "annotator_id", F.posexplode(own_history(k)).alias("at", "h")).select(
        "item_id", "annotator_id", (F.col("at") + 1).alias("pos"), "h.*"
    )


def in_order(vote: Column, order_label: Column) -> Column:
    """A vote as a view of that order shows it."""
    return F.when(order_label == "swapped", other_side(vote)).otherwise(vote)


def history_patterns(submissions: DataFrame, k: int = DEFAULT.history_limit) -> DataFrame:
    """item_id, n_history, reused_text (5 or more, all alike), constant_side (6 or more votes, all alike)."""
    known = submissions.select("item_id", "annotator_id").join(first_submissions(submissions, k), "annotator_id")
    history = known.select("item_id", own_history(k).alias("h")).where(F.size("h") > 0)
    n = F.size("h")

    def alike(field: str) -> Column:
        return F.size(F.array_distinct(F.array_compact(F.transform("h", lambda x: x[field])))) == 1

    return history.select(
        "item_id", n.cast("long").alias("n_history"), ((n >= 5) & alike("other_text")).alias("reused_text"),
        ((n >= 6) & alike("other_vote")).alias("constant_side"),
    )


def peer_bundle(peers: DataFrame) -> DataFrame:
    """item_id, order_label, peers: the judges' votes in the order of their names, as either view shows them."""
    orders = F.explode(F.array(F.lit("original"), F.lit("swapped"))).alias("order_label")
    shown = peers.select("item_id", "judge", "vote", orders).withColumn("vote", in_order(F.col("vote"), F.col("order_label")))
    return shown.groupBy("item_id", "order_label").agg(F.array_sort(F.collect_list(F.struct("judge", "vote"))).alias("peers"))


def evidence_bundle(
    views: DataFrame, submissions: DataFrame, peers: DataFrame, k: int = DEFAULT.history_limit, most: int = HEAVY_ANNOTATORS, most_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per item and order: the view, its history (at most k rows) and its peers, as arrays.

    The texts of a view stay where the join by item put them: histories of heavy annotators come by a broadcast of measured
    size, those of the others by item, and peers by item, in the original order, which each view then shows its own way.
    """
    heavy, rest = split_histories(submissions, k, most, most_bytes)
    of_item = peers.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("judge", "vote"))).alias("peers"))
    joined = views.join(of_item, "item_id", "left").join(F.broadcast(heavy), "annotator_id", "left")
    if rest is not None:
        joined = joined.join(rest, "item_id", "left").withColumn("first", F.coalesce("first", "first_too")).drop("first_too")
    swap = F.col("order_label") == "swapped"

    def shown(h: Column) -> Column:
        return F.struct(
            h["other_id"].alias("item_id"), in_order(h["other_vote"], F.col("order_label")).alias("vote"),
            F.when(swap, swap_letters(h["other_text"])).otherwise(h["other_text"]).alias("justification"),
        )

    votes = F.transform("peers", lambda x: F.struct(x["judge"].alias("judge"), in_order(x["vote"], F.col("order_label")).alias("vote")))
    return joined.withColumn("history", F.transform(own_history(k), shown)).drop("first").withColumn(
        "peers", F.coalesce(votes, F.array().cast("array<struct<judge:string,vote:string>>"))
    )


def item_dossier(items: DataFrame, submissions: DataFrame, grades: DataFrame, routed: DataFrame) -> DataFrame:
    """All that is known of each given item."""
    keys = items.select("item_id")
    g = grades.join(keys, "item_id", "left_semi").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("mode", "order_label", "verdict", "confidence", "escalated"))).alias("grades"))
    r = routed.join(keys, "item_id", "left_semi").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("mode", "route", "path"))).alias("routes"))
    return items.join(submissions, "item_id", "left").join(g, "item_id", "left").join(r, "item_id", "left")


def verify_requests(grades: DataFrame, views: DataFrame) -> DataFrame:
    """Agent verdicts to be reviewed, with the view that they judged; escalated runs have nothing to review."""
    done = grades.where("mode = 'agent' and not escalated").select("item_id", "order_label", "dimension_scores", F.col("verdict").alias("grader_verdict"), F.col("confidence").alias("grader_confidence"), "reason")
    return done.join(views, ["item_id", "order_label"])


def example_trace(traces: DataFrame, truth: DataFrame, grades: DataFrame) -> DataFrame:
    """The first item (by id) whose contradiction the agent caught, with its trace as one JSON text."""
    key = ["item_id", "order_label", "mode", "rubric_version"]
    wanted = "mode = 'agent' and order_label = 'original'"
    caught = grades.where(wanted).where("verdict = 'reject' or escalated").select(*key)
    bad = truth.where("defect_type = 'SELF_CONTRADICTION'").select("item_id")
    return traces.where(wanted).join(bad, "item_id", "left_semi").join(caught, key, "left_semi").orderBy("item_id").limit(1).select("item_id", "trace")


