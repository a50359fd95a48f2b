"""The domain's tables, derived from the given ones.  All are lazy and grow with their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votelens.functions.columns import hash_bucket, other_side
from votelens.params import BOILERPLATE_TEMPLATES, MODES, ORDERS, RUBRIC, RUBRIC_VERSION

POSITION_BIASED = ("src3", "src11")
BOILERPLATE = ("src5", "src17")
MODEL = "grader-large"
QUESTIONS = 40


class Fixtures:
    """Readers of one scale's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------ judgments

    def messages(self) -> DataFrame:
        """conv_id, messages: the conversation without system turns, in order."""
        turns = self.given("conversations").where("role <> 'system'")
        return turns.groupBy("conv_id").agg(
            F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages")
        )

    def conversation_count(self) -> DataFrame:
        return self.given("conversations").agg(F.count_distinct("conv_id").alias("n_conv"))

    def judged(self) -> DataFrame:
        """One judgment per event, with its conversations' ids (conv_a, conv_b) instead of their texts."""
        e = self.given("events")
        k = F.get_json_object("props", "$.k").cast("long")
        block = F.floor(F.col("event_id") / 160)
        a, b = k % 4, (k % 4 + 1 + block % 3) % 4
        winner = F.when(F.col("event_type").isin("purchase", "signup"), "model_a").when(F.col("event_type").isin("click", "view"), "model_b").otherwise("tie")
        return e.crossJoin(F.broadcast(self.conversation_count())).select(
            F.col("event_id").alias("pos"), (F.col("event_id") % QUESTIONS).cast("int").alias("question_id"),
            F.when(F.floor(F.col("event_id") / 40) % 4 == 3, 2).otherwise(1).alias("turn"),
            F.concat(F.lit("expert_"), (F.col("user_id") % 30).cast("string")).alias("judge"),
            F.concat(F.lit("m"), a.cast("string")).alias("model_a"), F.concat(F.lit("m"), b.cast("string")).alias("model_b"),
            winner.alias("winner"),
            ((F.col("event_id") % QUESTIONS * 4 + a) % F.col("n_conv")).alias("conv_a"),
            ((F.col("event_id") % QUESTIONS * 4 + b) % F.col("n_conv")).alias("conv_b"),
        )

    def judged_messages(self) -> DataFrame:
        """The conversations that judgments are about: four for each question, however many events there are."""
        return self.messages().where(F.col("conv_id") < 4 * QUESTIONS)

    def raw_judgments(self) -> DataFrame:
        """One judgment per event, with both conversations as arrays of role and content."""
        return with_both(self.judged(), self.judged_messages(), "messages", "conversation").drop("conv_a", "conv_b")

    # ------------------------------------------------------------ submissions

    def submissions(self) -> DataFrame:
        d = self.given("documents").join(self.given("labels").select("doc_id", "quality"), "doc_id", "left")
        source = F.col("source")
        kind = (
            F.when(source.isin(*POSITION_BIASED), "POSITION_BIAS").when(source.isin(*BOILERPLATE), "BOILERPLATE")
            .when(F.col("quality") == 0, F.when(F.col("doc_id") % 2 == 0, "RUSHED").otherwise("SELF_CONTRADICTION"))
        )
        even = hash_bucket(F.concat(F.lit("vote|"), F.col("doc_id").cast("string"))) % 2 == 0
        vote = F.when(F.col("defect_type") == "POSITION_BIAS", "A").otherwise(F.when(even, "A").otherwise("B"))
        side = F.when(F.col("defect_type") == "SELF_CONTRADICTION", other_side(F.col("vote"))).otherwise(F.col("vote"))
        text = (
            F.when(F.col("defect_type") == "BOILERPLATE", BOILERPLATE_TEMPLATES[0])
            .when(F.col("defect_type") == "RUSHED", F.concat("vote", F.lit(" obviously.")))
            .otherwise(F.concat(F.lit("I preferred Response "), side, F.lit(" because "), "text"))
        )
        return (
            d.withColumn("defect_type", kind).withColumn("vote", vote).withColumn("justification", text)
            .select(F.col("doc_id").cast("string").alias("item_id"), source.alias("annotator_id"), "vote", "justification",
                    F.col("defect_type").isNotNull().alias("is_defective"), "defect_type")
        )

    def truth(self) -> DataFrame:
        """submissions without their texts: what the metrics need, so that no text is read."""
        return self.submissions().select("item_id", "annotator_id", "vote", "is_defective", "defect_type")

    def annotators(self) -> DataFrame:
        return self.given("documents").select(F.col("source").alias("annotator_id")).distinct().select(
            "annotator_id", F.col("annotator_id").isin(*POSITION_BIASED, *BOILERPLATE).alias("is_defective"),
            F.when(F.col("annotator_id").isin(*POSITION_BIASED), "POSITION_BIAS").when(F.col("annotator_id").isin(*BOILERPLATE), "BOILERPLATE").alias("defect_type"),
        )

    def items(self) -> DataFrame:
        """One item for each submission, its texts taken from conversations."""
        m = self.messages().select(
            "conv_id", F.coalesce(F.try_element_at("messages", F.lit(1))["content"], F.lit("")).alias("c0"),
            F.coalesce(F.try_element_at("messages", F.lit(2))["content"], F.lit("")).alias("c1"),
        )
        d = self.given("documents").select("doc_id").crossJoin(F.broadcast(self.conversation_count()))
        a, b = F.col("doc_id") % 4, (F.col("doc_id") % 4 + 1 + F.floor(F.col("doc_id") / 4) % 3) % 4
        gold = hash_bucket(F.concat(F.lit("gold|"), F.col("doc_id").cast("string"))) % 2 == 0
        base = d.select(
            "doc_id", (F.col("doc_id") % F.col("n_conv")).alias("conv_a"), ((F.col("doc_id") + 1) % F.col("n_conv")).alias("conv_b"),
            a.alias("a"), b.alias("b"), gold.alias("gold"),
        )
        one = m.select(F.col("conv_id").alias("conv_a"), F.col("c0").alias("question"), F.col("c1").alias("response_a"))
        two = m.select(F.col("conv_id").alias("conv_b"), F.col("c1").alias("response_b"))
        return base.join(one, "conv_a", "left").join(two, "conv_b", "left").select(
            F.col("doc_id").cast("string").alias("item_id"), (F.col("doc_id") % 40).cast("int").alias("question_id"),
            F.concat(F.lit("expert_"), (F.col("doc_id") % 30).cast("string")).alias("judge"), F.lit(1).alias("turn"),
            F.concat(F.lit("m"), F.col("a").cast("string")).alias("model_a"), F.concat(F.lit("m"), F.col("b").cast("string")).alias("model_b"),
            F.coalesce("question", F.lit("")).alias("question"), F.coalesce("response_a", F.lit("")).alias("response_a"),
            F.coalesce("response_b", F.lit("")).alias("response_b"), F.when(F.col("gold"), "A").otherwise("B").alias("human_gold_vote"),
        )

    def item_peers(self) -> DataFrame:
        """Up to three peer votes for each submission's item."""
        d = self.given("documents").select("doc_id").where("doc_id % 4 > 0")
        rows = d.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4 - 1).cast("int"))).alias("j"))
        h = hash_bucket(F.concat_ws("|", F.lit("peer"), F.col("doc_id").cast("string"), F.col("j").cast("string"))) % 3
        return rows.select(
            F.col("doc_id").cast("string").alias("item_id"),
            F.concat(F.lit("expert_"), ((F.col("doc_id") + 7 * F.col("j") + 1) % 30).cast("string")).alias("judge"),
            F.when(h == 0, "A").when(h == 1, "B").otherwise("tie").alias("vote"),
        )

    # ------------------------------------------------------------ grades, runs, calls

    def _runs(self) -> DataFrame:
        keys = self.given("documents").select(F.col("doc_id").cast("string").alias("item_id"))
        orders, modes = (F.explode(F.array(*map(F.lit, x))) for x in (ORDERS, MODES))
        all_ = keys.select("item_id", orders.alias("order_label")).select("*", modes.alias("mode"))
        return all_.withColumn("rubric_version", F.lit(RUBRIC_VERSION)).withColumn(
            "seed", hash_bucket(F.concat_ws("|", "item_id", "order_label", "mode"))
        )

    def grades(self) -> DataFrame:
        seed = F.col("seed")
        escalated = (F.col("mode") != "single") & (seed % 13 == 0)
        verdict = F.when(seed % 10 < 3, "reject").otherwise("accept")
        confidence = (55 + seed % 40).cast("double") / F.lit(100.0)
        scores = F.to_json(F.struct(*[((seed + i) % 6).cast("int").alias(d) for i, d in enumerate(RUBRIC)]))
        return self._runs().withColumn("escalated", escalated).select(
            "item_id", "order_label", "mode", "rubric_version", F.when(~F.col("escalated"), scores).alias("dimension_scores"),
            F.when(~F.col("escalated"), verdict).alias("verdict"), F.when(~F.col("escalated"), confidence).alias("confidence"),
            F.concat(F.lit("reason "), (seed % 7).cast("string")).alias("reason"), "escalated",
            (F.col("mode") != "single").__and__(seed % 17 == 0).alias("budget_exhausted"),
        )

    def runs(self) -> DataFrame:
        seed, mode = F.col("seed"), F.col("mode")
        n = F.when(mode == "single", 0).when(mode == "agent", seed % 7).otherwise(seed % 4).cast("int")
        cap = F.when(mode == "agent", F.col("n_tool_calls") >= 6).otherwise((mode == "verifier") & (F.col("n_tool_calls") >= 3))
        return self._runs().withColumn("n_tool_calls", n).withColumn("hit_cap", cap)

    def rounds(self) -> DataFrame:
        return self.runs().select("*", F.explode(F.sequence(F.lit(0), F.col("n_tool_calls"))).alias("i")).select(
            "item_id", "order_label", "mode", "rubric_version", "i",
            (500 + (F.col("seed") + 37 * F.col("i")) % 3000).cast("int").alias("tokens_in"),
            (40 + (F.col("seed") + F.col("i")) % 200).cast("int").alias("tokens_out"),
        )

    def call_log(self) -> DataFrame:
        """One row per round; every 50th call is of a model without a price."""
        model = F.when((F.col("tokens_in") + F.col("i")) % 50 == 0, "unlisted").otherwise(MODEL)
        return self.rounds().select(
            "item_id", F.lit("grade").alias("purpose"), "mode", "order_label", "rubric_version", model.alias("model"),
            F.lit(False).alias("mock"), "tokens_in", "tokens_out", (F.col("i") + 1).alias("attempts"),
        )

    def tool_events(self) -> DataFrame:
        kind = (F.col("seed") + F.col("i")) % 3
        name = F.when(kind == 0, "get_full_response").when(kind == 1, "get_peer_judgments").otherwise("get_annotator_history")
        return self.runs().where("n_tool_calls > 0").select(
            "*", F.explode(F.sequence(F.lit(0), F.col("n_tool_calls") - 1)).alias("i")
        ).select("item_id", "order_label", "mode", "rubric_version", "i", name.alias("name"), "seed")

    def traces(self) -> DataFrame:
        """One trace per run: a round and a tool call in turn, then a round and the verdict or the escalation, as JSON."""
        seed = F.col("seed")
        i = F.sequence(F.lit(0), F.col("n_tool_calls"))

        def round_(k: Column) -> Column:
            return F.struct(F.lit("api_round").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("reason"),
                            (500 + (seed + 37 * k) % 3000).cast("int").alias("tokens_in"), (40 + (seed + k) % 200).cast("int").alias("tokens_out"))

        def tool(k: Column) -> Column:
            kind = (seed + k) % 3
            name = F.when(kind == 0, "get_full_response").when(kind == 1, "get_peer_judgments").otherwise("get_annotator_history")
            none = F.lit(None).cast("int")
            return F.struct(F.lit("tool_call").alias("type"), name.alias("name"), F.lit(None).cast("string").alias("reason"), none.alias("tokens_in"), none.alias("tokens_out"))

        escalated = (F.col("mode") != "single") & (seed % 13 == 0)
        none = F.lit(None).cast("int")
        reason = F.when(escalated & (seed % 2 == 0), "  ").otherwise(F.concat(F.lit("reason "), (seed % 7).cast("string")))
        last = F.struct(F.when(escalated, "escalation").otherwise("verdict").alias("type"), F.lit(None).cast("string").alias("name"), reason.alias("reason"), none.alias("tokens_in"), none.alias("tokens_out"))
        pairs = F.flatten(F.transform(i, lambda k: F.when(k < F.col("n_tool_calls"), F.array(round_(k), tool(k))).otherwise(F.array(round_(k)))))
        return self.runs().select(
            "item_id", "order_label", "mode", "rubric_version", F.to_json(F.concat(pairs, F.array(last))).alias("trace"), "n_tool_calls", "hit_cap",
            escalated.alias("escalated"),
        )

    def odd_traces(self) -> DataFrame:
        """Traces of whole rounds (call, result, the budget's end), some of which break the protocol in a way that `seed` tells."""
        seed, n, odd = F.col("seed"), F.col("n_tool_calls"), F.col("seed") % 13
        budget = F.when(F.col("mode") == "agent", 6).when(F.col("mode") == "verifier", 3).otherwise(0)

        def event(kind: str, name: str | None = None) -> Column:
            return F.struct(F.lit(kind).alias("type"), F.lit(name).cast("string").alias("name"), F.when(seed % 2 == 0, "said").otherwise(" ").alias("reason"))

        def rounds(k: Column) -> Column:
            one = F.array(event("api_round"), event("tool_call", "get_full_response"), event("tool_result", "get_full_response"))
            return F.flatten(F.array_repeat(one, k.cast("int")))

        none = F.array().cast("array<struct<type:string,name:string,reason:string>>")
        spent = F.when((budget > 0) & (n >= budget), F.array(event("budget_exhausted"))).otherwise(none)
        ends = F.element_at(F.array(event("verdict"), event("review"), event("escalation")), (seed % 3 + 1).cast("int"))
        whole = F.concat(rounds(n), spent, F.array(event("api_round"), ends))
        size = F.size(whole)
        events = (
            F.when(odd == 0, F.slice(whole, F.lit(1), size - 2)).when(odd == 1, F.concat(whole, F.array(event("verdict")))).when(odd == 2, F.concat(F.array(event("tool_result", "x")), whole))
            .when((odd == 3) & (n > 0), F.concat(F.slice(whole, 1, 2), F.slice(whole, F.lit(4), size)))
            .when(odd == 4, F.concat(F.slice(whole, 1, 1), F.array(event("budget_exhausted")), F.slice(whole, F.lit(2), size)))
            .when(odd == 5, F.concat(rounds(n + 7), F.array(event("api_round"), event("verdict")))).when(odd == 6, F.array(event("api_round"), event("inherited_escalation"))).otherwise(whole)
        )
        trace = F.when(odd == 7, "not a list").otherwise(F.to_json(events))
        return self.runs().select("item_id", "order_label", "mode", "rubric_version", trace.alias("trace"), "n_tool_calls", "hit_cap", "seed")

    def payloads(self) -> DataFrame:
        """Verdict payloads as JSON, most of them broken in one way."""
        seed = F.col("seed")
        broken = seed % 11
        first = F.when(broken == 0, "7").when(broken == 5, '"4"').when(broken == 6, "4.0").otherwise("4")
        effort = F.when(broken == 4, "").otherwise(',"effort":3')
        scores = F.concat(F.lit('{"decision_plausibility":'), first, F.lit(',"justification_alignment":3,"specificity":2'), effort, F.lit("}"))
        confidence = F.when(broken == 1, "1.4").otherwise(F.concat(F.lit("0."), (10 + seed % 90).cast("string")))
        verdict = F.when(broken == 2, "maybe").otherwise(F.when(seed % 10 < 3, "reject").otherwise("accept"))
        reason = F.when(broken == 3, "   ").otherwise(" because ")
        payload = F.concat(F.lit('{"dimension_scores":'), scores, F.lit(',"verdict":"'), verdict, F.lit('","confidence":'), confidence, F.lit(',"reason":"'), reason, F.lit('"}'))
        return self._runs().select("item_id", "order_label", "mode", "rubric_version", "seed", payload.alias("payload"))

    def attempts(self) -> DataFrame:
        """Up to three payloads per run, in turn; later ones are whole more often."""
        p = self.payloads().select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt"))
        good = F.regexp_replace("payload", '"verdict":"maybe"', '"verdict":"accept"')
        return p.withColumn("payload", F.when(F.col("attempt") == 1 + F.col("seed") % 3, good).otherwise(F.col("payload"))).drop("seed")

    def reviews(self) -> DataFrame:
        keys = self.given("documents").select(F.col("doc_id").cast("string").alias("item_id"))
        runs = keys.select("item_id", F.explode(F.array(*map(F.lit, ORDERS))).alias("order_label")).withColumn(
            "seed", hash_bucket(F.concat_ws("|", F.lit("rev"), "item_id", "order_label"))
        )
        return runs.select(
            "item_id", "order_label", F.lit(RUBRIC_VERSION).alias("rubric_version"),
            F.when(F.col("seed") % 10 < 3, "overturn").otherwise("uphold").alias("decision"),
            ((50 + F.col("seed") % 50).cast("double") / F.lit(100.0)).alias("confidence"),
            F.concat(F.lit("checked "), (F.col("seed") % 5).cast("string")).alias("reason"), (F.col("seed") % 29 == 0).alias("escalated"),
        )


def with_both(judged: DataFrame, talks: DataFrame, column: str, name: str) -> DataFrame:
    """Rows of `judged` with `column` of both their conversations as `name`_a and `name`_b (and their ids); no row moves."""
    one, two = (F.broadcast(talks.select(F.col("conv_id").alias(f"conv_{x}"), F.col(column).alias(f"{name}_{x}"))) for x in "ab")
    return judged.join(one, "conv_a", "left").join(two, "conv_b", "left")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
