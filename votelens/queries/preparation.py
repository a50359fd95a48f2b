"""Preparation: judgments, items, views, requests, and the keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votelens.functions import columns as C
from votelens.operators import checks
from votelens.operators import preparation as P
from votelens.params import EVIDENCE_TOOLS, MODES, RUBRIC_VERSION
from votelens.queries.sql import h, statement
from votelens.sources import judgments, manifest, tables
from votelens.sources.fixtures import Fixtures, with_both

ITEM = ["item_id", "question_id", "judge", "turn", "model_a", "model_b", "question", "response_a", "response_b", "human_gold_vote"]


def raw_judgments(spark: SparkSession, sf: str) -> DataFrame:
    r = Fixtures(spark, sf).raw_judgments()
    a, b = F.col("conversation_a"), F.col("conversation_b")
    return r.select(
        "pos", "question_id", "turn", "judge", "model_a", "model_b", "winner", F.coalesce(F.size(a), F.lit(0)).alias("n_a"),
        F.coalesce(F.size(b), F.lit(0)).alias("n_b"), F.try_element_at(a, F.lit(1))["content"].alias("a0"),
        F.try_element_at(a, F.lit(2))["content"].alias("a1"), F.try_element_at(b, F.lit(2))["content"].alias("b1"),
    )


def contract_audit(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    bad = f.grades().withColumn("verdict", F.when(F.col("confidence") > 0.93, F.lit("maybe")).otherwise(F.col("verdict")))
    twice = f.truth().select("item_id", "annotator_id", "vote").unionByName(f.truth().where("item_id like '%7'").select("item_id", "annotator_id", "vote"))
    return checks.audit({"grades": bad, "submissions": twice, "annotators": f.annotators(), "peer_votes": f.item_peers()})


def _breaking(f: Fixtures) -> dict[str, DataFrame]:
    """Tables in which every rule is broken, by the ids."""
    n = F.coalesce(F.length("item_id"), F.lit(0)) + F.col("item_id").cast("long")
    g = f.grades().join(f.runs().select("item_id", "order_label", "mode", "seed"), ["item_id", "order_label", "mode"])
    odd = F.col("seed") % 101

    def but(test: Column, value: str | None, name: str) -> Column:
        return F.when(test, F.lit(value)).otherwise(F.col(name)).alias(name)

    grades = g.select(
        but(odd == 6, None, "item_id"), but(odd == 0, "sideways", "order_label"), but(odd == 1, "expert", "mode"), "rubric_version", F.when(odd == 2, "maybe").when(odd == 5, None).otherwise(F.col("verdict")).alias("verdict"),
        F.when(odd == 3, 1.5).when(odd == 4, -0.25).otherwise(F.col("confidence")).alias("confidence"), F.when(odd == 5, None).otherwise(F.col("escalated")).alias("escalated"),
    )
    subs = f.truth().select(but(n % 13 == 2, None, "item_id"), "annotator_id", but(n % 13 == 1, "C", "vote"))
    items = f.items().select("item_id", but(n % 17 == 0, "tie", "human_gold_vote"))
    peers = f.item_peers().select("item_id", but(n % 11 == 3, None, "judge"), but(n % 11 == 1, "both", "vote"))
    return {"grades": grades, "submissions": subs, "items": items.unionByName(items.where("human_gold_vote = 'B'")), "peer_votes": peers}


def contract_breaches(spark: SparkSession, sf: str) -> DataFrame:
    return checks.audit(_breaking(Fixtures(spark, sf)))


def contract_offenders(spark: SparkSession, sf: str) -> DataFrame:
    """The keys behind the counts, of one table."""
    found = checks.broken_keys("grades", _breaking(Fixtures(spark, sf))["grades"])
    return found.select(*[F.get_json_object("key", f"$.{c}").alias(c) for c in ("item_id", "order_label", "mode")], "rule", "n")


def contract_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that break a rule of their own, apart from the good ones, and the counts that the same scan observed."""
    path = tables.scratch(spark, "checked")
    seen = checks.checked_write("grades", _breaking(Fixtures(spark, sf))["grades"], path)
    back = spark.read.parquet(path).withColumn("ok", F.col("ok").cast("boolean")).groupBy("ok").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("violations")).alias("n_breaches"))
    return back.withColumn("observed", F.lit(sum(v for k, v in seen.items() if k != "rows")).cast("long")).withColumn("scanned", F.lit(seen["rows"]).cast("long"))


def items_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return P.fetch_ordered(Fixtures(spark, sf).items().select("item_id", "question_id", "judge", "human_gold_vote"))


def _versions(f: Fixtures) -> tuple[DataFrame, DataFrame]:
    base = f.truth().select("item_id", "annotator_id", "vote", F.lit(1).alias("version"))
    changed = base.where("cast(item_id as long) % 3 = 0").select("item_id", "annotator_id", C.other_side(F.col("vote")).alias("vote"), F.lit(2).alias("version"))
    again = base.where("cast(item_id as long) % 6 = 0").withColumn("version", F.lit(3))
    return base, changed.unionByName(again)


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    base, changes = _versions(Fixtures(spark, sf))
    return P.upsert_latest(base, changes, ["item_id"]).select("item_id", "annotator_id", "vote", "version")


def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    base, changes = _versions(Fixtures(spark, sf))
    return P.insert_ignore(base.where("cast(item_id as long) % 2 = 0"), changes, ["item_id"], "version").select("item_id", "annotator_id", "vote", "version")


def extract_items(spark: SparkSession, sf: str) -> DataFrame:
    return P.extract_items(Fixtures(spark, sf).raw_judgments())


def stable_id(spark: SparkSession, sf: str) -> DataFrame:
    r = Fixtures(spark, sf).raw_judgments().select("pos", "question_id", "model_a", "model_b", "judge", "turn")
    return r.select("pos", C.stable_id(*(F.col(c) for c in ("question_id", "model_a", "model_b", "judge", "turn"))).alias("item_id"))


def winner_vote(spark: SparkSession, sf: str) -> DataFrame:
    r = Fixtures(spark, sf).raw_judgments().select("pos", "winner", C.winner_vote(F.col("winner")).alias("vote"))
    return r.select("pos", "winner", "vote", C.other_side(F.col("vote")).alias("flipped"))


def dedupe_items(spark: SparkSession, sf: str) -> DataFrame:
    return P.dedupe_items(extract_items(spark, sf))


def sample_items(spark: SparkSession, sf: str) -> DataFrame:
    return P.sample_items(dedupe_items(spark, sf), 150)


def swap_letters(spark: SparkSession, sf: str) -> DataFrame:
    return Fixtures(spark, sf).submissions().select("item_id", C.swap_letters(F.col("justification")).alias("swapped"))


def order_views(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    return P.order_views(f.items(), f.submissions())


def truncate_text(spark: SparkSession, sf: str) -> DataFrame:
    return Fixtures(spark, sf).given("documents").select("doc_id", C.truncate_text(F.col("text")).alias("short"), C.clip_text(F.col("text")).alias("clipped"))


def norm_text(spark: SparkSession, sf: str) -> DataFrame:
    return Fixtures(spark, sf).submissions().select("item_id", C.norm_text(F.col("justification")).alias("normed"))


def text_features(spark: SparkSession, sf: str) -> DataFrame:
    j = F.col("justification")
    return Fixtures(spark, sf).submissions().select(
        "item_id", C.word_count(j).alias("n_words"), F.regexp_count(j, F.lit("Response A")).alias("n_a"), F.regexp_count(j, F.lit("Response B")).alias("n_b"),
        (C.word_count(j) < 10).alias("short"),
    )


def grade_requests(spark: SparkSession, sf: str) -> DataFrame:
    views = order_views(spark, sf).withColumn("tools", F.explode(F.array(F.lit(True), F.lit(False))))
    return views.select("item_id", "order_label", "tools", P.grade_request(F.col("tools")).alias("request"))


def annotator_requests(spark: SparkSession, sf: str) -> DataFrame:
    return order_views(spark, sf).where("order_label = 'original'").select("item_id", "annotator_id", P.annotator_request().alias("request"))


def call_cost(spark: SparkSession, sf: str) -> DataFrame:
    calls = checks.with_cost(Fixtures(spark, sf).call_log())
    return calls.select("item_id", "order_label", "mode", "attempts", "model", "cost_micro_usd")


def rehearsal_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Costs by model and by whether calls were a rehearsal's, which cost nothing."""
    calls = checks.with_cost(Fixtures(spark, sf).call_log().withColumn("mock", F.col("attempts") % 3 == 0))
    return calls.groupBy("mock", "model").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("cost_micro_usd").alias("micro_usd"))


def hash_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return Fixtures(spark, sf).truth().select("item_id", C.hash_bucket(F.col("item_id")).alias("bucket"))


def evidence_scope(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    t = f.tool_events().join(f.truth().select("item_id", "annotator_id"), "item_id")
    wrong = F.col("seed") % 5 == 0
    asked = t.select(
        "item_id", "annotator_id", "order_label", "mode", "i", "name",
        F.when(wrong, "src_x").otherwise(F.col("annotator_id")).alias("arg_annotator"), F.when(wrong, "0x").otherwise(F.col("item_id")).alias("arg_item"),
        F.when(wrong, "c").otherwise("a").alias("arg_which"), F.when(F.col("seed") % 3 > 0, (F.col("seed") % 40).cast("int")).alias("arg_limit"),
    )
    return P.evidence_scope(asked).select("item_id", "order_label", "mode", "i", "name", "error", "row_limit")


def peer_votes(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    raw = f.raw_judgments()
    return P.peer_votes(raw.select("pos", "turn", "winner", "question_id", "model_a", "model_b", "judge"), P.dedupe_items(P.extract_items(raw)))


#: About so many judgments are in a file, however many there are.
FILE_ROWS = 20_000


def _judgment_files(spark: SparkSession, sf: str, format: str) -> str:
    """Files of raw judgments by question and pair of answers, of these in the order of their events, some of them broken in
    one of four ways.

    Only ids are shuffled, and the texts join them as they are written (Spark drops a sort below a join, so a file's rows are
    sorted after it).  Equal conversations follow one another, and the files' compression takes them once.
    """
    f = Fixtures(spark, sf)
    files = max(5, -(-f.given("events").count() // FILE_ROWS))
    order = ["question_id", "conv_a", "conv_b", "pos"]
    judged = f.judged().repartitionByRange(files, *order)
    bad = F.col("pos") % 97
    judged = judged.withColumn("judge", F.when(bad != 2, F.col("judge"))).withColumn("winner", F.when(bad == 3, "both").otherwise(F.col("winner")))
    path = tables.scratch(spark, "judgments")
    if format == "parquet":
        with_both(judged, f.judged_messages(), "messages", "conversation").sortWithinPartitions(*order).select(*judgments.JUDGMENT.names).write.parquet(path)
        return path
    plain = [c for c in judgments.JUDGMENT.names if not c.startswith("conversation")]
    talks = f.judged_messages().select("conv_id", F.to_json("messages").alias("said"))  # written out once, not once a judgment
    said = [F.coalesce(F.concat(F.lit(f',"conversation_{x}":'), F.col(f"said_{x}")), F.lit("")) for x in "ab"]
    whole = F.concat(F.regexp_replace(F.to_json(F.struct(*plain)), r"\}$", ""), *said, F.lit("}"))
    cut = F.substring(whole, F.lit(1), F.length(whole) - 7)
    typed = F.regexp_replace(whole, r'"question_id":\d+', '"question_id":"forty"')
    lines = with_both(judged, talks, "said", "said").sortWithinPartitions(*order).select(F.when(F.col("pos") % 97 == 0, cut).when(F.col("pos") % 97 == 1, typed).otherwise(whole))
    lines.write.text(path, compression="gzip")
    return path


def judgment_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items from JSON files, of each id the one that comes last in the files."""
    found = judgments.read_judgments(spark, _judgment_files(spark, sf, "json"))
    return P.dedupe_items(P.extract_items(judgments.good(found))).drop("pos")


def judgment_items_parquet(spark: SparkSession, sf: str) -> DataFrame:
    found = judgments.read_judgments(spark, _judgment_files(spark, sf, "parquet"), "parquet")
    return P.dedupe_items(P.extract_items(judgments.good(found))).drop("pos")


def judgment_problems(spark: SparkSession, sf: str) -> DataFrame:
    return judgments.problems(judgments.read_judgments(spark, _judgment_files(spark, sf, "json")))


def load_if_empty(spark: SparkSession, sf: str) -> DataFrame:
    f = Fixtures(spark, sf)
    rows = f.annotators()
    path = tables.scratch(spark, "annotators")
    tables.load_if_empty(rows, path)
    tables.load_if_empty(rows.limit(1), path)  # a second load changes nothing
    return spark.read.parquet(path)


def rewrite_slice(spark: SparkSession, sf: str) -> DataFrame:
    """All modes' grades; then one mode's slice is replaced, and another's emptied."""
    rows = Fixtures(spark, sf).grades().select("item_id", "order_label", "verdict", "confidence", "mode")
    path = tables.scratch(spark, "routed")
    tables.rewrite_slices(rows, path, "mode", list(MODES))
    tables.rewrite_slices(rows.where("mode = 'agent' and verdict = 'accept'"), path, "mode", ["agent"])
    tables.rewrite_slices(rows.limit(0), path, "mode", ["single"])
    return manifest.read_slices(spark, path, rows.schema, "mode")


def call_log_append(spark: SparkSession, sf: str) -> DataFrame:
    """The calls of each mode as a batch, each of which is written twice."""
    calls = checks.with_cost(Fixtures(spark, sf).call_log())
    path = tables.scratch(spark, "call_log")
    for mode in (*MODES, *MODES):
        tables.append_calls(calls.where(F.col("mode") == mode), path, mode)
    back = manifest.read_batches(spark, path, calls.withColumn("call_id", F.lit("")).schema)
    return back.groupBy("mode").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("call_id").alias("n_ids"), F.sum("cost_micro_usd").alias("micro_usd"))


def upsert_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A large table as one run, and small changes as further runs: what is current of both."""
    base, changes = _versions(Fixtures(spark, sf))
    path = tables.scratch(spark, "runs")
    for rows in (base, changes.where("version = 2"), changes.where("version = 3")):
        manifest.add_run(rows, path, lambda df: P.last_by(df, ["item_id"], "version").select(*df.columns), {})
    return P.last_by(manifest.read_runs(spark, path, base.schema), ["item_id"], "version")


def run_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """One mode's calls as a rehearsal, the others' as a real run, each read back alone."""
    calls = Fixtures(spark, sf).call_log()
    path = tables.scratch(spark, "runs")
    tables.write_run(calls.where("mode = 'single'"), path, mock=True)
    tables.write_run(calls.where("mode <> 'single'"), path, mock=False)
    parts = [tables.read_run(spark, path, mock=mock).withColumn("rehearsal", F.lit(mock)) for mock in (True, False)]
    return parts[0].unionByName(parts[1]).groupBy("rehearsal", "mode").agg(F.count(F.lit(1)).alias("n_calls"))


QUERIES = {q.__name__: q for q in (
    raw_judgments, contract_audit, contract_breaches, contract_offenders, contract_quarantine, items_ordered, upsert_latest, insert_ignore, extract_items, stable_id, winner_vote, dedupe_items, sample_items,
    swap_letters, order_views, truncate_text, norm_text, text_features, grade_requests, annotator_requests, call_cost, rehearsal_cost, hash_bucket, evidence_scope, peer_votes,
    judgment_items, judgment_items_parquet, judgment_problems, load_if_empty, rewrite_slice, call_log_append, upsert_runs, run_scoped,
)}

_SWAP = "replace(replace(replace(justification, 'Response A', chr(1) || 'RESP'), 'Response B', 'Response A'), chr(1) || 'RESP', 'Response B')"
_VIEWS = f"""(SELECT item_id, annotator_id, question, 'original' AS order_label, model_a, model_b, response_a, response_b, human_gold_vote, vote, justification FROM item JOIN sub USING (item_id)
    UNION ALL SELECT item_id, annotator_id, question, 'swapped', model_b, model_a, response_b, response_a, CASE human_gold_vote WHEN 'A' THEN 'B' ELSE 'A' END, CASE vote WHEN 'A' THEN 'B' ELSE 'A' END, {_SWAP}
    FROM item JOIN sub USING (item_id))"""


def _cut(c: str, n: int = 200) -> str:
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE substring({c}, 1, {n}) || '… [TRUNCATED — ' || length({c}) || ' chars total]' END"


def _request() -> str:
    rubric = P.rubric_text().replace("'", "''")
    tools = f"You may call {', '.join(EVIDENCE_TOOLS)}, 6 times in all, then emit a verdict or flag for review."
    return f"""'Grade the quality of this annotation, not the responses.\n\n## Question\n' || question || '\n\n## Response A\n' || {_cut('response_a')} || '\n\n## Response B\n' || {_cut('response_b')}
        || '\n\n## Submission\nAnnotator: ' || annotator_id || '\nItem: ' || item_id || '\nVote: Response ' || vote || '\nJustification: ' || justification
        || '\n\n## Rubric ({RUBRIC_VERSION})\n{rubric}\n\n' || CASE WHEN tools THEN '{tools}' ELSE 'Emit a verdict on this context alone.' END"""


_BAD_GRADES = """badgrade AS (SELECT CASE WHEN odd <> 6 THEN item_id END AS item_id, CASE odd WHEN 0 THEN 'sideways' ELSE order_label END AS order_label, CASE odd WHEN 1 THEN 'expert' ELSE mode END AS mode,
    rubric_version, CASE odd WHEN 2 THEN 'maybe' WHEN 5 THEN NULL ELSE verdict END AS verdict, CASE odd WHEN 3 THEN 1.5 WHEN 4 THEN -0.25 ELSE confidence END AS confidence, CASE WHEN odd <> 5 THEN escalated END AS escalated
    FROM (SELECT g.*, seed % 101 AS odd FROM grade g JOIN run0 r ON r.item_id = g.item_id AND r.order_label = g.order_label AND r.mode = g.mode))"""
_GRADE_RULES = {
    "allowed: order_label": "order_label = 'sideways'", "allowed: mode": "mode = 'expert'", "allowed: verdict": "verdict = 'maybe'", "not null: item_id": "item_id IS NULL",
    "range: confidence": "confidence NOT BETWEEN 0 AND 1", "verdict unless escalated": "verdict IS NULL AND NOT coalesce(escalated, false)",
}
_BREACHES = " UNION ALL ".join(f"SELECT *, '{rule}' AS rule FROM badgrade WHERE {test}" for rule, test in _GRADE_RULES.items())


def _counted(table: str, rule: str, body: str) -> str:
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) AS n FROM {body} HAVING count(*) > 0"


_NUMBER = "(length(item_id) + cast(item_id as bigint))"
_AUDITED = " UNION ALL ".join([
    *[_counted("grades", rule, f"badgrade WHERE {test}") for rule, test in _GRADE_RULES.items()],
    _counted("grades", "unique key", "(SELECT 1 FROM badgrade GROUP BY item_id, order_label, mode, rubric_version HAVING count(*) > 1)"),
    _counted("submissions", "allowed: vote", f"sub WHERE {_NUMBER} % 13 = 1"), _counted("submissions", "not null: item_id", f"sub WHERE {_NUMBER} % 13 = 2"),
    _counted("submissions", "unique key", f"(SELECT 1 FROM sub WHERE {_NUMBER} % 13 = 2 HAVING count(*) > 1)"), _counted("items", "unique key", f"item WHERE human_gold_vote = 'B' AND {_NUMBER} % 17 <> 0"),
    _counted("items", "allowed: human_gold_vote", f"item WHERE {_NUMBER} % 17 = 0"), _counted("peer_votes", "allowed: vote", f"peer WHERE {_NUMBER} % 11 = 1"),
    _counted("peer_votes", "not null: judge", f"peer WHERE {_NUMBER} % 11 = 3"), _counted("peer_votes", "unique key", f"(SELECT item_id FROM peer WHERE {_NUMBER} % 11 = 3 GROUP BY item_id HAVING count(*) > 1)"),
])
_FROM_FILES = """SELECT * EXCLUDE (pos, rn) FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos DESC) AS rn FROM extracted WHERE pos % 97 NOT IN {skip}) WHERE rn = 1"""
_BASE = "base AS (SELECT item_id, annotator_id, vote, 1 AS version FROM sub)"
_CHANGES = "changes AS (SELECT item_id, annotator_id, CASE vote WHEN 'A' THEN 'B' ELSE 'A' END AS vote, 2 AS version FROM base WHERE cast(item_id as bigint) % 3 = 0 UNION ALL SELECT item_id, annotator_id, vote, 3 FROM base WHERE cast(item_id as bigint) % 6 = 0)"


def _with(extra: str, body: str) -> str:
    """A statement with further tables."""
    head = statement(extra + " " + body)[: -len(extra + " " + body)].rstrip("\n")
    return head + (",\n" if head else "WITH ") + extra + "\n" + body


ORACLES = {name: statement(sql) for name, sql in {
    "raw_judgments": "SELECT pos, question_id, turn, judge, model_a, model_b, winner, n_a, n_b, a0, a1, b1 FROM raw",
    "items_ordered": "SELECT item_id, question_id, judge, human_gold_vote FROM item",
    "extract_items": "SELECT * FROM extracted",
    "stable_id": "SELECT pos, substring(sha1(question_id || '|' || model_a || '|' || model_b || '|' || judge || '|' || turn), 1, 12) AS item_id FROM raw",
    "winner_vote": "SELECT pos, winner, CASE winner WHEN 'model_a' THEN 'A' WHEN 'model_b' THEN 'B' WHEN 'tie' THEN 'tie' END AS vote, CASE winner WHEN 'model_a' THEN 'B' WHEN 'model_b' THEN 'A' WHEN 'tie' THEN 'tie' END AS flipped FROM raw",
    "dedupe_items": "SELECT * FROM jitems",
    "sample_items": "SELECT * FROM jitems ORDER BY sha1('42|sample|' || item_id), item_id LIMIT 150",
    "swap_letters": f"SELECT item_id, {_SWAP} AS swapped FROM sub",
    "order_views": f"SELECT * FROM {_VIEWS}",
    "truncate_text": f"SELECT doc_id, {_cut('text')} AS short, CASE WHEN length(text) <= 400 THEN text ELSE substring(text, 1, 400) || '…' END AS clipped FROM documents",
    "norm_text": r"SELECT item_id, trim(regexp_replace(lower(justification), '\s+', ' ', 'g')) AS normed FROM sub",
    "text_features": "SELECT item_id, n_words, n_a, n_b, n_words < 10 AS short FROM feat",
    "grade_requests": f"SELECT item_id, order_label, tools, {_request()} AS request FROM {_VIEWS} CROSS JOIN (VALUES (true), (false)) x(tools)",
    "annotator_requests": f"""SELECT item_id, annotator_id, 'You compared two responses and hold that Response ' || vote || ' is better.\n\n## Question\n' || question || '\n\n## Response A\n' || response_a || '\n\n## Response B\n' || response_b
        || '\n\nSay why in two to four sentences. Name both as Response A and Response B.' AS request FROM {_VIEWS} WHERE order_label = 'original'""",
    "call_cost": "SELECT item_id, order_label, mode, i + 1 AS attempts, CASE WHEN (tokens_in + i) % 50 = 0 THEN 'unlisted' ELSE 'grader-large' END AS model, micro AS cost_micro_usd FROM calls",
    "rehearsal_cost": """SELECT (i + 1) % 3 = 0 AS mock, CASE WHEN (tokens_in + i) % 50 = 0 THEN 'unlisted' ELSE 'grader-large' END AS model, count(*) AS n_calls,
        cast(sum(CASE WHEN (i + 1) % 3 = 0 THEN 0 ELSE micro END) as bigint) AS micro_usd FROM calls GROUP BY 1, 2""",
    "hash_bucket": f"SELECT item_id, {h('item_id')} AS bucket FROM sub",
    "evidence_scope": """SELECT t.item_id, order_label, mode, i, name, CASE WHEN seed % 5 = 0 THEN CASE name WHEN 'get_annotator_history' THEN 'only annotator ' || annotator_id || ' is in scope for this item'
        WHEN 'get_peer_judgments' THEN 'only item ' || t.item_id || ' is in scope' ELSE 'which must be ''a'' or ''b''' END END AS error,
        CASE WHEN name = 'get_annotator_history' THEN least(CASE WHEN seed % 3 > 0 THEN seed % 40 ELSE 10 END, 20) END AS row_limit FROM tool t JOIN sub USING (item_id)""",
    "load_if_empty": "SELECT * FROM ann",
    "rewrite_slice": "SELECT item_id, order_label, verdict, confidence, mode FROM grade WHERE mode = 'verifier' OR (mode = 'agent' AND verdict = 'accept')",
    "call_log_append": "SELECT mode, count(*) AS n_calls, count(*) AS n_ids, cast(sum(micro) as bigint) AS micro_usd FROM calls GROUP BY mode",
    "run_scoped": "SELECT mode = 'single' AS rehearsal, mode, count(*) AS n_calls FROM calls GROUP BY mode",
}.items()} | {
    "upsert_latest": _with(f"{_BASE}, {_CHANGES}", "SELECT item_id, annotator_id, vote, version FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY version DESC) AS rn FROM (SELECT * FROM base UNION ALL SELECT * FROM changes)) WHERE rn = 1"),
    "upsert_runs": _with(f"{_BASE}, {_CHANGES}", "SELECT item_id, annotator_id, vote, version FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY version DESC) AS rn FROM (SELECT * FROM base UNION ALL SELECT * FROM changes)) WHERE rn = 1"),
    "insert_ignore": _with(f"{_BASE}, {_CHANGES}", """SELECT * FROM base WHERE cast(item_id as bigint) % 2 = 0 UNION ALL SELECT item_id, annotator_id, vote, version FROM
        (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY version) AS rn FROM changes) WHERE rn = 1 AND cast(item_id as bigint) % 2 <> 0"""),
    "peer_votes": _with("""votes AS (SELECT pos, question_id, model_a, model_b, judge, CASE winner WHEN 'model_a' THEN 'A' WHEN 'model_b' THEN 'B' ELSE 'tie' END AS vote FROM raw WHERE turn = 1),
        direct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, model_a, model_b, judge ORDER BY pos DESC) AS rn FROM votes) WHERE rn = 1),
        turned AS (SELECT question_id, model_b AS model_a, model_a AS model_b, judge, CASE vote WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE vote END AS vote FROM
            (SELECT *, row_number() OVER (PARTITION BY question_id, model_a, model_b, judge ORDER BY pos) AS rn FROM votes) WHERE rn = 1),
        known AS (SELECT question_id, model_a, model_b, judge, vote FROM direct UNION ALL SELECT * FROM turned t WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.question_id = t.question_id
            AND d.model_a = t.model_a AND d.model_b = t.model_b AND d.judge = t.judge))""",
        "SELECT i.item_id, k.judge, k.vote FROM jitems i JOIN known k ON k.question_id = i.question_id AND k.model_a = i.model_a AND k.model_b = i.model_b WHERE k.judge <> i.judge"),
    "judgment_items": statement(_FROM_FILES.format(skip="(0, 1, 2, 3)")),
    "judgment_items_parquet": statement(_FROM_FILES.format(skip="(2, 3)")),
    "judgment_problems": statement("SELECT CASE pos % 97 WHEN 0 THEN 'corrupt' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'missing: judge' ELSE 'winner' END AS problem, count(*) AS n FROM raw WHERE pos % 97 < 4 GROUP BY 1"),
    "contract_breaches": _with(_BAD_GRADES, _AUDITED),
    "contract_offenders": _with(_BAD_GRADES, f"""SELECT item_id, order_label, mode, rule, count(*) AS n FROM ({_BREACHES}) GROUP BY ALL
        UNION ALL SELECT item_id, order_label, mode, 'unique key', count(*) FROM badgrade GROUP BY ALL HAVING count(*) > 1"""),
    "contract_quarantine": _with(_BAD_GRADES, f"""SELECT n_breaches = 0 AS ok, count(*) AS n_rows, cast(sum(n_breaches) as bigint) AS n_breaches, cast(sum(sum(n_breaches)) OVER () as bigint) AS observed, cast(sum(count(*)) OVER () as bigint) AS scanned
        FROM (SELECT {" + ".join(f"CASE WHEN {test} THEN 1 ELSE 0 END" for test in _GRADE_RULES.values())} AS n_breaches FROM badgrade) GROUP BY 1"""),
    "contract_audit": _with("""bad AS (SELECT * REPLACE (CASE WHEN confidence > 0.93 THEN 'maybe' ELSE verdict END AS verdict) FROM grade),
        twice AS (SELECT item_id FROM sub UNION ALL SELECT item_id FROM sub WHERE item_id LIKE '%7')""",
        """SELECT 'grades' AS table_name, 'allowed: verdict' AS rule, count(*) AS n FROM bad WHERE verdict NOT IN ('accept', 'reject') HAVING count(*) > 0
        UNION ALL SELECT 'submissions', 'unique key', count(*) FROM (SELECT item_id FROM twice GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0"""),
}
