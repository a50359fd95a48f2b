"""Judgments from files: any split, any format, and records that can't be used."""

import json
import random

import pytest

from votelens.operators import preparation as P
from votelens.sources import judgments as J


def record(i, **more):
    rng = random.Random(i)
    talk = [{"role": "user", "content": f"q{i % 7}"}, {"role": "assistant", "content": "answer " * rng.randrange(1, 60)}]
    return {
        "question_id": i % 7, "model_a": "m0", "model_b": f"m{1 + i % 3}", "winner": rng.choice(["model_a", "model_b"]), "judge": f"e{i % 2}", "turn": 1,
        "conversation_a": talk, "conversation_b": [*talk[:1], {"role": "assistant", "content": f"b{i}"}], "extra": i, **more,
    }


@pytest.mark.parametrize("split", [1 << 11, 1 << 14, 1 << 27])
def test_the_last_record_wins_at_any_split(spark, tmp_path, split):
    records = [record(i) for i in range(600)]
    for k in range(3):  # files in the order of their names
        (tmp_path / f"part-{k}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records[200 * k : 200 * k + 200]))
    last = {(r["question_id"], r["model_b"], r["judge"]): r["conversation_b"][1]["content"] for r in records}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        found = J.read_judgments(spark, f"file://{tmp_path}")
        assert split > 1 << 12 or found.rdd.getNumPartitions() > 10
        items = P.dedupe_items(P.extract_items(J.good(found))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.question_id, r.model_b, r.judge): r.response_b for r in items} == last
    places = [(r.pos.file, r.pos.block, r.pos.row) for r in found.collect()]
    assert len(set(places)) == 600


def test_parquet_rows_have_their_numbers(spark, tmp_path):
    schema = J.JUDGMENT
    rows = [tuple(record(i)[c] for c in schema.names) for i in range(300)]
    spark.createDataFrame(rows, schema).coalesce(1).write.option("parquet.block.size", 4096).parquet(f"file://{tmp_path}/p")
    found = J.read_judgments(spark, f"file://{tmp_path}/p", "parquet")
    last = {(r[0], r[2], r[4]): r[7][1]["content"] for r in rows}
    assert {(r.question_id, r.model_b, r.judge): r.response_b for r in P.dedupe_items(P.extract_items(J.good(found))).collect()} == last
    assert sorted(r.pos.block for r in found.collect()) == list(range(300)) and J.quarantined(found).count() == 0


def test_what_cannot_be_used(spark, tmp_path):
    lines = [
        json.dumps(record(0)), json.dumps(record(1))[:-9], "not json", "", json.dumps(record(2, turn="one")), json.dumps(record(3, winner="model_c")), json.dumps(record(4, judge=None)),
        json.dumps({"question_id": 1}), json.dumps(record(5, winner="tie (inconsistent)")), json.dumps(record(6, conversation_a=None)), json.dumps(record(7, conversation_a="x")), "[1, 2]",
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    found = J.read_judgments(spark, f"file://{tmp_path}/a.jsonl").cache()
    kept = J.quarantined(found).collect()
    assert {r.problem: r.n for r in J.problems(found).collect()} == {"corrupt": 5, "winner": 1, "missing: judge": 1, "missing: model_a": 1}
    assert {r.record for r in kept} == {lines[i] for i in (1, 2, 4, 5, 6, 7, 10, 11)} and all(r.file.endswith("a.jsonl") for r in kept)
    assert J.good(found).count() == 3 and P.extract_items(J.good(found)).count() == 1  # a tie, and one without a conversation, give no item
    (tmp_path / "none").mkdir()
    assert J.read_judgments(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="json or parquet"):
        J.read_judgments(spark, "x", "csv")


@pytest.mark.parametrize("format", ["json", "parquet"])
def test_files_repeat_no_conversation(spark, tmp_path, format):
    """The query's own files: texts join as they are written, and equal ones follow one another, so files stay far smaller than the lines."""
    from votelens.queries import preparation as Q

    talk = "".join(random.Random(c).choice("abcdefghij ") for c in range(3000))
    (tmp_path / "sf").mkdir()
    spark.range(4000).selectExpr("id AS event_id", "id % 97 AS user_id", "IF(id % 3 = 0, 'click', 'purchase') AS event_type", "concat('{\"k\":', id % 7, '}') AS props").write.parquet(f"file://{tmp_path}/sf/events.parquet")
    spark.range(640).selectExpr("id % 160 AS conv_id", "cast(id div 160 AS int) AS turn", "IF(id div 160 = 1, 'assistant', 'user') AS role", f"concat(id, substring('{talk}', cast(id % 900 AS int), 2000)) AS text").write.parquet(f"file://{tmp_path}/sf/conversations.parquet")
    path = Q._judgment_files(spark, f"file://{tmp_path}/sf", format)
    files = spark.read.format("binaryFile").load(path)
    if format == "json":
        lines = spark.read.text(path).selectExpr("count(*) AS n", "sum(length(value)) AS size").first()
        assert lines["n"] == 4000 and files.selectExpr("sum(length)").first()[0] < lines["size"] / 20
    rows = J.good(J.read_judgments(spark, path, format)).selectExpr("pos", "xxhash64(conversation_a, conversation_b) AS h").collect()
    told = [r.h for r in sorted(rows, key=lambda r: tuple(r.pos))]
    assert len(rows) > 3800 and sum(a != b for a, b in zip(told, told[1:])) < 600
