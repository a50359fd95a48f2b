"""The pipeline against brute force, and planted cases."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from votelens.llm import toxicity

from .corpus import sentence
from .test_operators import brute_contamination, brute_fingerprint, toxic_corpus, union


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, text) for i, text, _ in toxic_corpus(400, seed=4)]
    labels = [(i, toxic) for i, _, toxic in toxic_corpus(400, seed=4)]
    clean = [i for i, toxic in labels if not toxic]
    passage = sentence(rng, 40)
    long = sentence(rng, 3000)
    edited = next(t for i, t in rows if i in clean and len(t.split()) > 80).split()
    edited[20] = edited[60] = "changed"
    edited = " ".join(edited)
    rows += [(1000, rows[clean[0]][1].replace(" ", "  ")), (1001, rows[clean[1]][1]), (1002, sentence(rng, 50) + " " + passage.upper() + " " + sentence(rng, 9)), (1003, long), (1004, long + " end"), (1007, edited), (1005, None), (1006, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _score string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, passage), (2, "short item")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    packed = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    got = {r["doc_id"] for r in packed}

    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    left = [(i, t) for i, t in rows if model.score(t) < 0.5]
    first: dict[str, int] = {}
    for i, t in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    left = [(i, t) for i, t in left if i in set(first.values())]
    fps = {i: brute_fingerprint(t) for i, t in left}
    distinct = sorted(set(fps.values()))
    sets = {f: shingles(dict(left)[i]) for i, f in sorted(fps.items(), reverse=True)}
    label = union([(a, b) for n, a in enumerate(distinct) for b in distinct[n + 1 :] if (a ^ b).bit_count() <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], distinct)
    groups = defaultdict(list)
    for i, f in fps.items():
        groups[label[f]].append(i)
    stays = {min(g) for g in groups.values()}
    left = [(i, t) for i, t in left if i in stays]
    bad = {x[0] for x in brute_contamination(left, items) if x[3]}
    assert got == {i for i, _ in left} - bad
    assert not got & {1000, 1001, 1002, 1004, 1007} and 1003 in got
    assert sum(r["length"] for r in packed) >= len(got)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "packing"]


def test_stages_keep_the_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, f"file://{tmp_path}")
        assert out.columns == df.columns and out.count() == 3
        assert stage(spark, df.limit(0), f"file://{tmp_path}").count() == 0
