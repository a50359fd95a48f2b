"""Evidence of annotators who hold much of the table."""

import random

import pytest
from pyspark.sql import functions as F

from votelens.operators import evidence as V
from votelens.operators.preparation import order_views

from .plans import exchanges, nodes, planned_whole


def tables(spark, n=1500):
    rng = random.Random(3)
    who = ["busy" if i % 2 else f"few{rng.randrange(200)}" if i % 7 else None for i in range(n)]
    subs = [(f"{i:05d}", a, rng.choice("AB"), f"Response {rng.choice('AB')} says {i}") for i, a in enumerate(who)]
    items = [(f"{i:05d}", "q", "m0", "m1", f"a{i}", f"b{i}", "A") for i in range(n)]
    peers = [(f"{i:05d}", f"e{j}", rng.choice(["A", "B", "tie"])) for i in range(n) for j in range(i % 3)]
    return (
        spark.createDataFrame(items, "item_id string, question string, model_a string, model_b string, response_a string, response_b string, human_gold_vote string"),
        spark.createDataFrame(subs, "item_id string, annotator_id string, vote string, justification string"),
        spark.createDataFrame(peers, "item_id string, judge string, vote string"), subs, peers,
    )


FLIP = {"A": "B", "B": "A", "tie": "tie"}


def wanted(subs, peers):
    by = {}
    for row in sorted(subs, key=lambda s: s[0]):
        by.setdefault(row[1], []).append(row)
    voted = {}
    for i, j, v in sorted(peers):
        voted.setdefault(i, []).append((j, v))
    out = {}
    for item, who, _, _ in subs:
        others = [r for r in by[who] if r[0] != item][:10] if who else []
        plain = [(r[0], r[2], r[3]) for r in others]
        turned = [(i, FLIP[v], t.translate(str.maketrans("AB", "BA")) if "Response" in t else t) for i, v, t in plain]
        out[item, "original"] = plain, voted.get(item, [])
        out[item, "swapped"] = turned, [(j, FLIP[v]) for j, v in voted.get(item, [])]
    return out


@pytest.mark.parametrize(("most", "most_bytes"), [(1000, 1 << 26), (2, 1 << 26), (1000, 0), (1000, 30_000)])
def test_bundles(spark, most, most_bytes):
    items, submissions, peers, subs, votes = tables(spark)
    got = V.evidence_bundle(order_views(items, submissions), submissions, peers, most=most, most_bytes=most_bytes).collect()
    found = {(r["item_id"], r["order_label"]): ([tuple(h) for h in r["history"]], [tuple(p) for p in r["peers"]]) for r in got}
    assert len(got) == len(found) and found == wanted(subs, votes)


def test_no_view_moves_by_its_annotator(spark):
    items, submissions, peers, *_ = tables(spark)
    with planned_whole(spark):
        for most, budget in ((1000, 1 << 26), (2, 1 << 26), (1000, 0)):
            bundle = V.evidence_bundle(order_views(items, submissions), submissions, peers, most=most, most_bytes=budget)
            moved = [(by, columns) for by, columns in exchanges(bundle) if {"response_a", "question"} & set(columns)]
            assert moved and all("annotator_id" not in by.split("),")[0] for by, _ in moved)
            # items and submissions are each joined once, not once for each order
            assert sum("response_a" in columns for _, columns in moved) == 1
            assert not any("NestedLoop" in name or "Cartesian" in name for name, *_ in nodes(bundle))


def test_the_sketch_finds_who_is_heavy(spark):
    _, submissions, *_ = tables(spark)
    heavy, whole = V.heavy_annotators(submissions, 3)
    assert heavy[0] == "busy" and not whole
    assert V.heavy_annotators(submissions)[1]
    assert V.heavy_annotators(submissions.where(F.lit(False))) == ([], True)
