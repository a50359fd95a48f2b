"""Bradley-Terry ranking against gradient descent, and held-out accuracy on the given tables."""

import math
import re
import zlib

import numpy as np
import pytest

from votelens.llm import quality
from votelens.llm.queries import QUERIES

from ..oracle import DATA
from .corpus import SCHEMA, documents
from .test_queries import rows_of

LARGE = DATA.parent / "sf0.1"


def numbers(text):
    t = text or ""
    words = [w for w in re.split(r"[ \t-\r]+", t) if w]
    lines = [x for x in re.split(r"[\n\r]+", t) if x]
    n, m, k = len(t), len(words), len(lines)
    letters = sum(c.isalpha() for c in t)
    space = " \t\n\x0b\x0c\r"
    mark = [not (c.isalpha() or c.isnumeric() or c in space) for c in t]
    pairs = list(zip(words, words[1:]))

    def share(a, b):
        return a / (b + 1)

    ends = sum(c in ".!?" and (i + 1 == n or t[i + 1] in space) for i, c in enumerate(t))
    bare = sum(not any(c.isalpha() for c in w) for w in words)
    runs = [len(x) for x in re.findall("1+", "".join("01"[b] for b in mark))]
    doubles = [len(x[0]) for x in re.finditer(r"(.)\1*", t, re.S) if mark[x.start()]]
    return [
        math.log1p(m), share(sum(mark), n), share(sum(c.isupper() for c in t), letters), share(sum(c in "0123456789" for c in t), n), share(m - len(set(words)), m),
        share(k - len(set(lines)), k), share(len(pairs) - len(set(pairs)), m), share(sum(a == b for a, b in pairs), m), share(letters, m), share(ends, m), share(bare, m),
        share(sum(x // 2 for x in runs), m), share(k, m), share(sum(x // 2 for x in doubles), m),
    ]


def test_features(spark):
    texts = [r[1] for r in documents()] + ["!!! ?? a!! b..", "WORD WORD word\nWORD WORD word\n\nx", "1 22 a3 | | --", "a  b\x0bc", "...", "é É ß 中文 ²"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.withColumn("x", quality.text_features(df["text"])).collect():
        assert r["x"] == pytest.approx(numbers(r["text"]), abs=1e-12), r["text"] and r["text"][:80]


def descended(good, bad):
    """The same loss, by gradient descent with momentum."""
    spread = np.concatenate([good, bad]).std(axis=0)
    scale = np.where(spread > 1e-9, spread, np.inf)
    one, other = quality.preference_pairs(len(good), len(bad))
    gaps = (good[one] - bad[other]) / scale
    w, v = np.zeros(gaps.shape[1]), np.zeros(gaps.shape[1])
    rate = 1 / (0.25 * np.linalg.eigvalsh(gaps.T @ gaps).max() + 1)
    for _ in range(20000):
        v = 0.99 * v - rate * (w - gaps.T @ (1 / (1 + np.exp(gaps @ w))))
        w = w + v
    return w / scale


def test_pairs_and_threshold():
    for a, b in ((7, 3), (3, 7), (1, 9), (5, 5)):
        one, other = quality.preference_pairs(a, b)
        assert set(one) == set(range(a)) and set(other) == set(range(b)) and len(one) == quality.PAIRS * max(a, b)
    s, g = np.array([1.0, 2, 3, 4, 5, 6]), np.array([False, False, True, False, True, True])
    assert quality.quantile_threshold(s, g, np.ones(6)) == (2.5, 2 / 6) or quality.quantile_threshold(s, g, np.ones(6)) == (4.5, 4 / 6)
    assert quality.quantile_threshold(s, g, np.where(g, 10.0, 1.0))[0] == 2.5
    assert quality.quantile_threshold(np.zeros(4), np.array([True, False, True, True]), np.ones(4)) == (-1.0, 0.0)
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.5, 1, (60, 4)), rng.normal(-0.5, 1, (20, 4))
    assert quality.bradley_terry(good, bad) == pytest.approx(descended(good, bad), abs=1e-6)


def test_awkward_rows(spark):
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(0, 60)] + [(3, 1, "y"), (None, 1, "z"), (5, None, "z"), (6, 7, "z")], "doc_id long, quality int, text string")
    got = quality.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    one_sided = quality.scored(docs, labels.where("quality = 1")).collect()
    assert {r["score"] >= quality.KEEP_SCORE for r in one_sided} == {True}
    assert {r["score"] < quality.KEEP_SCORE for r in quality.scored(docs, labels.where("quality = 0")).collect()} == {True}
    assert quality.scored(docs.limit(0), labels).collect() == []
    model = quality.fit(quality.with_features(docs), labels)
    kept = quality.drop_low_quality(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.keep_best(docs, model, 0.25).count() == pytest.approx(docs.count() / 4, abs=3) and quality.keep_best(docs, model, 1.0).count() == docs.count()


@pytest.mark.parametrize(("n", "bad", "few"), [(10_500, 1 / 7, 4096), (10_500, 1 / 7, 10), (3000, 2 / 3, 10)])
def test_every_text_is_learnt_from(spark, monkeypatch, n, bad, few):
    """The table's weights and threshold are those of all its texts in memory, of which one label has more than 6,000."""
    monkeypatch.setattr(quality, "FEW", few)
    monkeypatch.setattr(quality, "BUCKET", 50)
    rng = np.random.default_rng(5)
    is_good = rng.random(n) > bad
    x = rng.normal(0, 1, (n, len(quality.FEATURES))).round(2) + is_good[:, None] * rng.normal(0, 0.4, len(quality.FEATURES))
    x[:, 2] = 0.5
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<double>").selectExpr("doc_id", "xxhash64(doc_id) as h", "x").repartition(5)
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(is_good)], "doc_id long, quality int")
    order = [r["doc_id"] for r in rows.where(~quality.held_out(rows["doc_id"])).orderBy("h").select("doc_id").collect()]
    good, less = ([i for i in order if is_good[i] == g] for g in (True, False))
    assert max(len(good), len(less)) > 6000 or n < 10_000
    model = quality.fit(rows, labels)
    weights = quality.bradley_terry(x[good], x[less])
    assert model.weights == pytest.approx(weights, abs=1e-8)
    scores = np.concatenate([x[good], x[less]]) @ weights
    assert (model.threshold, model.level) == pytest.approx(quality.quantile_threshold(scores, np.arange(len(scores)) < len(good), np.ones(len(scores))), abs=1e-7)


def test_the_threshold_of_a_table(spark):
    rng = np.random.default_rng(2)
    for case in range(6):
        n = int(rng.integers(2, 200))
        s, g = rng.integers(0, 12, n).astype(float), rng.random(n) < (0.0, 1.0, 0.5, 0.9, 0.5, 0.1)[case]
        s, g = np.append(s, [3.0, 4.0]), np.append(g, [True, False])
        one, other = float(rng.integers(1, 4)), float(rng.integers(1, 4))
        df = spark.createDataFrame(list(zip(s.tolist(), g.tolist())), "s double, good boolean").repartition(3)
        assert quality.threshold_of(df, one, other) == pytest.approx(quality.quantile_threshold(s, g, np.where(g, one, other)))


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_query(spark):
    """Every score, with features and weights computed anew."""
    docs, labels = rows_of("documents"), {r["doc_id"]: r["quality"] for r in rows_of("labels")}
    got = {r["doc_id"]: r for r in QUERIES["op11_quality"](spark, str(DATA)).collect()}
    x = {r["doc_id"]: numbers(r["text"]) for r in docs}
    learnt = [r for r in docs if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    import xxhash  # Spark's hash of a string: XXH64 with seed 42, signed

    def h(text):
        value = xxhash.xxh64_intdigest((text or "").encode(), 42)
        return value - (value >> 63 << 64)

    sides = []
    for value in (1, 0):
        mine = {h(r["text"]): x[r["doc_id"]] for r in learnt if labels[r["doc_id"]] == value}
        sides.append(np.array([mine[k] for k in sorted(mine)]))
    w = descended(*sides)
    scores, good = np.concatenate(sides) @ w, np.arange(len(sides[0]) + len(sides[1])) < len(sides[0])
    n = [sum(labels[r["doc_id"]] == v for r in learnt) for v in (1, 0)]
    threshold, _ = quality.quantile_threshold(scores, good, np.where(good, n[0] / len(sides[0]), n[1] / len(sides[1])))
    for i, r in got.items():
        want = 1 / (1 + math.exp(-(np.array(x[i]) @ w - threshold)) * 0.3 / 0.7)
        assert r["score"] == pytest.approx(want, abs=1e-4) and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert sorted(got) == sorted(x)


@pytest.mark.skipif(not LARGE.exists(), reason="the given tables are not here")
def test_held_out_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in rows_of("labels", LARGE)}
    lang = {r["doc_id"]: r["lang"] for r in rows_of("documents", LARGE)}
    got = [r for r in QUERIES["op11_quality"](spark, str(LARGE)).collect() if r["held_out"] and r["doc_id"] in labels]
    for language in sorted(set(lang.values())):
        mine = [r for r in got if lang[r["doc_id"]] == language]
        good, bad = ([r["predicted"] for r in mine if labels[r["doc_id"]] == v] for v in (1, 0))
        assert sum(good) >= 0.97 * len(good) and len(bad) - sum(bad) >= 0.9 * len(bad), language
