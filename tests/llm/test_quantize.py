"""Product codes against plain Lloyd iterations, written anew."""

import hashlib
import random

import numpy as np
import pytest

from votelens.llm import quantize


def floor_all(vector):
    return [int(np.floor(256 * float(x))) for x in vector]


def brute(rows, parts, entries, rounds):
    """{(row's place): (codes, distances)} and the codebooks."""
    ints = [floor_all(v) for _, v in rows]
    width = len(ints[0]) // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, ints[i]))[:entries]
    books = [[tuple(ints[i][p * width : (p + 1) * width]) for i in order] for p in range(parts)]

    def code(v):
        out = []
        for p in range(parts):
            x = v[p * width : (p + 1) * width]
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])))
        return out

    for _ in range(rounds):
        codes = [code(v) for v in ints]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p * width : (p + 1) * width] for v, c in zip(ints, codes, strict=True) if c[p][1] == k]
                if mine:
                    books[p][k] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    return [code(v) for v in ints], books


@pytest.mark.parametrize(("n", "parts", "entries", "rounds"), [(400, 4, 8, 5), (30, 2, 64, 2), (200, 8, 16, 0), (1, 4, 64, 2)])
def test_codes(spark, n, parts, entries, rounds):
    rng = random.Random(n)
    good = [(i if rng.random() < 0.95 else None, [rng.choice([-0.5, -0.01, 0.0, 0.004, 0.25, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(n)]
    good += good[:20]
    rows = [(i, v, i % 3 if i and i % 3 else None, "x", 0) for i, v in good]
    bad = [(-1, None), (-2, [None] + [0.0] * 7), (-3, [float("nan")] * 8), (-4, [float("inf")] + [0.0] * 7), (1000, [1.0, 2.0]), (1001, [])]
    rows += [(i, v, 1, "x", 0) for i, v in bad]
    rng.shuffle(rows)
    good = [(i, v) for i, v, *_ in rows if v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, v int").repartition(3)
    codes, books = quantize.compress(df, parts=parts, entries=entries, rounds=rounds)
    want, want_books = brute(good, parts, entries, rounds)
    assert [[tuple(e) for e in p] for p in books.entries.tolist()] == want_books
    assert books.sha256() == hashlib.sha256(",".join(str(x) for p in want_books for e in p for x in e).encode()).hexdigest()
    got = sorted(((r["vec_id"], list(zip(r["dist"], r["code"], strict=True))) for r in codes.collect()), key=repr)
    assert got == sorted(((i, w) for (i, _), w in zip(good, want, strict=True)), key=repr)
    errors = {}
    by_id = {}
    for (i, _), w in zip(good, want, strict=True):
        label = i % 3 if i and i % 3 else None
        errors[label] = errors.get(label, 0) + sum(d for d, _ in w)
        by_id[i] = label
    for r in quantize.with_label_error(codes).collect():
        assert r["label_error"] == errors[by_id[r["vec_id"]]] and len(r["code"]) == 2 * parts
    back = {r["vec_id"]: r["vector"] for r in quantize.decoded(codes, books).collect()}
    for (i, _), w in zip(good, want, strict=True):
        if i is not None:
            assert back[i] == [x / 256 for p, (_, k) in enumerate(w) for x in want_books[p][k]]


def test_reassign_is_nearest_at_every_mix_of_moves():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x, book = rng.integers(-3, 3, (60, 2)), rng.integers(-3, 3, (7, 2))
        code, dist = quantize.nearest(x, book)
        moved = rng.random(7) < rng.random()
        new = np.where(moved[:, None], rng.integers(-3, 3, (7, 2)), book)
        got, want = quantize.reassign(x, new, (new != book).any(axis=1), code, dist), quantize.nearest(x, new)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_none_wild_and_uneven(spark):
    schema = "vec_id long, embedding array<float>, label int"
    codes, books = quantize.compress(spark.createDataFrame([(1, None, 2)], schema))
    assert books is None and quantize.with_label_error(codes).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        quantize.compress(spark.createDataFrame([(1, [0.5] * 10, 2)], schema))
    wild = spark.createDataFrame([(1, [3e38] * 16, 2), (2, [-3e38] * 16, 2), (3, [0.0] * 16, 2)], schema)
    codes, _ = quantize.compress(wild, entries=1, rounds=0)
    assert sorted(sum(r["dist"]) for r in codes.collect()) == [0, 16 << 54, 16 << 56]
