"""Near-duplicate links against all pairs."""

import random

import pandas as pd

from votelens.llm import common, simhash

from .corpus import sentence
from .test_operators import brute_fingerprint, union
from .test_pipeline import shingles

SCHEMA = "doc_id long, text string"


def brute_kept(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    label = union([(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if near(a, b)], range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[label[k]] = min(i, least.get(label[k], i))
    return set(least.values())


def kept(spark, rows):
    return {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = sentence(rng, 1) + "x"
    return words


def test_crowded_keys_lose_no_similar_pair(spark, monkeypatch):
    """Texts of one family, most pairs of which share keys but fail the similarity test; keys cut into blocks."""
    rng = random.Random(11)
    base = sentence(rng, 200).split()
    half = [edited(rng, base, 4) for _ in range(200)]
    rows = [(i, " ".join(w)) for i, w in enumerate(half + [edited(rng, w, 3) for w in half[:60]])]
    want = brute_kept(rows)
    assert 60 < len(want) < len(rows) - 60
    assert kept(spark, rows) == want
    monkeypatch.setattr(simhash, "RUN", 8)
    assert kept(spark, rows) == want
    monkeypatch.setattr(simhash, "SPLIT", 20)  # tokens ranked in parts, and joined by a broadcast
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    assert kept(spark, rows) == want


def test_tokens_in_parts_have_gapless_blocks(spark, monkeypatch):
    """Blocks of a token of many texts: full but for the last, and labels stay together as they would without parts."""
    rng = random.Random(9)
    monkeypatch.setattr(simhash, "SPLIT", 50)
    monkeypatch.setattr(simhash, "RUN", 16)
    labels = [rng.getrandbits(64) - (1 << 63) for _ in range(30)]
    rows = [(t, rng.getrandbits(64) - (1 << 63), 5, 0, n, rng.choice(labels[:1] if t == 2 else labels)) for t, n in ((1, 700), (2, 400), (3, 40)) for _ in range(n)]
    keys = spark.createDataFrame(rows, "token long, id long, n int, at int, rows long, label long").repartition(5)
    got = simhash.placed_keys(keys).collect()
    assert sorted((r.token, r.id, r.label) for r in got) == sorted((r[0], r[1], r[5]) for r in rows)
    for token, n in ((1, 700), (2, 400), (3, 40)):
        blocks = [r.block for r in got if r.token == token]
        assert sorted(blocks) == [k // 16 for k in range(n)]


def test_every_text_of_a_group_links(spark):
    """A chain of 3-bit links leads away from its first document; a text like the last one only must join."""
    rng = random.Random(5)
    chain = [sentence(rng, 300).split()]
    while len(chain) < 26:
        more = edited(rng, chain[-1], 1)
        if (brute_fingerprint(" ".join(more)) ^ brute_fingerprint(" ".join(chain[-1]))).bit_count() <= 3:
            chain.append(more)
    texts = [" ".join(w) for w in chain]
    fps = [brute_fingerprint(t) for t in texts]
    while True:
        far = " ".join(edited(rng, chain[-1], 6))
        if all((brute_fingerprint(far) ^ f).bit_count() > 3 for f in fps):
            break
    assert len(shingles(far) & shingles(texts[0])) < 0.8 * len(shingles(far) | shingles(texts[0]))
    rows = [*enumerate(texts), (100, far)]
    assert kept(spark, rows) == brute_kept(rows) == {0}


def test_similar_texts_join_however_many_bits_differ(spark):
    """Texts and the same with almost a quarter more appended, and scattered edits."""
    rng = random.Random(3)
    rows, bits = [], []
    for k in range(60):
        words = sentence(rng, rng.choice((100, 300))).split()
        other = words + sentence(rng, len(words) * 24 // 100).split() if k % 2 else edited(rng, words, len(words) // 50)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        bits.append((brute_fingerprint(rows[-2][1]) ^ brute_fingerprint(rows[-1][1])).bit_count())
    assert max(bits) > 12
    assert kept(spark, rows) == brute_kept(rows) == {2 * k for k in range(60)}


def test_null_and_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c, d = (sentence(rng, 300) for _ in range(4))
    a2, b2 = (" ".join(edited(rng, t.split(), 6)) for t in (a, b))
    assert all((brute_fingerprint(x) ^ brute_fingerprint(y)).bit_count() > 3 for x, y in ((a, a2), (b, b2)))
    rows = [(None, a), (5, a2), (None, c), (7, d), (7, b), (3, b2)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(5, a2), (None, c), (7, d), (3, b2)}


def test_runs_go_on_over_any_number_of_frames(spark):
    """A frame may be part of one run of texts that share a key, as the last one of a partition often is."""
    rng = random.Random(13)
    base = [sentence(rng, 120).split() for _ in range(4)]
    rows = [(i, " ".join(edited(rng, base[i % 4], 2 + i // 16))) for i in range(48)]
    want = brute_kept(rows)
    assert 4 < len(want) < 44
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "3", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert kept(spark, rows) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_frames_of_one_run_are_compared(spark):
    """The same pairs, however the sorted rows are cut into frames."""
    columns = ["id", "n", "at", "label", "block", "low", "high", "token", "sketch"]
    rows = [(i, 100, 0, i, 0, 0, 0, token, bytes(simhash.SKETCH // 8)) for token, ids in ((1, (1, 2, 3)), (2, (4, 5)), (3, (6, 7, 8, 9))) for i in ids]
    for nearest, want in ((False, {(1, 2), (1, 3), (2, 3), (4, 5), (6, 7), (6, 8), (6, 9), (7, 8), (7, 9), (8, 9)}), (True, {(1, 2), (2, 3), (4, 5), (6, 7), (7, 8), (8, 9)})):
        for size in (1, 2, 3, 5, 8, 9):
            frames = [pd.DataFrame(rows[at : at + size], columns=columns) for at in range(0, len(rows), size)]
            found = pd.concat(list(simhash._compared(0.8, nearest)(iter(frames))))
            assert set(zip(found["a"].tolist(), found["b"].tolist(), strict=True)) == want
