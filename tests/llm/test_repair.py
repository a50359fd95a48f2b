"""Repairs against a search over all edits, written anew."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from votelens.llm import repair
from votelens.llm.queries import QUERIES

from ..oracle import DATA
from .test_queries import rows_of

COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\r\x0b\x0c")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """The least (cost, audit) of all edit sequences, by Dijkstra's search over whole audits, and the turns that stay."""
    bad = faults(rows)
    heap, done = [(0, "", 0, "", ())], {}
    whole = re.compile(r"(s?(ua)+)?\Z")
    # a prefix of what the grammar takes, told by its last initial
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    while heap:
        cost, audit, i, last, kept = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            roles = "".join(r[:1] for r, _ in kept)
            assert whole.match(roles), roles
            return cost, audit, kept
        if done.setdefault((i, last), (cost, audit)) < (cost, audit):
            continue
        for role in ("user", "assistant"):
            if role[0] in after[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*kept, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, kept))
            if bad[i] not in ("b", "d"):
                more = 3 * (bad[i] == "t")
                if role[:1] and role[:1] in after[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*kept, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in after[last]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, new[0], (*kept, (new, text))))
    raise AssertionError


def brute(rows):
    """Of a conversation's (turn, role, text), in order."""
    bad = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, kept = cheapest(rows)
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, bad.count("b"), bad.count("d"), bad.count("t"),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))


def test_words_of_every_kind():
    rng = random.Random(1)
    words = ["".join(p) for n in range(5) for p in itertools.product("xsuaoSUAO", repeat=n)]
    words += ["".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(5, 14))) for _ in range(3000)]
    reader = repair.Reader()
    for word in sorted(words, key=lambda w: w[::-1]):
        if len(word) > 3 and rng.random() > 0.3:
            continue
        rows = [(i, {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[c.lower()], " " if c == "x" else f"{i}{'' if c.isupper() else '.'}") for i, c in enumerate(word)]
        assert reader.read(word) == cheapest(rows)[:2], word
    # whatever the words, suffixes make few nodes
    assert len(reader.automaton.costs) < 100


def conversations(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Hello.", "Yes!", "no end", " \t", "", None, "Why? \n", "ünï."]
    rows = []
    for c in [None, *range(n)]:
        for _ in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([None, *range(8)]), rng.choices(roles, [5, 5, 2, 1, 1, 1])[0], rng.choice(texts), "k", 1))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, key string, n int"


def test_audits_and_digests(spark):
    rng = random.Random(5)
    rows = conversations(rng, 300)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    audited = repair.audits(turns)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.digests(turns, audited).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        want[c] = brute(by_turn([(t, " " if r is None else r, " " if x is None else x) for k, t, r, x, *_ in rows if k == c]))
    assert got == want
    text = {c: [] for c in want}
    for r in repair.repaired_turns(turns, audited).orderBy("conv_id", "place").collect():
        assert r["place"] == len(text[r["conv_id"]])
        text[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(t).encode()).hexdigest() == want[c][-1] for c, t in text.items())


def test_none_and_absent(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.digests(none, repair.audits(none)).collect() == []
    gone = spark.createDataFrame([("a", 1, "user", "x")], "conv_id string, turn int, role string, text string").withColumn("present", F.lit(False))
    (row,) = repair.digests(gone, repair.audits(gone)).collect()
    assert tuple(row[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_long_conversation(spark):
    """One conversation with most rows, many of them alike."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i if i % 3 else 0}.") for i in range(20_000)] + [(c, 0, "user", "Hi.") for c in range(2, 50)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r["conv_id"]: r for r in repair.audits(turns).collect()}
    assert len(got) == 49 and got[1]["duplicate"] == sum(i % 3 == 0 for i in range(20_000)) - 2
    assert got[1]["audit"].count("D") >= got[1]["duplicate"] and got[7]["audit"] == "KI"


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("data", [DATA, DATA.parent / "sf0.01"])
def test_query(spark, data):
    after = {}
    for r in rows_of("conversations", data):
        d = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role, text = "user" if d == 4 else r["role"], "" if d == 1 else re.sub("[.!?]", "", r["text"]) if d == 2 else r["text"]
        after.setdefault(r["conv_id"], []).extend([(r["turn"], role, text)] * {0: 0, 3: 2}.get(d, 1))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_repair"](spark, str(data)).collect()}
    assert got == {c: brute(by_turn(rows)) for c, rows in after.items()}
