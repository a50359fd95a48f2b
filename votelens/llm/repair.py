"""Repair of conversations: the cheapest edits that give user and assistant turns in alternation.

A conversation is a word of signatures, one a turn: the role's initial, and whether the turn must go (blank, or a duplicate)
or is truncated.  The cheapest edits of what follows a turn depend on that suffix alone and on where the grammar
`(s?(ua)+)?` stands.  So the different words of all conversations are gathered once, and read from their ends as one
acyclic automaton in which equal suffixes are one path; suffixes whose costs-to-go differ by a constant are one node.  Each
node gets its cost-to-go and the first edit of its best audit once for each state of the grammar, and its successors carry
the rest.  Every conversation then takes the cost and the audit of its word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from votelens.llm.common import join_groups, stored

WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

# ---------------------------------------------------------------- grammar and automaton

#: States of the grammar: nothing yet, after s, after u, after a.  The words that end in the first or the last are whole.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after the one role that may be inserted or given: user, but assistant after user.
GIVEN = (USER, USER, ASSISTANT, USER)
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3  # costs; to keep costs nothing
#: Signatures: x must go; s, u, a and o (any other initial) by role, in capitals where the text is truncated.
MUST_GO = "x"

Ways = tuple[tuple[int, str], ...]  # for each state: cost to go, first edit


def _with_inserts(ways: list[tuple[int, str]]) -> Ways:
    """Each state may first insert turns; of equal costs the edit that is ASCII-least is taken, which settles all ties: no two
    ways that start alike differ in what they lead to."""
    for _ in range(len(ways)):
        ways = [min(way, (INSERT + ways[GIVEN[q]][0], "I")) for q, way in enumerate(ways)]
    return tuple(ways)


class Automaton:
    """Nodes of suffixes, minimised from the end, each with its ways for the four states.  Grows as words are read."""

    def __init__(self) -> None:
        never = 1 << 40
        self.end = _with_inserts([(0, ""), (never, ""), (never, ""), (0, "")])
        self.costs: list[tuple[int, ...]] = []  # of each node: costs to go, less the least of them
        self._known: dict[tuple[int, ...], int] = {}
        self._register: dict[tuple[str, int], tuple[int, int, str]] = {}
        self.root, self.base = self._node(self.end)

    def _node(self, ways: Ways) -> tuple[int, int]:
        least = min(cost for cost, _ in ways)
        costs = tuple(cost - least for cost, _ in ways)
        if costs not in self._known:
            self._known[costs] = len(self.costs)
            self.costs.append(costs)
        return self._known[costs], least

    def before(self, sign: str, node: int) -> tuple[int, int, str]:
        """(node, offset, first edits by state) of the suffix that `sign` and then `node` make."""
        found = self._register.get((sign, node))
        if found is None:
            ahead, extra, role = self.costs[node], TRUNCATED if sign.isupper() else 0, sign.lower()
            ways = []
            for q in range(4):
                options = [(DELETE + ahead[q], "D")]
                if sign != MUST_GO:
                    options.append((REROLE + extra + ahead[GIVEN[q]], "R"))
                    if (q, role) in STEP:
                        options.append((extra + ahead[STEP[q, role]], "K"))
                ways.append(min(options))
            ways = _with_inserts(ways)
            found = self._register[sign, node] = (*self._node(ways), "".join(edit for _, edit in ways))
        return found


class Reader:
    """Reads words in the order of their reversed letters: the path of a suffix is kept for the words that share it."""

    def __init__(self) -> None:
        self.automaton = Automaton()
        self.word = ""
        # the nodes of the word's suffixes, from the empty one to the whole word; cost so far and first edits of each
        self.path: list[tuple[int, int, str]] = [(self.automaton.root, self.automaton.base, "")]

    def read(self, word: str) -> tuple[int, str]:
        """The word's cost and audit."""
        shared, a, b = 0, self.word[::-1], word[::-1]
        for x, y in zip(a, b):  # noqa: B905
            if x != y:
                break
            shared += 1
        del self.path[shared + 1 :]
        for sign in b[shared:]:
            node, cost, _ = self.path[-1]
            node, more, edits = self.automaton.before(sign, node)
            self.path.append((node, cost + more, edits))
        self.word = word
        node, cost, _ = self.path[-1]
        return cost + self.automaton.costs[node][START], "".join(self._audit(word))

    def _audit(self, word: str) -> Iterator[str]:
        state = START
        for i, sign in enumerate(word):
            edits = self.path[len(word) - i][2]
            while (edit := edits[state]) == "I":
                yield edit
                state = GIVEN[state]
            yield edit
            state = next_state(state, edit, sign.lower())
        while state in (SYSTEM, USER):
            yield "I"
            state = GIVEN[state]


def next_state(state: int, edit: str, initial: str) -> int:
    if edit == "D":
        return state
    return STEP[state, initial] if edit == "K" else GIVEN[state]


# ---------------------------------------------------------------- turns


def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, present: the rows after the damage that crc32(conv_id:turn) % 20 tells, nulls being one space.

    0 drops a row (it stays as one that is not present), 1 empties its text, 2 takes its full stops and marks, 3 repeats it,
    4 makes it a user's.
    """
    space = F.lit(" ")
    at = F.concat(F.coalesce(F.col(conv_id).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    d = F.crc32(at.cast("binary")) % 20
    said = F.coalesce(F.col(text), space)
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.when(d == 4, "user").otherwise(F.coalesce(F.col(role), space)).alias("role"),
        F.when(d.isin(0, 1), "").when(d == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"),
        (d != 0).alias("present"), F.when(d == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def _plain(turns: DataFrame) -> DataFrame:
    """Null roles and texts as one space, and key: what tells texts of one turn and role apart, and equal rows."""
    space = F.lit(" ")
    rows = turns.withColumn("role", F.coalesce("role", space)).withColumn("text", F.coalesce("text", space))
    rows = rows if "present" in turns.columns else rows.withColumn("present", F.lit(True))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select("conv_id", "turn", "role", "text", "present", F.unhex(F.sha2(whole, 256)).alias("key"))



def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation in one partition, by turn (null first), then role, then key."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "key")


def _stream(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[Any, Iterator[tuple]]]:
    """Sorted rows as (conv_id, its rows), of which a batch is in memory at a time."""
    rows = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in columns), strict=True) for b in batches)
    return groupby(rows, key=lambda r: r[0])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about `most` characters of text."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
LEGAL = ("su", "ua", "au")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted facts of turns as (conv_id, gaps, blank, duplicate, truncated, illegal, word)."""
    for conv_id, rows in _stream(batches, ["conv_id", "turn", "initial", "blank", "cut", "again", "key", "present"]):
        word: list[str] = []
        n = {f: 0 for f in FACTS}
        low = high = None
        distinct = 0
        before = (None, None, None)
        for _, turn, initial, blank, cut, again, key, present in rows:
            if not present:
                continue
            if turn is not None and turn != high:
                low, high, distinct = turn if low is None else low, turn, distinct + 1
            if word and before[2] + initial not in LEGAL:
                n["illegal"] += 1
            again = again or (bool(word) and (turn, key) == before[:2])
            n["blank"] += blank
            n["duplicate"] += again and not blank
            n["truncated"] += cut and not again and not blank
            sign = initial if initial in ("s", "u", "a") else "o"
            word.append(MUST_GO if blank or again else sign.upper() if cut else sign)
            before = (turn, key, initial)
        if high is not None:
            n["gaps"] = high - low + 1 - distinct
        yield (conv_id, *n.values(), "".join(word))


def _mapped(df: DataFrame, rows_of: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: str) -> DataFrame:
    """mapInArrow with rows as tuples."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _batches(rows_of(batches), arrow), schema)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    reader = Reader()
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            yield (word, n, *reader.read(word))


def audits(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: a row per conversation.

    `turns` has conv_id, turn (a whole number), role and text, and may have `present`: rows that are not present count for
    nothing, but their conversation has a row.  Turns are taken by turn (null first); of one turn by role, then by a hash of
    the text.  Null roles and texts are one space; a null conv_id is one conversation; rows that repeat are duplicates.
    Texts stay where they are: what moves of a turn is its hash, its role and some marks.  A conversation's word, a letter a
    turn, is as long as its audit; nothing else of it is held.
    """
    rest = F.rtrim("text", F.lit(WHITE))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # orders null first
    light = _plain(turns).select(
        "conv_id", "turn", "role", F.substring("role", 1, 1).alias("initial"), (rest == "").alias("blank"), (~F.right(rest, F.lit(1)).isin(*ENDS)).alias("cut"), "key", "present",
    )
    light = stored(light, "turns")
    repeats = light.where("present").groupBy("conv_id", "key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = repeats.select(F.col("conv_id").alias("of"), F.col("key").alias("known"), "first")
    met = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("known"))
    marked = light.join(repeats, met, "left").withColumn("again", F.coalesce(place != F.col("first"), F.lit(False))).drop("of", "known", "first")
    kind = turns.schema["conv_id"].dataType.simpleString()
    facts = stored(_mapped(_in_order(marked), _signatures, f"conv_id {kind}, {', '.join(f'{f} long' for f in FACTS)}, word string"), "words")
    words = facts.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    from_end = F.reverse("word")
    read = _mapped(words.repartitionByRange(from_end).sortWithinPartitions(from_end), _audited, "word string, n long, cost long, audit string")
    return join_groups(facts, stored(read, "audits"), "word", "n", facts.count()).drop("word", "n")


def _edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn that an audit leaves."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit != "D":
            state = next_state(state, edit, role[:1])
            yield edit, role if edit == "K" else "assistant" if state == ASSISTANT else "user", text


def _beside_audits(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """Each conversation's audit and then its turns, in order."""
    rows = _plain(turns).where("present").drop("present").withColumn("kind", F.lit(1))
    return _in_order(audited.withColumn("kind", F.lit(0)).unionByName(rows, allowMissingColumns=True), "kind")


def repaired_turns(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role, text: the turns of each conversation after its audit."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, rows in _stream(batches, ["conv_id", "audit", "role", "text"]):
            audit = next(rows)[1]
            for place, turn in enumerate(_edited(audit, (r[2:] for r in rows))):
                yield (conv_id, place, *turn)

    kind = turns.schema["conv_id"].dataType.simpleString()
    return _mapped(_beside_audits(turns, audited), rows_of, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """The rows of `audited` with repaired_sha256, of `role:text` of the turns that stay, joined by newlines.

    A digest needs its turns in order: a conversation streams through one task, of which a batch of turns is in memory.
    """
    names = audited.columns

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, rows in _stream(batches, ["conv_id", "role", "text", *names]):
            facts = next(rows)[3:]
            sha, audit = hashlib.sha256(), facts[names.index("audit")]
            for place, (_, role, text) in enumerate(_edited(audit, (r[1:3] for r in rows))):
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield (*facts, sha.hexdigest())

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in audited.schema)
    return _mapped(_beside_audits(turns, audited), rows_of, f"{columns}, repaired_sha256 string")
