"""Best-fit packing of tokenised documents by bin completion over the histogram of lengths.

Pieces of one length are interchangeable, so the packing problem of any number of documents is a histogram of at most
`capacity` counts.  That table alone is planned on the driver; pieces then find their place by their rank in their length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votelens.llm.common import gapless_rank, given_back, plain_id, stored

CAPACITY = 1024
END = 2  # the id that ends each document
VOCABULARY = "byte_bpe_50k.json"

# ---------------------------------------------------------------- planning

Plan = list[tuple[tuple[int, ...], int]]  # (sizes in a sequence, number of such sequences)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, many equal items at a time."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}

    def put(left: int, pattern: tuple[int, ...], n: int) -> None:
        group = open_bins.setdefault(left, {})
        group[pattern] = group.get(pattern, 0) + n

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            left = min((r for r in open_bins if r >= size), default=None)
            if left is None:
                per_bin = capacity // size
                if n >= per_bin:
                    put(capacity - size * per_bin, (size,) * per_bin, n // per_bin)
                if n % per_bin:
                    put(capacity - size * (n % per_bin), (size,) * (n % per_bin), 1)
                break
            pattern, there = next(iter(open_bins[left].items()))
            take = min(n, there)
            if take == there:
                del open_bins[left][pattern]
                if not open_bins[left]:
                    del open_bins[left]
            else:
                open_bins[left][pattern] = there - take
            put(left - size, (*pattern, size), take)
            n -= take
    return [(p, n) for group in open_bins.values() for p, n in group.items()]


def fillings(room: int, sizes: list[int], counts: dict[int, int], width: int) -> list[tuple[int, ...]]:
    """Undominated sets of items for the room beside the largest document, least waste first.

    One item that fills the room dominates every other set, as the others' items fit into it.  Sets of one item keep
    only the largest item; of several, only those that waste less than the best smaller set.  `sizes` is descending.
    """
    fit = [s for s in sizes if s <= room]
    if not fit:
        return [()]
    best = fit[0]
    found: list[tuple[int, ...]] = [(best,)]
    if best == room:
        return found
    have = set(fit)

    def add(chosen: tuple[int, ...], left: int, start: int, depth: int) -> None:
        """Extends a set with items no larger than its last one."""
        nonlocal steps
        for at in range(start, len(fit)):
            steps -= 1
            if steps < 0 or len(found) > width:
                return
            size = fit[at]
            if size > left or chosen.count(size) >= counts[size]:
                continue
            rest, now = left - size, (*chosen, size)
            if rest == 0 or (rest in have and rest <= size and now.count(rest) < counts[rest]):
                found.append(now if rest == 0 else (*now, rest))
                continue
            if depth > 1:
                add(now, rest, at, depth - 1)
            elif sum(now) > best:
                found.append(now)

    for depth in (1, 2, 3, 6):  # few, large items before many small ones
        steps = 4000
        add((), room, 0, depth)
        if any(sum(x) == room for x in found):
            break
    ranked = sorted(set(found), key=lambda x: (room - sum(x), len(x), tuple(-s for s in x)))
    return ranked[:width]


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 4000, width: int = 4) -> Plan:
    """Few sequences for the counted sizes: bin completion with branch and bound.

    Each node takes the largest remaining size and branches over undominated fillings of the room beside it, repeated
    as long as the counts last.  A branch whose waste exceeds what a better plan may waste is cut.  Best-fit solutions
    are the incumbents: of the whole, and of what remains in each branch.  `nodes` bounds the search, so the plan is
    the best found; the lower bound ends it early.
    """
    counts = {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in counts.items())
    least = -(-total // capacity)
    best = best_fit(counts, capacity)
    fewest = sum(n for _, n in best)
    if fewest == least:
        return best
    # (counts, plan so far, its waste)
    stack: list[tuple[dict[int, int], Plan, int]] = [(counts, [], 0)]
    while stack and nodes and fewest > least:
        nodes -= 1
        left, plan, waste = stack.pop()
        if waste > (fewest - 1) * capacity - total:
            continue
        sizes = sorted(left, reverse=True)
        if nodes % 50 == 0 or len(sizes) <= 8:  # an incumbent: best fit for the rest
            whole = plan + best_fit(left, capacity)
            if (n := sum(k for _, k in whole)) < fewest:
                best, fewest = whole, n
        if not sizes:
            continue
        largest = sizes[0]
        after_one = {s: n - (s == largest) for s, n in left.items()}
        branches = []
        for filling in fillings(capacity - largest, [s for s in sizes if after_one[s]], after_one, width):
            pattern = (largest, *filling)
            uses = {s: pattern.count(s) for s in set(pattern)}
            times = min(left[s] // u for s, u in uses.items())
            lost = capacity - sum(pattern)
            rest = {s: m for s, n in left.items() if (m := n - times * uses.get(s, 0))}
            branches.append((rest, [*plan, (pattern, times)], waste + times * lost))
        stack.extend(reversed(branches))
    return best


class Places:
    """Where the k-th piece of a length goes: sequence and offset, from a plan of bounded size."""

    def __init__(self, plan: Plan):
        starts: dict[int, int] = {}
        rows = []
        first = 0
        for pattern, times in sorted(plan, reverse=True):
            offsets = np.concatenate([[0], np.cumsum(pattern)])[:-1]
            for size in sorted(set(pattern)):
                own = [int(o) for o, s in zip(offsets, pattern, strict=True) if s == size]
                rank = starts.get(size, 0)
                rows.append((size, rank, first, own))
                starts[size] = rank + times * len(own)
            first += times
        rows.sort()
        self.keys = np.array([size << 48 | rank for size, rank, _, _ in rows], dtype=np.int64)
        self.first = np.array([r[2] for r in rows], dtype=np.int64)
        self.each = np.array([len(r[3]) for r in rows], dtype=np.int64)
        self.at = np.cumsum(self.each) - self.each
        self.offsets = np.array([o for r in rows for o in r[3]], dtype=np.int64)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length.astype(np.int64) << 48 | rank.astype(np.int64)
        run = np.searchsorted(self.keys, key, side="right") - 1
        n = key - self.keys[run]
        return self.first[run] + n // self.each[run], self.offsets[self.at[run] + n % self.each[run]]


# ---------------------------------------------------------------- tokens

def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts as little-endian bytes.

    The vocabulary is the given file of the `tokenizers` library.  Its ids are also its merge ranks, so plain texts are
    encoded by `tiktoken` from the same vocabulary, which gives the same ids in a third of the time (a test compares
    them); texts that hold a special token go to `tokenizers` itself.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = byte_letters()
        special = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in w): i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w not in special}
        self.special = sorted(special)
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.asarray(ids, dtype="<u4").tobytes()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def cut_points(length: int, capacity: int) -> list[int]:
    """Where the pieces of a document start: one piece if it fits, else full pieces after a first that may be shorter."""
    first = (length - 1) % capacity + 1
    return [0, *range(first, length, capacity)]


def tokenise(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    vocabulary: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, on demand, the ids as little-endian bytes.

    A null text is empty, so its only id is END.  Documents' ids may be whole numbers or of another type.  `vocabulary` is a path that every executor has.
    """
    ident, kind = plain_id(docs, doc_id)
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(vocabulary or default_vocabulary())
        end = END.to_bytes(4, "little")
        for frame in frames:
            rows = []
            for key, content in zip(frame["doc_id"], frame["text"], strict=True):
                ids = encode(content or "") + end
                starts = cut_points(len(ids) // 4, capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids) // 4], strict=True)):
                    own = ids[4 * a : 4 * b]
                    rows.append((None if pd.isna(key) else key, k, a, b - a, zlib.crc32(own), *[own] * with_ids))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])
            out["doc_id"] = given_back(out["doc_id"], kind)
            yield out

    return docs.select(ident.alias("doc_id"), F.col(text).alias("text")).mapInPandas(work, columns)


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    vocabulary: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on demand).

    Documents are cut only when longer than `capacity`; each sequence holds at most `capacity` ids without gaps.  Rows
    that repeat a document are packed each; an empty table gives no rows; other columns of `docs` are ignored.  The
    histogram that reaches the driver has at most `capacity` rows, whatever the input.
    """
    pieces = stored(tokenise(docs, doc_id, text, capacity, vocabulary, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = pieces.sparkSession.sparkContext.broadcast(Places(complete_bins(counts, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.value.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank", sum(counts.values()))
    return (
        ranked.withColumn("_place", place("length", "_rank"))
        .withColumn("sequence_id", F.col("_place.sequence_id")).withColumn("offset", F.col("_place.offset"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from `pack(..., with_ids=True)`: sequence_id, length, ids (at most the capacity)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))


def least_sequences(total: int, capacity: int = CAPACITY) -> int:
    return math.ceil(total / capacity)
