"""Product codes of vectors by Lloyd's iterations that look at active entries only.

A vector is cut into parts, and each part is coded by the nearest entry of its position's codebook.  Between two rounds a
part keeps its entry and the exact distance to it.  Where that entry has not moved, no entry that stayed either can have come
nearer: only those that moved are compared with the stored distance.  A part whose own entry moved is compared with all.
Arithmetic is on whole numbers, and of entries at one distance the lowest index wins, in both cases.

Vectors never leave their partition; what is gathered and sent out are codebooks, of `parts` x `entries` entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.llm.common import join_groups, stored

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Whole numbers beyond this are taken as this, so that sums of squares over a vector stay within 64 bits.
MOST = 1 << 27
AT_ONCE = 8192  # rows compared at once


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null, infinite or not a number."""
    number = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    return F.coalesce(F.forall(vector, number), F.lit(False))


def whole(vector: Column) -> Column:
    """Each component as floor(256 x), at most MOST away from zero."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int"))


@dataclass(frozen=True)
class Codebooks:
    entries: np.ndarray  # part, entry, component

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry, the lowest of equals, and its squared distance."""
    found, least = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    for at in range(0, len(x), AT_ONCE):
        some = x[at : at + AT_ONCE]
        d = ((some[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        found[at : at + AT_ONCE] = d.argmin(axis=1)
        least[at : at + AT_ONCE] = d.min(axis=1)
    return found, least


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`nearest` after the entries `moved` (a truth value each) have moved, from what it gave before."""
    code, dist = code.copy(), dist.copy()
    active = np.flatnonzero(moved)
    if not len(active):
        return code, dist
    lost = moved[code]
    code[lost], dist[lost] = nearest(x[lost], book)
    kept = np.flatnonzero(~lost)
    best, d = nearest(x[kept], book[active])
    best = active[best]
    nearer = (d < dist[kept]) | ((d == dist[kept]) & (best < code[kept]))
    code[kept[nearer]], dist[kept[nearer]] = best[nearer], d[nearer]
    return code, dist


def _array(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), type=kind))


def _assigner(books: np.ndarray, moved: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, _, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _array(batch, "v", parts * width).reshape(-1, parts, width)
            before = None if moved is None else (_array(batch, "code", parts), _array(batch, "dist", parts))
            code, dist = np.empty(x.shape[:2], dtype=np.int64), np.empty(x.shape[:2], dtype=np.int64)
            for p in range(parts):
                if before is None:
                    code[:, p], dist[:, p] = nearest(x[:, p], books[p])
                else:
                    code[:, p], dist[:, p] = reassign(x[:, p], books[p], moved[p], before[0][:, p], before[1][:, p])
            kept = [c for c in batch.schema.names if c not in ("code", "dist")]
            columns = [batch.column(c) for c in kept] + [_lists(code, pa.int32()), _lists(dist, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "code", "dist"])

    return work


def assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """`rows` (with v) and code and dist, the nearest entry of each part and its squared distance.

    With `moved`, rows have the code and dist of the codebooks before, and active entries alone are compared.
    """
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("code", "dist")]
    return rows.mapInArrow(_assigner(books, moved), ", ".join([*kept, "code array<int>", "dist array<bigint>"]))


def _sums(shape: tuple[int, int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, entries, width = shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(shape, dtype=np.int64), np.zeros(shape[:2], dtype=np.int64)
        for batch in batches:
            x, code = _array(batch, "v", parts * width).reshape(-1, parts, width), _array(batch, "code", parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                n[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), _lists(total[part, entry], pa.int64())],
                names=["part", "entry", "n", "total"],
            )

    return work


def updated(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the componentwise floor of its parts' mean; an entry without parts stays.

    Partitions send a row per entry that they use; sums of these are parts x entries rows.
    """
    width = books.shape[2]
    sums = rows.select("v", "code").mapInArrow(_sums(books.shape), "part int, entry int, n bigint, total array<bigint>")
    each = [F.sum(F.element_at("total", i + 1)).alias(f"t{i}") for i in range(width)]
    new = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():
        new[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return new


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, dist) of each usable vector, and the codebooks; no codebooks without such vectors.

    The length of vectors is that of the one with the least vec_id; `parts` must divide it, and vectors of another length,
    which can't be compared, are left out like those that are not `usable`.  Codebooks start as the parts of the first
    `entries` vectors by vec_id (null last; of one vec_id, by components), of all where there are fewer.  Rows that repeat
    count each.  What a round assigned is stored, so a lost executor costs its share of one round.
    """
    found = vectors.where(usable(F.col(vector))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole(F.col(vector)).alias("v"))
    rows = stored(found, "vectors")
    in_order = (F.asc_nulls_last("vec_id"), "v")
    first = rows.orderBy(*in_order).first()
    if first is None:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("code"), F.array().cast("array<bigint>").alias("dist")), None
    size = len(first["v"])
    if size % parts or not size:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("v") == size)
    start = np.array([r["v"] for r in rows.orderBy(*in_order).limit(entries).collect()], dtype=np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, size // parts).transpose(1, 0, 2))
    moved = None
    for _ in range(rounds):
        rows = stored(assigned(rows, books, moved), "codes")
        new = updated(rows, books)
        moved, books = (new != books).any(axis=2), new
    return assigned(rows, books, moved).select("vec_id", "label", "code", "dist"), Codebooks(books)


def hex_code(code: Column) -> Column:
    """Two hexadecimal digits an index."""
    return F.lower(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def with_label_error(codes: DataFrame) -> DataFrame:
    """vec_id, code (as hex_code), error and label_error, the error summed over rows of the same label; null is a label."""
    rows = stored(
        codes.select(
            "vec_id", F.struct("label").alias("of"), hex_code(F.col("code")).alias("code"),
            F.aggregate("dist", F.lit(0).cast("long"), lambda a, d: a + d).alias("error"),
        ),
        "errors",
    )
    sums = stored(rows.groupBy("of").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    return join_groups(rows, sums, "of", "n", rows.count()).select("vec_id", "code", "error", "label_error")


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id and the vector that its code stands for, in the unit of the input."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in part]) for part in books.entries])
    parts = F.transform("code", lambda c, i: F.element_at(F.element_at(table, i + 1), c + 1))
    return codes.select("vec_id", F.transform(F.flatten(parts), lambda x: x.cast("double") / SCALE).alias("vector"))
