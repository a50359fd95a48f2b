"""Exact deduplication in two passes over a bounded Bloom filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from votelens.llm.common import free_names, join_groups, stored

SEGMENT = 1 << 16  # cells of the filter that travel in one row
HASHES = 3
MAX_CELLS = 1 << 28


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _cells(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    """The filter cells of each 64-bit hash, by double hashing."""
    h = hashes.view(np.uint64)
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((one + np.uint64(i) * two) % np.uint64(cells)).astype(np.int64) for i in range(HASHES)]


def _count_partition(cells: int):
    """Finds which cells a partition's hashes meet once or more, and which twice; gives the touched segments as bit sets."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, again = (np.zeros(cells // 8, dtype=np.uint8) for _ in range(2))

        def add(bits: np.ndarray, at: np.ndarray) -> None:
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))

        for frame in frames:
            for at in _cells(frame["h"].to_numpy(), cells):
                where, n = np.unique(at, return_counts=True)
                met = (once[where >> 3] >> (7 - (where & 7)) & 1).astype(bool)
                add(again, where[met | (n > 1)])
                add(once, where)
        once, again = once.reshape(-1, SEGMENT // 8), again.reshape(-1, SEGMENT // 8)
        for k in np.flatnonzero(once.any(axis=1)):
            yield pd.DataFrame({"segment": [int(k)], "once": [once[k].tobytes()], "again": [again[k].tobytes()]})

    return count


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    once = again = np.zeros(SEGMENT // 8, dtype=np.uint8)
    for a, b in zip(frame["once"], frame["again"], strict=True):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        again = again | b | (once & a)
        once = once | a
    return pd.DataFrame({"segment": frame["segment"].iloc[:1], "once": [once.tobytes()], "again": [again.tobytes()]})


def repeated_filter(signatures: DataFrame, max_cells: int = MAX_CELLS, builders: int = 256) -> Callable[[Column], Column]:
    """A test of 64-bit hashes: false only for those that surely occur once among `signatures.h`.

    The first pass.  A cell counts as set when two or more rows meet it.  The filter takes 16 cells a row up to
    `max_cells` (2**28 cells are 32 MB: the proven bound of what is gathered and broadcast, and half of what a task of
    the first pass holds).  So of the rows that occur once over 99 in 100 pass straight up to 16 million rows, 85 up to
    67 million, fewer beyond; results stay the same.  A larger corpus needs a larger `max_cells`: 2**33 for a billion
    rows.  A multiple of SEGMENT.
    """
    spark = signatures.sparkSession
    wanted = 16 * max(1, signatures.count())
    cells = SEGMENT
    while cells < wanted and cells < max_cells:
        cells *= 2
    schema = "segment int, once binary, again binary"
    counted = signatures.select("h").coalesce(builders).mapInPandas(_count_partition(cells), schema)
    merged = counted.groupBy("segment").applyInPandas(_merge, schema).select("segment", "again")
    bits = np.zeros((cells // SEGMENT, SEGMENT // 8), dtype=np.uint8)
    for row in merged.toLocalIterator():
        bits[row["segment"]] = np.frombuffer(row["again"], np.uint8)
    shared = spark.sparkContext.broadcast(bits.reshape(-1))

    @F.pandas_udf(T.BooleanType())
    def maybe_repeated(h: pd.Series) -> pd.Series:
        found = np.ones(len(h), dtype=bool)
        for at in _cells(h.to_numpy(), cells):
            found &= (shared.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return pd.Series(found)

    return maybe_repeated


def _signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    sha = F.sha2(normalised(F.col(text)), 256)
    return docs.select(F.col(doc_id).alias("doc_id"), sha.alias("text_sha256")).withColumn("h", F.xxhash64("text_sha256"))


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of ASCII white space by one space; null is the empty text.
    Of equal texts the row with the smallest doc_id stays (a null doc_id only if the group has no other); of rows that
    repeat text and doc_id one stays.  Rows whose hash surely occurs once never shuffle.
    """
    signatures = stored(_signed(docs, doc_id, text), "signatures")
    marked = signatures.withColumn("again", repeated_filter(signatures, max_cells)(F.col("h")))
    alone = marked.where(~F.col("again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    rows = stored(
        marked.where("again").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "repeated"
    )
    groups = stored(
        rows.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("n")),
        "groups",
    )
    met = (
        join_groups(rows, groups, "text_sha256", "n", rows.count())
        .select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select(
            "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256",
        )
    )
    return alone.unionByName(met)


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """The rows of `docs` that `duplicate_groups` keeps, with all their columns.

    Rows that surely occur once pass straight through.  The others shuffle by text hash and doc_id, which spreads a
    large group of copies over all tasks.
    """
    signatures = stored(_signed(docs, doc_id, text), "signatures")
    again = repeated_filter(signatures, max_cells)
    keep = (
        signatures.withColumn("again", again(F.col("h"))).where("again")
        .groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"))
        .withColumnRenamed("text_sha256", "keep_sha")
    )
    sha, mark, n = free_names(docs, "_sha", "_again", "_n")
    marked = docs.withColumn(sha, F.sha2(normalised(F.col(text)), 256)).withColumn(mark, again(F.xxhash64(sha)))
    alone = marked.where(~F.col(mark))
    one = Window.partitionBy(sha, doc_id).orderBy(text)
    repeated = marked.where(mark)
    met = (repeated[sha] == keep["keep_sha"]) & repeated[doc_id].eqNullSafe(keep["keep_id"])
    first = repeated.join(keep, met, "left_semi").withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).drop(n)
    return alone.unionByName(first).select(*docs.columns)
