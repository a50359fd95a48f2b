"""Benchmark decontamination: windows of normalised test words, sought in every text.

Documents are scanned for anchors (blocks of ANCHOR words that start at every STRIDE-th word).  Any full window in a
document contains such an anchor whole, so few rows leave a text; around an anchor that occurs in a test window, all
windows are then compared in full.  Shorter items are their own window and anchor, sought at every word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.llm.common import ascii_lower, if_small, stored

WINDOW = 10
ANCHOR = 5
STRIDE = WINDOW - ANCHOR + 1
#: Test windows of up to so many bytes, ids of their items and anchors included, are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _strings(words: Column, start: Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


_WINDOWS = "array<struct<p:int,size:int,window:string>>"


def _window(around: Column, at: Column, size: int | Column) -> Column:
    """The window at a place of the words around an anchor, with its place in the text."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.struct((F.col("low") + at).alias("p"), size.alias("size"), _strings(around, at, size).alias("window"))


def test_windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """window (its words, space-joined), size (its number of words), items (the sorted ids that hold it)."""
    words = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(
        "item is not null and size(w) > 0"
    )
    size = F.least(F.size("w"), F.lit(WINDOW))
    starts = words.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("at"))
    return starts.groupBy(_strings(F.col("w"), F.col("at"), F.col("size")).alias("window"), "size").agg(
        F.array_sort(F.collect_set("item")).alias("items")
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, n_words, hits (the positions of hit words), items (the ids of the items
    whose windows occur).

    A window is 10 consecutive words of an item, or all words of a shorter one.  Null texts and ids of items are passed
    over; a null document has no words; a null doc_id is a value like any other; rows that repeat a document repeat.

    An anchor leaves its text with the few words around it that full windows could need, so what moves grows with the
    text's length alone.
    """
    windows = test_windows(benchmark, item_id, item_text)
    held = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda n, item: n + F.octet_length(item) + 16) + 64
    anchor_bytes = F.when(F.col("size") == WINDOW, 32 * STRIDE).otherwise(32)
    sizes = {r["size"]: r["bytes"] for r in windows.groupBy("size").agg(F.sum(held + anchor_bytes).alias("bytes")).collect()}
    hint = F.broadcast if sum(sizes.values()) <= BROADCAST_BYTES else (lambda df: df)
    short = sorted(s for s in sizes if s < WINDOW)

    split = F.split(F.col("window"), " ")
    inner = F.explode(F.sequence(F.lit(0), F.lit(WINDOW - ANCHOR))).alias("k")
    anchors = (
        windows.where(F.col("size") == WINDOW).select(split.alias("w"), inner)
        .select(F.xxhash64(_strings(F.col("w"), F.col("k"), ANCHOR)).alias("anchor"), F.lit(ANCHOR).alias("len"))
        .union(windows.where(F.col("size") < WINDOW).select(F.xxhash64("window"), "size"))
        .distinct().withColumn("met", F.lit(True))
    )
    words = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(F.col(text)).alias("w")
    ).withColumn("n_words", F.size("w"))

    def starts(length: int, stride: int, before: int) -> Column:
        """Anchors with the words around them, from `low` on: `before` words ahead, and as far as a window may reach."""

        def anchor(at: Column) -> Column:
            low = F.greatest(at - before, F.lit(0))
            around = _strings(F.col("w"), low, at + length + before - low)
            return F.struct(
                at.alias("at"), F.lit(length).alias("len"), low.alias("low"), around.alias("around"),
                F.xxhash64(_strings(F.col("w"), at, length)).alias("anchor"),
            )

        there = F.sequence(F.lit(0), F.col("n_words") - length, F.lit(stride))
        return F.when(F.col("n_words") >= length, F.transform(there, anchor)).otherwise(
            F.array().cast("array<struct<at:int,len:int,low:int,around:string,anchor:bigint>>")
        )

    # the first keeps its document's row; no anchor has its length, and its hash spreads such rows over all tasks
    first = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("len"), F.lit(0).alias("low"), F.lit("").alias("around"), F.xxhash64("doc_id", "text_hash").alias("anchor"))
    sought = F.concat(F.array(first), starts(ANCHOR, STRIDE, WINDOW - ANCHOR), *[starts(s, 1, 0) for s in short])
    anchored = (
        words.select("doc_id", "text_hash", "n_words", F.explode(sought).alias("s")).select("doc_id", "text_hash", "n_words", "s.*")
        .join(hint(anchors), ["anchor", "len"], "left")
        .where("met or at < 0")
    )
    # all windows around an anchor; a short item's anchor is its window
    near = F.split("around", " ")
    full = F.when(F.size(near) >= WINDOW, F.sequence(F.lit(0), F.size(near) - WINDOW)).otherwise(F.array().cast("array<int>"))
    long_windows = F.when((F.col("len") == ANCHOR) & (F.col("at") % STRIDE == 0), F.transform(full, lambda p: _window(near, p, WINDOW))).otherwise(F.array().cast(_WINDOWS))
    own = F.when(F.col("len").isin(short), F.array(_window(near, F.col("at") - F.col("low"), F.col("len")))).otherwise(F.array().cast(_WINDOWS))
    header = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).alias("size"), F.concat_ws(":", "doc_id", "text_hash").alias("window")))
    candidates = F.when(F.col("at") < 0, header).otherwise(F.concat(long_windows, own))
    met = (
        anchored.select("doc_id", "text_hash", "n_words", F.explode(candidates).alias("c")).select("doc_id", "text_hash", "n_words", "c.*")
        .join(hint(windows), ["window", "size"], "left")
        .where("items is not null or p < 0")
    )
    hit = F.when(F.col("p") >= 0, F.struct("p", "size"))
    grouped = met.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if(F.col("p") < 0).alias("rows"),
        F.collect_set(hit).alias("found"), F.collect_set("items").alias("lists"),
    )
    spread = F.flatten(F.transform("found", lambda f: F.sequence(f["p"], f["p"] + f["size"] - 1)))
    return grouped.select(
        "doc_id", "text_hash", "n_words", F.array_sort(F.array_distinct(spread)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"),
    ).drop("row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **columns: str) -> DataFrame:
    """The rows of `docs` without a hit word; only ids and text hashes of the others are joined."""
    bad = (
        contamination(docs, benchmark, doc_id, text, **columns).where(F.size("hits") > 0)
        .select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_hash"))
    )
    bad = if_small(stored(bad, "contaminated"))  # mostly few, and then no text is shuffled
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs[text]) == bad["_hash"]), "left_anti")


def remove_spans(text: Column, n_words: Column, hits: Column) -> Column:
    """The text's normalised words without the hit ones, space-joined: the milder remedy for long documents."""
    kept = F.filter(words_of(text), lambda w, i: ~F.array_contains(hits, i))
    return F.when(F.size(hits) == 0, text).otherwise(F.array_join(kept, " "))
