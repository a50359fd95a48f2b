"""Jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.llm.common import gapless_rank, stored


def _jumps(keys: list[str], shards: int, steps: int) -> Column:
    """The state (b, j) after `steps` jumps: b is the last shard below `shards`, j the next jump's target."""

    def jump(state: Column, step: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit("jump"), *keys, step), 11)
        uniform = (bits.cast("double") + F.lit(1.0)) / F.lit(float(2**53))  # in (0, 1]
        there = F.floor((state["j"] + F.lit(1)) / uniform).cast("long")
        return F.when(
            state["j"] < F.lit(shards), F.struct(state["j"].alias("b"), there.alias("j"))
        ).otherwise(state)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, jump)


def jump_state(keys: list[str], shards: int) -> Column:
    """struct(b, j): b is the shard among `shards`; j is the first larger shard count minus one that moves the key.

    The expected number of jumps is about ln(shards); a key that needs more than the usual number is finished by a
    second pass of `shards` steps, which is always enough as each jump moves forward by one shard at least.
    """
    usual = min(shards, 32 + 4 * math.ceil(math.log(shards + 1)))
    state = _jumps(keys, shards, usual)
    if usual == shards:
        return state
    return F.when(state["j"] >= F.lit(shards), state).otherwise(_jumps(keys, shards, shards))


def assign_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, size, text_crc32, shard, slot, grown_shard.

    Law `key`: the key and the number of shards alone decide; with one more shard a key stays or moves into the new
    one.  `size` is the text's UTF-8 bytes plus 1; a null text has size 1 and the checksum of no bytes.  A null key is
    a key like any other; rows that repeat a key go to the same shard and take separate slots.  Other columns of `docs`
    are ignored.  `slot` counts from 0 without gaps in each shard.
    """
    state = jump_state(["key"], shards)
    content = F.coalesce(F.col("text"), F.lit(""))
    placed = stored(
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .select(
            "key",
            (F.octet_length(content) + 1).cast("long").alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            state.alias("state"),
        )
        .select(
            "key", "size", "text_crc32",
            F.col("state.b").cast("int").alias("shard"),
            F.when(F.col("state.j") == shards, F.lit(shards)).otherwise(F.col("state.b")).cast("int").alias("grown_shard"),
        ),
        "shards",
    )
    slotted = gapless_rank(placed, ["shard"], ["key", "text_crc32", "size"], "slot", placed.count())
    return slotted.select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard")
