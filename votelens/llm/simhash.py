"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits.  The binary Golay code is perfect: every 23-bit word
lies within three bits of exactly one of 4096 codewords, whose 12-bit index is its decoding.  The near indices of a word
are the decodings of the word and of all words one bit away (one index, or six for words three bits from their codeword),
so two words that differ in at most one bit always meet: the decoding of either is a near index of the other.

Three errors over three segments leave two cases, and a key for each:
  - a segment is equal: of the other two, one has at most one error.  Key: the equal segment, and an index of the other.
  - no segment is equal: each has one error.  Key: an index of each of the three.
One side of a pair shows near indices where the other shows its decoding, so that few keys a fingerprint suffice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votelens.llm.common import given_back, if_small, join_groups, plain_id, stored

MAX_BITS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, width)
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the [23, 12, 7] Golay code
RUN = 1024  # fingerprints of one key that are compared in one block
SPLIT = 1 << 14  # tokens of more texts are ranked in parts
SMALL = 16  # keys of up to so many rows give all their links
SKETCH = 512  # bits of a set's short sketch
SAMPLE, COMMON = 5000, 10_000  # texts that tell common shingles, and at most so many of these
EPSILON = 1e-9  # rounding of size * similarity must never raise a bound

# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, words: int = 3) -> int:
    """A bit is 1 if set in over half of the shingles' hashes; of fewer words the whole sequence is the shingle; none: 0."""
    parts = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        hashes = np.fromiter(
            (digest(join(parts[i : i + words]), 42) for i in range(at, min(n, at + 8192))), dtype=np.uint64
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for each row.  Ids may be whole numbers or of another type."""
    ident, kind = plain_id(docs, doc_id)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = np.fromiter((fingerprint(t, words) for t in frame["text"]), dtype=np.uint64, count=len(frame))
            yield pd.DataFrame({"doc_id": given_back(frame["doc_id"], kind), "fp": fps.view(np.int64)})

    return docs.select(ident.alias("doc_id"), F.col(text).alias("text")).mapInPandas(work, f"doc_id {kind}, fp bigint")


# ---------------------------------------------------------------- Golay code


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """decode[word]: the index of the codeword within three bits; near[word]: six indices, repeated where fewer differ."""
    syndrome = np.arange(1 << 23, dtype=np.uint32)
    for bit in range(22, 10, -1):  # the remainder of division by the generator
        syndrome ^= np.where(syndrome >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    errors = np.zeros(1 << 11, dtype=np.uint32)
    bits = [1 << i for i in range(23)]
    patterns = {0} | {a | b | c for a in bits for b in bits for c in bits}
    pattern = np.fromiter(patterns, dtype=np.uint32)
    errors[syndrome[pattern]] = pattern
    words = np.arange(1 << 23, dtype=np.uint32)
    error = errors[syndrome]
    decode = ((words ^ error) >> np.uint32(11)).astype(np.uint16)  # the code is cyclic and systematic: 12 high bits
    return decode, (np.bitwise_count(error) == 3)


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(decoding, rows, indices): each word's own index, and its near indices as pairs of row and index."""
    decode, far = golay_tables()
    own = decode[words]
    at = np.flatnonzero(far[words])
    flips = decode[words[at, None] ^ (np.uint32(1) << np.arange(23, dtype=np.uint32))]
    flips.sort(axis=1)
    fresh = np.ones(flips.shape, dtype=bool)
    fresh[:, 1:] = flips[:, 1:] != flips[:, :-1]
    fresh &= flips != own[at, None]
    row, col = np.nonzero(fresh)
    rows = np.concatenate([np.arange(len(words)), at[row]])
    return own, rows, np.concatenate([own, flips[row, col]])


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows) of distinct fingerprints: any two within MAX_BITS share a key."""
    parts = [(fps >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.uint32) for low, width in SEGMENTS]
    own, rows, near = zip(*(near_indices(p) for p in parts), strict=True)
    keys, where = [], []

    def add(kind: int, row: np.ndarray, *fields: tuple[np.ndarray, int]) -> None:
        key = np.full(len(row), kind, dtype=np.int64)
        for value, width in fields:
            key = key << width | value.astype(np.int64)
        keys.append(key)
        where.append(row)

    for kind, (same, other) in enumerate(permutations(range(3), 2)):
        add(kind, rows[other], (parts[same][rows[other]], 22), (near[other], 12))  # contains its own decoding too
    # one side: near indices of segments 0 and 1, the decoding of 2; the other side: the reverse
    a = pd.DataFrame({"row": rows[0], "x": near[0]}).merge(pd.DataFrame({"row": rows[1], "y": near[1]}), on="row")
    row = a["row"].to_numpy()
    add(6, row, (a["x"].to_numpy(), 12), (a["y"].to_numpy(), 12), (own[2][row], 12))
    more = rows[2][len(fps):]
    add(6, more, (own[0][more], 12), (own[1][more], 12), (near[2][len(fps):], 12))
    return np.concatenate(keys), np.concatenate(where)


# ---------------------------------------------------------------- links

KeyMaker = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def spanning_links(fps: np.ndarray, others: np.ndarray | None = None, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that connect what the pairs within max_bits connect: at most one fewer than there are fingerprints.

    Closer pairs are taken first, in steps of MAX_BITS.  Each row meets all others in one vector operation, and only
    rows that are not yet connected to it.
    """
    every = fps if others is None else np.concatenate([fps, others])
    label = np.arange(len(every))
    out = []
    for most in range(MAX_BITS, max_bits + MAX_BITS, MAX_BITS):
        for i in range(len(fps)):
            start = i + 1 if others is None else len(fps)
            open_ = np.flatnonzero(label[start:] != label[i]) + start
            at = open_[np.bitwise_count(every[open_] ^ every[i]) <= min(most, max_bits)]
            if len(at):
                groups, first = np.unique(label[at], return_index=True)
                out += [(int(every[i]), int(every[j])) for j in at[first]]
                label[np.isin(label, groups)] = label[i]
        if (label == label[0]).all():
            break
    return out


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=int)
    return starts, np.append(starts[1:], len(keys))


def _links(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(np.array(pairs, dtype=np.uint64).view(np.int64).reshape(-1, 2), columns=["a", "b"])


def _link_runs(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> pd.DataFrame:
    """Links within each key of sorted rows.  Keys of up to SMALL rows are compared all at once, row against next rows."""
    starts, ends = _runs(keys)
    small = np.repeat(ends - starts <= SMALL, ends - starts)
    bits = fps.view(np.uint64)
    parts = []
    for shift in range(1, SMALL):
        at = np.flatnonzero((keys[shift:] == keys[:-shift]) & small[shift:]) if len(keys) > shift else np.zeros(0, dtype=int)
        if not len(at):
            break
        distance = np.bitwise_count(bits[at] ^ bits[at + shift])
        at = at[(distance <= max_bits) & (distance > 0)]
        parts.append(pd.DataFrame({"a": fps[at], "b": fps[at + shift]}))
    pairs: list[tuple[int, int]] = []
    for a, b in zip(starts[ends - starts > SMALL], ends[ends - starts > SMALL], strict=True):
        pairs += spanning_links(np.unique(bits[a:b]), max_bits=max_bits)
    return pd.concat([*parts, _links(pairs)]).drop_duplicates()


def _link_sorted(max_bits: int):
    """Links of sorted (key, fp) rows.  Blocks of a large key are compared with each other in the next step."""

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key, held_fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        block_of_key = 0

        def whole_block(key: int, fps: np.ndarray, block: int) -> Iterator[pd.DataFrame]:
            yield _link_runs(np.full(len(fps), key), fps, max_bits).assign(key=None, block=None)
            yield pd.DataFrame({"a": fps, "b": fps, "key": key, "block": block})

        for frame in frames:
            held_key = np.concatenate([held_key, frame["key"].to_numpy()])
            held_fp = np.concatenate([held_fp, frame["fp"].to_numpy()])
            starts, ends = _runs(held_key)
            if not len(starts):
                continue
            # large runs leave in blocks of RUN; the last run may go on in the next frame
            done = starts[-1]
            small = np.ones(done, dtype=bool)
            large = ends[:-1] - starts[:-1] > RUN
            if block_of_key and len(large):
                large[0] = True
            for a, b in zip(starts[:-1][large], ends[:-1][large], strict=True):
                small[a:b] = False
                first = block_of_key if a == 0 else 0
                for k, at in enumerate(range(a, b, RUN)):
                    yield from whole_block(int(held_key[a]), held_fp[at : min(b, at + RUN)], first + k)
            yield _link_runs(held_key[:done][small], held_fp[:done][small], max_bits).assign(key=None, block=None)
            if done:
                block_of_key = 0
            held_key, held_fp = held_key[done:], held_fp[done:]
            while len(held_key) > RUN:
                yield from whole_block(int(held_key[0]), held_fp[:RUN], block_of_key)
                block_of_key += 1
                held_key, held_fp = held_key[RUN:], held_fp[RUN:]
        if block_of_key:
            yield from whole_block(int(held_key[0]), held_fp, block_of_key)
        elif len(held_key):
            yield _link_runs(held_key, held_fp, max_bits).assign(key=None, block=None)

    return link


def _link_blocks(max_bits: int):
    def link(frame: pd.DataFrame) -> pd.DataFrame:
        sides = [np.unique(g["fp"].to_numpy().view(np.uint64)) for _, g in frame.groupby("block")]
        return _links(spanning_links(*sides, max_bits=max_bits) if len(sides) == 2 else [])

    return link


def near_links(fps: DataFrame, make_keys: KeyMaker | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """Links a-b between the distinct fingerprints `fp` that connect all pairs within max_bits that share a key.

    The default keys are `golay_keys`, of which any two within MAX_BITS share one.

    Within a large key only the links that keep its members connected are made, never all pairs.  A key with more than RUN
    fingerprints is cut into blocks; each pair of blocks is one small group of the second step.
    """
    spark = fps.sparkSession

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            all_fps = frame["fp"].to_numpy()
            for at in range(0, len(all_fps), 4096):
                part = all_fps[at : at + 4096]
                keys, rows = (make_keys or golay_keys)(part.view(np.uint64))
                yield pd.DataFrame({"key": keys, "fp": part[rows]})

    keys = fps.select("fp").distinct().mapInPandas(keyed, "key long, fp long")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(
        keys.repartition(partitions, "key").sortWithinPartitions("key", "fp")
        .mapInPandas(_link_sorted(max_bits), "a long, b long, key long, block int"),
        "links",
    )
    blocks = found.where("key is not null").select("key", "block", F.col("a").alias("fp"))
    last = blocks.groupBy("key").agg(F.max("block").alias("last"))
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    pairs = (
        blocks.join(last, "key").select("key", "block", "fp", other).where("block <> other")
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        .groupBy("key", "low", "high").applyInPandas(_link_blocks(max_bits), "a long, b long")
    )
    return found.where("key is null").select("a", "b").union(pairs).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component, by alternating large and small stars.

    Each round is written to the shared folder; only the links' count and checksum reach the driver.
    """

    def summed(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "edges")
    before = summed(edges)
    while True:  # a hub's edges meet one row in each join, so that Spark's skew handling may split them at will
        # large star: neighbours above a node link to its smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "edges")
        # small star: a node and its smaller neighbours link to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        small = stored(small.where("u <> v").distinct(), "edges")
        edges, after = small, summed(small)
        if after == before:
            break
        before = after
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def _grouped(fps: DataFrame, links: DataFrame) -> DataFrame:
    """fp, component_id (the smallest doc_id reachable over the links), rows (how many have the fingerprint): a stored table."""
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    labels = stored(components(links), "labels")
    labelled = stored(
        classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "least", "rows", F.coalesce("label", "fp").alias("label")),
        "classes",
    )
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    found = join_groups(labelled, stored(smallest, "components"), "label", "n", labelled.count())
    return stored(found.select("fp", "component_id", "rows"), "grouped")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    Texts link when their fingerprints differ in at most MAX_BITS bits, hence all texts without words link to each other
    and to other sparse fingerprints.  Equal fingerprints are joined before links are sought, so copies cost nothing.
    A null text has no words; null doc_ids are never a component's id unless it has no other; repeated rows repeat.
    """
    fps = stored(fingerprints(docs, doc_id, text, words), "fingerprints")
    return join_groups(fps, _grouped(fps, near_links(fps)), "fp", "rows", fps.count()).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# ---------------------------------------------------------------- similar texts
#
# An exact set-similarity join.  Order the shingles of every text by one global order; of two texts with a Jaccard similarity
# of at least t, the first n - ceil(t n) + 1 shingles of each (n: its number of different shingles) have one in common.
# So these prefixes as keys miss no pair.  Any order is right; shingles that a sample shows in many texts come last.


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The hashes of the text's different shingles, sorted."""
    parts = (text or "").encode().lower().split()
    n = max(1, len(parts) - words + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(parts[i : i + words])) for i in range(n)), dtype=np.uint64, count=n)
    return np.unique(hashes.view(np.int64))


def sketch(hashes: np.ndarray, bits: int = SKETCH) -> bytes:
    """Bit i: whether an odd number of hashes is i modulo `bits`.  Two sets differ in at least as many members as their
    sketches in bits, so a sketch rules out without ever missing."""
    odd = np.bincount(hashes & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def full_sketch(hashes: np.ndarray) -> bytes:
    """A sketch with a bit a member at least, a power of two: it tells large sets apart, where the short one can't."""
    bits = SKETCH
    while bits < len(hashes):
        bits *= 2
    return sketch(hashes, bits)


def sketches_differ(one: bytes, two: bytes) -> int:
    """In how many bits two sketches differ; the larger is folded to the smaller's size first."""
    x, y = sorted((np.frombuffer(s, dtype=np.uint64) for s in (one, two)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def most_differing(n: np.ndarray, similarity: float) -> np.ndarray:
    """In how many members two sets of n members together may differ at most, to be that similar."""
    return n - 2 * np.ceil(similarity / (1 + similarity) * n - EPSILON).astype(np.int64)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """id and the hashes of the text's different shingles, for rows of id and text."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "shingles": [shingle_hashes(t, words) for t in frame["text"]]})

    return docs.select("id", "text").mapInPandas(work, "id long, shingles array<long>")


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts in a sample of about SAMPLE, sorted, and their counts: at most COMMON.  They only order."""
    of = max(1, docs.count() // SAMPLE)
    sets = shingle_sets(docs.where(F.pmod("id", F.lit(of)) == 0).dropDuplicates(["id"]), words)
    counts = sets.select(F.explode("shingles").alias("token")).groupBy("token").count().where("count > 3")
    rows = sorted(tuple(r) for r in counts.orderBy(F.desc("count"), "token").limit(COMMON).collect())
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


def text_nodes(docs: DataFrame, words: int, verify_words: int, similarity: float) -> DataFrame:
    """doc_id, fp, id, n, sketch, full (the larger sketch) and prefix (the shingles that are keys, in order), for rows of
    doc_id, id and text."""
    common, counts = common_shingles(docs, verify_words)
    _, kind = plain_id(docs, "doc_id")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps, sizes, sketches, full, prefixes = [], [], [], [], []
            for text in frame["text"]:
                hashes = shingle_hashes(text, verify_words)
                n = len(hashes)
                weight = np.zeros(n, dtype=np.int64)
                if len(common):
                    place = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
                    weight = np.where(common[place] == hashes, counts[place], 0)
                order = np.argsort(weight, kind="stable")
                fps.append(fingerprint(text, words))
                sizes.append(n)
                sketches.append(sketch(hashes))
                full.append(full_sketch(hashes))
                prefixes.append(hashes[order[: n - math.ceil(similarity * n - EPSILON) + 1]])
            yield pd.DataFrame({
                "doc_id": given_back(frame["doc_id"], kind), "fp": np.array(fps, dtype=np.uint64).view(np.int64), "id": frame["id"],
                "n": sizes, "sketch": sketches, "full": full, "prefix": prefixes,
            })

    return docs.mapInPandas(work, f"doc_id {kind}, fp long, id long, n int, sketch binary, full binary, prefix array<long>")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """token, id, n, at (the shingle's place in the prefix), rows (of the token): the keys that more than one text has.

    Tokens are counted in partial sums, and those of many texts come back by a broadcast of bounded size, so that no task
    holds a token that a third of all texts share.
    """
    keys = stored(nodes.select("id", "n", F.posexplode("prefix").alias("at", "token")), "tokens")
    tokens = keys.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("_least"), F.max("id").alias("_most"))
    shared = stored(tokens.where("_least < _most").select("token", "rows"), "shared_tokens")
    return join_groups(keys, shared, "token", "rows", keys.count()).dropDuplicates(["token", "id"])


def placed_keys(keys: DataFrame) -> DataFrame:
    """`keys` (with label) and block: blocks of about RUN texts of a token, in the order of their labels.

    A token of many texts is cut by the leading bits of label and id into up to 2**16 parts, each ranked by itself; a part's
    texts follow those of the parts before it.  Only texts of one part are sorted in one task, so one label or token may
    hold any number of texts.
    """
    cut = (F.shiftrightunsigned(F.col("label"), 52) * 16 + F.shiftrightunsigned(F.col("id"), 60)).cast("int")
    rows = keys.withColumn("cut", F.when(F.col("rows") > SPLIT, cut).otherwise(F.lit(0)))
    rows = stored(rows.withColumn("place", F.row_number().over(Window.partitionBy("token", "cut").orderBy("label", "id"))), "placed")
    before = Window.partitionBy("token").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.where(F.col("rows") > SPLIT).groupBy("token", "cut").agg(F.count(F.lit(1)).alias("size"))
    offsets = sizes.select("token", "cut", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    place = F.col("place") - 1 + F.coalesce("before", F.lit(0))
    split = rows.where(F.col("rows") > SPLIT).join(offsets, ["token", "cut"]).withColumn("block", (place / RUN).cast("int")).drop("before")
    whole = rows.where(F.col("rows") <= SPLIT).withColumn("block", ((F.col("place") - 1) / RUN).cast("int"))
    return whole.unionByName(split).drop("cut", "place", "rows")


def _compared(similarity: float, nearest: bool):
    """Pairs of ids of different labels in sorted runs of (token, low, high), less those that surely are not similar."""

    def pairs(frame: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
        ids, label, n, at, block = (frame[c].to_numpy() for c in ("id", "label", "n", "at", "block"))
        inside = (frame["low"] == frame["high"]).to_numpy()
        bits = np.frombuffer(b"".join(frame["sketch"]), dtype=np.uint64).reshape(len(frame), -1)
        best, whose = np.full(len(frame), SKETCH + 1), np.zeros(len(frame), dtype=np.int64)
        found = []
        i = np.arange(len(frame))
        for shift in range(1, len(frame)):
            i = i[i + shift < ends[i]]
            if not len(i):
                break
            x, y = i, i + shift
            both = n[x] + n[y]
            need = np.ceil(similarity / (1 + similarity) * both - EPSILON).astype(np.int64)  # members in common
            fits = (label[x] != label[y]) & (inside[x] | (block[x] != block[y])) & (np.minimum(n[x] - at[x], n[y] - at[y]) >= need)
            x, y, most = x[fits], y[fits], (both - 2 * need)[fits]
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            if nearest:
                fits = (differ <= most) & (differ < best[y])
                best[y[fits]], whose[y[fits]] = differ[fits], x[fits]
            else:
                fits = differ <= most
                found.append(np.stack([ids[x[fits]], ids[y[fits]]], axis=1))
        if nearest:
            y = np.flatnonzero(best <= SKETCH)
            found = [np.stack([ids[whose[y]], ids[y]], axis=1)]
        rows = np.sort(np.concatenate([np.zeros((0, 2), dtype=np.int64), *found]), axis=1)
        return pd.DataFrame(rows, columns=["a", "b"]).drop_duplicates()

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if not len(frame):
                continue
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            run = frame[["token", "low", "high"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]).any(axis=1)]))
            last = starts[-1]  # may go on in the next frame; a run has at most two blocks
            if last:  # else all rows are of one run
                yield pairs(frame[:last], np.repeat(starts[1:], np.diff(starts)))
            held = frame[last:]
        if held is not None:
            yield pairs(held.reset_index(drop=True), np.full(len(held), len(held)))

    return compare


def candidate_pairs(keys: DataFrame, sketches: DataFrame, labels: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """Pairs a-b of ids of different labels that share a key and may be similar: all, or for each text of a key the nearest.

    A key is cut into blocks of RUN texts by label; each block meets itself and each other block unless all is one label.
    """
    spark = keys.sparkSession
    rows = stored(placed_keys(keys.join(labels, "id")), "keys")
    blocks = rows.groupBy("token", "block").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    low = blocks.select("token", F.col("block").alias("low"), F.col("least").alias("l0"), F.col("most").alias("l1"))
    high = blocks.select("token", F.col("block").alias("high"), F.col("least").alias("h0"), F.col("most").alias("h1"))
    meet = low.join(high, "token").where("low <= high and least(l0, h0) < greatest(l1, h1)").select("token", "low", "high")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.join(meet, "token").where("block = low or block = high").join(sketches, "id")
        .repartition(partitions, "token", "low", "high").sortWithinPartitions("token", "low", "high", "label", "id")
        .mapInPandas(_compared(similarity, nearest), "a long, b long").distinct()
    )


def plausible_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose larger sketches don't rule them out: of pairs that share a passage but little else, no text is moved."""

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            most = most_differing(frame["na"].to_numpy(dtype=np.int64) + frame["nb"].to_numpy(dtype=np.int64), similarity)
            differ = np.fromiter(map(sketches_differ, frame["sa"], frame["sb"]), dtype=np.int64, count=len(frame))
            yield frame.loc[differ <= most, ["a", "b"]]

    one, two = (nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("full").alias(f"s{x}")).dropDuplicates([x]) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInPandas(fit, "a long, b long")


def verified_links(docs: DataFrame, ids: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links a-b of fingerprints, of the pairs whose texts share enough shingles (Jaccard).  Only texts in a pair are shuffled."""
    nodes = stored(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "paired")
    texts = stored(docs.join(if_small(nodes), "id", "left_semi").dropDuplicates(["id"]).join(ids, "id"), "texts")

    def similar(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for x, y in zip(frame["ta"], frame["tb"], strict=True):
                one, two = shingle_hashes(x, words), shingle_hashes(y, words)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(two) - both))
            yield frame.loc[np.array(keep, dtype=bool), ["fa", "fb"]].rename(columns={"fa": "a", "fb": "b"})

    one, two = (texts.select(F.col("id").alias(x), F.col("fp").alias(f"f{x}"), F.col("text").alias(f"t{x}")) for x in "ab")
    found = pairs.join(one, "a").join(two, "b").select("fa", "fb", "ta", "tb").mapInPandas(similar, "a long, b long")
    return stored(found.distinct(), "similar")


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, verify_words: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """The rows of `docs` whose doc_id is their group's smallest: one document of each group stays.

    Groups are the components of two kinds of links between all texts: fingerprints within MAX_BITS, as in
    `near_duplicates`; and a Jaccard similarity of at least `similarity` on shingles of `verify_words` words.  No such pair
    is left out unless its texts are in one group already: after the first kind, each text of a key tries the nearest text of
    another group, which joins most; then all pairs of different groups that share a key are compared.  A text is known by its
    64-bit hash.  A null doc_id stays only in a group of null doc_ids.
    """
    texts = docs.select(plain_id(docs, doc_id)[0].alias("doc_id"), F.xxhash64(text).alias("id"), F.col(text).alias("text"))
    nodes = stored(text_nodes(texts, words, verify_words, similarity), "nodes")
    ids = nodes.select("id", "fp").dropDuplicates(["id"])
    links = stored(near_links(nodes), "near")
    keys = stored(shared_keys(nodes), "shared")
    sketches = nodes.select("id", "sketch").dropDuplicates(["id"])
    for nearest in (True, False):
        labels = ids.join(components(links), F.col("fp") == F.col("node"), "left").select("id", F.coalesce("label", "fp").alias("label"))
        pairs = stored(candidate_pairs(keys, sketches, labels, similarity, nearest), "pairs")
        pairs = stored(plausible_pairs(pairs, nodes, similarity), "plausible")
        links = links.union(verified_links(texts, ids, pairs, verify_words, similarity))
    grouped = join_groups(nodes.select("fp", "doc_id", "id"), _grouped(nodes, links), "fp", "rows", nodes.count())
    goes = grouped.where("not doc_id <=> component_id").select(F.col("doc_id").alias("_goes"), F.col("id").alias("_id")).distinct()
    goes = if_small(stored(goes, "near_copies"))  # mostly few, and then no text is shuffled
    return docs.join(goes, docs[doc_id].eqNullSafe(goes["_goes"]) & (F.xxhash64(docs[text]) == goes["_id"]), "left_anti")
