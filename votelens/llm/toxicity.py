"""Toxicity by compression distance: one zstandard dictionary of ordinary text, one of toxic text.

The ordinary dictionary is ordinary text, and what zstandard's trainer picks from more of it.  The toxic dictionary is the
same with DICTIONARY bytes more, which the trainer picks from toxic text; so what both kinds of text share costs the same
under either, and cancels.  Every window of the running text is compressed with both.  The distance of a window is the
number of bytes that the toxic dictionary saves; a text's features tell its windows at each distance of LEVELS, against what
ordinary text shows there, and a logistic curve over them gives the score.  Both are calibrated on texts that the
dictionaries have not seen.

Toxic texts are mostly ordinary prose.  So the trainer gets not all of it but windows: at first those that the ordinary
dictionary leaves longer than it leaves nine of ten ordinary windows; then, ROUNDS times, those that a toxic dictionary of
the other half of the texts shortens by REFINE bytes or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.llm.common import free_names, stored

WINDOW, STRIDE = 32, 8  # bytes of running text, so neighbouring windows overlap
LEVELS = (4, 5, 6, 7, 8)
#: The labelled sample has at most so many different texts of each label, and trains on at most SAMPLE_BYTES of each of
#: these, in pieces spread evenly over the text: the bound of what reaches the driver.
MAX_TOXIC, MAX_ORDINARY = 2000, 4000
SAMPLE_BYTES, PIECE = 3072, 512
BACKGROUND, TRAINED, DICTIONARY = 1 << 20, 1 << 16, 1 << 13
NOVEL, ROUNDS, REFINE = 0.9, 2, 6
LEAST_SAMPLES = 50  # of fewer windows no dictionary is trained
TOXIC_WEIGHT = 2.0  # a toxic text that is missed counts as so many ordinary ones that are not
AT_ONCE = 1 << 15  # windows that are compressed in one call

# ---------------------------------------------------------------- windows and distances


def text_bytes(text: str | None) -> bytes:
    """The whole text with A-Z in lower case; null is empty."""
    return (text or "").encode("utf-8", "replace").lower()


def window_places(length: int) -> np.ndarray:
    """(start, length) of each window; the last one ends with the text, and a shorter text is one window."""
    if length <= WINDOW:
        return np.array([[0, length]] if length else np.zeros((0, 2)), dtype=np.uint64)
    starts = np.append(np.arange(0, length - WINDOW, STRIDE), length - WINDOW)
    return np.stack([starts, np.full(len(starts), WINDOW)], axis=1).astype(np.uint64)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Compresses windows with a dictionary's bytes as what came before; matches have six bytes or more."""
    parameters = zstandard.ZstdCompressionParameters.from_level(
        5, source_size=WINDOW, dict_size=len(dictionary), min_match=6,
        write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    loaded = zstandard.ZstdCompressionDict(dictionary or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    loaded.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=loaded, compression_params=parameters)


def compressed_lengths(with_: zstandard.ZstdCompressor, data: bytes, places: np.ndarray) -> np.ndarray:
    parts = [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(places), AT_ONCE):
        some = places[at : at + AT_ONCE].copy()  # the caller's places stay as they are
        low = int(some[0, 0])
        view = data[low : int(some[-1].sum())]
        some[:, 0] -= np.uint64(low)
        done = with_.multi_compress_to_buffer(zstandard.BufferWithSegments(view, some.tobytes()), threads=1)
        parts.append(np.fromiter(map(len, map(done.__getitem__, range(len(done)))), dtype=np.int64, count=len(done)))
    return np.concatenate(parts)


@dataclass(frozen=True)
class Dictionaries:
    ordinary: bytes
    toxic: bytes  # what the toxic dictionary has besides

    @cached_property
    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return compressor(self.ordinary), compressor(self.ordinary + self.toxic)

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def distances(self, data: bytes) -> np.ndarray:
        """Of each window, its length under the ordinary dictionary less that under the toxic one."""
        places = window_places(len(data))
        one, two = self.compressors
        return compressed_lengths(one, data, places) - compressed_lengths(two, data, places)


    def counts(self, texts: Iterable[bytes]) -> np.ndarray:
        """A row of `counts` for each text.  Texts are compressed together, about AT_ONCE windows a call, as a call takes the
        time of many windows to set up; windows never cross from one text into the next."""
        found = [np.zeros((0, len(LEVELS) + 2))]
        some: list[bytes] = []
        size = 0
        for data in texts:
            some.append(data)
            size += len(data)
            if size >= AT_ONCE * STRIDE:
                found.append(self._counts(some))
                some, size = [], 0
        found.append(self._counts(some))
        return np.concatenate(found)

    def _counts(self, texts: list[bytes]) -> np.ndarray:
        places = [window_places(len(data)) for data in texts]
        ends = np.cumsum([0, *map(len, places)])
        starts = np.cumsum([0, *map(len, texts)]).astype(np.uint64)
        for at, start in zip(places, starts, strict=False):
            at[:, 0] += start
        one, two = self.compressors
        data, every = b"".join(texts), np.concatenate([np.zeros((0, 2), dtype=np.uint64), *places])
        saved = compressed_lengths(one, data, every) - compressed_lengths(two, data, every)
        return np.array([counts(saved[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]).reshape(-1, len(LEVELS) + 2)


def counts(distances: np.ndarray) -> np.ndarray:
    """The number of windows, of those at each level, and the sum of the distances."""
    return np.array([len(distances), *[(distances >= level).sum() for level in LEVELS], distances.sum()], dtype=np.float64)


def features(found: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Of rows of `counts`: for each level by how many deviations its windows exceed what ordinary text shows (`rates`), which
    does not grow with a text's length, on two scales; the share of its windows; and the mean distance."""
    n, at = found[:, :1], found[:, 1:-1]
    excess = (at - rates * n) / np.sqrt(rates * n + 1)
    scales = [np.sign(excess) * np.log1p(np.abs(excess)), np.minimum(excess, 20) / 5, np.sqrt(at / (n + 10))]
    return np.concatenate([np.ones_like(n), *scales, found[:, -1:] / (n + 10)], axis=1)


@dataclass(frozen=True)
class Model:
    dictionaries: Dictionaries
    rates: tuple[float, ...]  # the share of ordinary text's windows at each level
    weights: tuple[float, ...]

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        found = self.dictionaries.counts(map(text_bytes, texts))
        z = features(found, np.array(self.rates)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


# ---------------------------------------------------------------- training


def sample_of(text: str | None) -> bytes:
    """At most SAMPLE_BYTES of a text, in pieces that are spread evenly over it."""
    data = text_bytes(text)
    if len(data) <= SAMPLE_BYTES:
        return data
    starts = np.linspace(0, len(data) - PIECE, SAMPLE_BYTES // PIECE).astype(int)
    return b"".join(data[at : at + PIECE] for at in starts)


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """zstandard's own dictionary of the samples; none of too few."""
    if len(samples) < LEAST_SAMPLES:
        return b""
    return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()


def _picked(texts: list[bytes], lengths, least: float) -> list[bytes]:
    """The texts' whole windows for which `lengths` gives `least` or more."""
    found = []
    for data in texts:
        places = window_places(len(data))
        for at in np.flatnonzero(lengths(data, places) >= least):
            if int(places[at, 1]) == WINDOW:
                found.append(data[int(places[at, 0]) : int(places[at].sum())])
    return found


def train(toxic: list[bytes], ordinary: list[bytes]) -> Dictionaries:
    """Both dictionaries, of samples of texts."""
    background, rest = ordinary[0::2], ordinary[1::2]
    each = max(PIECE, -(-BACKGROUND // max(1, len(background))))
    pieces = [data[at : at + PIECE] for data in background for at in range(0, len(data), PIECE)]
    prose = b"".join(data[:each] for data in background)[:BACKGROUND] + trained(pieces, TRAINED, 32, 8)
    plain = compressor(prose)
    left = [compressed_lengths(plain, data, window_places(len(data))) for data in rest] or [np.zeros(1)]
    usual = float(np.quantile(np.concatenate(left), NOVEL)) + 1
    halves = (toxic[0::2], toxic[1::2])
    samples = [_picked(half, lambda data, places: compressed_lengths(plain, data, places), usual) for half in halves]
    for _ in range(ROUNDS):
        other = [compressor(prose + trained(samples[1 - i], DICTIONARY, 16, 6)) for i in (0, 1)]
        samples = [
            _picked(half, lambda data, places, i=i: compressed_lengths(plain, data, places) - compressed_lengths(other[i], data, places), REFINE)
            for i, half in enumerate(halves)
        ]
    return Dictionaries(prose, trained(samples[0] + samples[1], DICTIONARY, 16, 6))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge-regularised logistic regression on standardised columns, by Newton's method."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], spread[0] = 0.0, 1.0
    x = (x - mean) / spread
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    w = w / spread
    w[0] -= float(mean @ w)
    return w


# ---------------------------------------------------------------- Spark


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that training must not see; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_toxic: int, max_ordinary: int
) -> tuple[DataFrame, dict[int, int]]:
    """The sampled texts (_label, _hash, _text, _fold), and how many different labelled texts there are of each label.

    Different texts are known by their hash, which is taken before labels are joined: no text moves but the sample's.
    """
    hashed = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash")).where(~held_out(F.col("_id")))
    marks = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where("_label in (0, 1) and _id is not null")
    known = stored(hashed.join(marks, "_id").groupBy("_label", "_hash").agg(F.count(F.lit(1)).alias("rows")), "labelled")
    total = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("_label") == value).orderBy("_hash").limit(most) for value, most in ((1, max_toxic), (0, max_ordinary))]
    picked = parts[0].union(parts[1]).select("_label", "_hash")  # a text that has both labels is in both
    texts = docs.where(~held_out(F.col(doc_id))).select(F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    found = texts.join(F.broadcast(picked), "_hash").groupBy("_label", "_hash").agg(F.first("_text").alias("_text"))
    return stored(found.withColumn("_fold", F.pmod(F.xxhash64(F.lit("fold"), "_hash"), F.lit(2)).cast("int")), "sample"), total


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY,
) -> Model:
    """Trains on a bounded sample of the labelled rows that are not held out.

    The sample is the first `max_toxic` and `max_ordinary` different texts of each label in the order of a hash of the
    text.  Dictionaries of either half of it give the other half's distances, on which the curve is fitted; then all of
    the sample trains the dictionaries that are used.  Without texts of both labels every score is the same.
    """
    sample, total = labelled_sample(docs, labels, doc_id, text, label, max_toxic, max_ordinary)

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"label": frame["_label"], "fold": frame["_fold"], "h": frame["_hash"], "data": [sample_of(t) for t in frame["_text"]]})

    rows = sample.mapInPandas(pieces, "label int, fold int, h long, data binary").collect()  # at most both bounds of SAMPLE_BYTES
    rows.sort(key=lambda r: (r["h"], r["label"]))

    def side(value: int, fold: int | None = None) -> list[bytes]:
        return [bytes(r["data"]) for r in rows if r["label"] == value and fold in (None, r["fold"])]

    if not side(1) or not side(0):
        share = 0.9 if side(1) else 0.1
        return Model(Dictionaries(b"", b""), (0.0,) * len(LEVELS), (math.log(share / (1 - share)), *[0.0] * (3 * len(LEVELS) + 1)))
    apart = docs.sparkSession.sparkContext.broadcast([train(side(1, 1 - f), side(0, 1 - f)) for f in (0, 1)])

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [counts(apart.value[fold].distances(text_bytes(t))) for fold, t in zip(frame["_fold"], frame["_text"], strict=True)]
            yield pd.DataFrame({"label": frame["_label"], "h": frame["_hash"], "x": found})

    facts = sample.mapInPandas(seen, "label int, h long, x array<double>").collect()  # a few numbers for each sampled text
    facts.sort(key=lambda r: (r["h"], r["label"]))
    x, y = np.array([r["x"] for r in facts]), np.array([float(r["label"]) for r in facts])
    usual = x[y == 0].sum(axis=0)
    rates = usual[1:-1] / max(1.0, usual[0])
    weight = np.where(y == 1, TOXIC_WEIGHT * total[1] / (y == 1).sum(), total[0] / (y == 0).sum())
    weight *= len(y) / weight.sum()
    weights = logistic(features(x, rates), y, weight)
    return Model(train(side(1), side(0)), tuple(map(float, rates)), tuple(map(float, weights)))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 of each whole text; a null text is empty, and has a score too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts), dtype="float64")

    # the annotations are read as types, so they are given here and not above
    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(work, "double")(F.col(text)))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with a score under one half."""
    (name,) = free_names(docs, "_score")
    return scored(docs, fit(docs, labels, doc_id, text), text, name).where(F.col(name) < 0.5).select(*docs.columns)
