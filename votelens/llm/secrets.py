"""Secret scans: base patterns, and secret values judged by who owns them across the corpus.

Values are what base patterns hold, and other long mixed tokens of high entropy.  Their hashes are counted over the corpus by
distinct repositories and owners.  Owners decide: a value that one owner alone has, in however many repositories, is a
live-looking credential, and becomes a span of the kind `owned`, by whatever pattern it was found; one that several owners
have is a widely copied example, be it in one text that they all copied or in many.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.llm.common import free_names, join_groups, stored

# Fixed values of the scan's contract: kinds in listed order, their patterns, and the least length of what they hold.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: What must stand in a text (lower-cased) for ASSIGN to match.
ASSIGN_HINTS = ("pass", "secret", "token", "api")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more is what HEX finds and LEAST keeps

#: The method's own candidates: long mixed tokens of high entropy.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_ENTROPY = 3.0
#: A value under more distinct owners than this is a widely copied example.
MAX_OWNERS = 1

#: Characters [start, stop) hold the pattern, [first, last) the value in it.
Span = tuple[int, int, int, int, int, str]
SPAN = "array<struct<kind:int,start:long,stop:long,first:long,last:long,value:string>>"


def base_spans(text: str) -> list[Span]:
    """(kind's number, its place, its value's place, value): leftmost non-overlapping matches of each kind, failing ones dropped."""
    found = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        found += [(0, *m.span(), *m.span(2), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(1, *m.span(), *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(2, *m.span(), *m.span(), m[0]) for m in HEX_RUN.finditer(text)]
    return found


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def candidate_spans(text: str, base: list[Span]) -> list[Span]:
    """Long tokens with letters and digits and high entropy that no base span touches."""
    out = []
    for m in CANDIDATE.finditer(text):
        value, (start, stop) = m[0], m.span()
        if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)) or entropy(value) < LEAST_ENTROPY:
            continue
        if all(stop <= s[1] or start >= s[2] for s in base):
            out.append((3, start, stop, start, stop, value))
    return out


def _scan(texts: pd.Series) -> pd.Series:
    def rows() -> Iterator[list[dict]]:
        for text in texts:
            base = base_spans(text) if text else []
            found = base + (candidate_spans(text, base) if text else [])
            yield [dict(zip(("kind", "start", "stop", "first", "last", "value"), x, strict=True)) for x in sorted(found, key=lambda x: (x[1], x[0]))]

    return pd.Series(list(rows()), dtype=object)


def value_owners(spans: DataFrame) -> DataFrame:
    """value_hash, repositories, owners, n: how many distinct ones hold a value, and its spans.

    `spans` has value_hash, repository, owner, of which null is a value like any other.  Distinct counts are partial sums
    over (value, repository) and (value, owner), so a value that everybody copies never gathers its rows in one task.
    """
    return spans.groupBy("value_hash").agg(
        F.count_distinct(F.xxhash64("repository")).alias("repositories"), F.count_distinct(F.xxhash64("owner")).alias("owners"),
        F.count(F.lit(1)).alias("n"),
    )


def find_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str | None = None, owner: str = "source",
    max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """One row per row of `docs`: doc_id, spans (start, kind, stop, value_hash, repositories, owners, live), by start and kind.

    Base spans always stay; `live` tells owner-specific values from widely copied examples.  Each live value, of a base span
    or a candidate, gives a span `owned` over the value alone, once where several patterns hold it; candidates that are not
    live give none.  `repository` is a column, or else the text itself, so that copies of a file are one repository; how many
    hold a value is told, and decides nothing.  Values leave the scan as hashes.  A null text is empty; a null repository or owner is a value like any other; rows that repeat
    are scanned each.
    """
    scanned = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.col(repository) if repository else F.xxhash64(text)).alias("repository"),
            F.col(owner).alias("owner"), F.pandas_udf(_scan, SPAN)(F.col(text)).alias("raw"),
        ).select(
            "doc_id", "repository", "owner",
            F.transform("raw", lambda s: F.struct(
                *[s[c].alias(c) for c in ("kind", "start", "stop", "first", "last")], F.sha2(s["value"], 256).alias("value_hash")
            )).alias("raw"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "secrets",
    )
    spans = scanned.where(F.size("raw") > 0).select("row", "repository", "owner", F.explode("raw").alias("s"))
    spans = stored(spans.select("row", "repository", "owner", "s.*"), "spans")
    owners = stored(value_owners(spans), "owners")
    live = F.col("owners") <= max_owners
    facts = ("value_hash", "repositories", "owners", "live")
    own = F.struct(F.col("first").alias("start"), F.lit(3).alias("kind"), F.col("last").alias("stop"), *facts)
    both = F.array_compact(F.array(F.when(F.col("kind") < 3, F.struct("start", "kind", "stop", *facts)), F.when(F.col("live"), own)))
    judged = (
        join_groups(spans.drop("repository", "owner"), owners, "value_hash", "n", spans.count()).withColumn("live", live)
        .select("row", F.explode(both).alias("s"))
        .groupBy("row").agg(F.array_sort(F.array_distinct(F.collect_list("s"))).alias("spans"))
    )
    none = F.array().cast("array<struct<start:long,kind:int,stop:long,value_hash:string,repositories:long,owners:long,live:boolean>>")
    return scanned.join(judged, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column | str) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def mask_live(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with every live span of `find_secrets` overwritten by asterisks; doc_id must be unique here."""
    key, spans = free_names(docs, "_id", "_live")
    live = found.select(
        F.col("doc_id").alias(key), F.filter("spans", lambda s: s["live"]).alias(spans)
    ).where(F.size(spans) > 0)

    def masked(content, span):
        before = F.substring(content, F.lit(1), span["start"].cast("int"))
        return F.concat(before, F.repeat(F.lit("*"), (span["stop"] - span["start"]).cast("int")), F.substring(content, span["stop"].cast("int") + 1, F.length(content)))

    hidden = F.aggregate(F.coalesce(spans, F.array().cast(live.schema[spans].dataType)), F.col(text), masked)
    return docs.join(live, docs[doc_id] == live[key], "left").withColumn(text, hidden).select(*docs.columns)
