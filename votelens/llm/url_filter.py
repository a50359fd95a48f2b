"""URL filters: longest-match rules, and a character language-model ratio for the URLs that no rule fits.

Two variable-order Markov models, of URLs that rules allow and of URLs that they block, give each character's probability
after up to ORDER characters before it, smoothed from order to order (Witten-Bell).  The ratio of a URL's two likelihoods,
by its length, is compared with a threshold that was calibrated on rule-judged URLs kept out of training.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.llm.common import LOWER, UPPER, join_groups, stored

ORDER = 3
ALPHABET = 256
START, STOP = "\x02", "\x03"
UNIT = 1 << 20  # log ratios are whole multiples of 1 / UNIT, so that their sums don't depend on the order
BINS = 1000  # of the calibration's histogram on either side of zero, 0.01 wide


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str  # host/path

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


# Fixed values of the filter's contract.
RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    ranked = sorted(rules, key=lambda r: (-len(r.rule), r.rule))
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in ranked
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def grams(address: Column) -> Column:
    """Each character of the address, and its end, after the ORDER characters before it; in time linear in the address.

    The address is cut into characters once (`chars` is a lambda's argument, which is a value), and each gram takes its own
    by their places; a slice would copy the whole array each time.
    """
    padded = F.concat(F.lit(START * ORDER), address, F.lit(STOP))

    def taken(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - ORDER - 1), lambda i: F.concat(*[F.get(chars, i + k) for k in range(ORDER + 1)]))

    return F.flatten(F.transform(F.array(F.split(padded, "")), taken))


def gram_ratios(urls: DataFrame) -> DataFrame:
    """gram, ratio (log of its last character's probability if allowed over that if blocked, in units of 1 / UNIT), and n (how
    often all URLs have it).

    `urls` has address and training (allow, block or null).  Every URL's grams are counted over the whole corpus, with
    partial sums before the shuffle; the tables after that have a row per gram and order at most.
    """
    seen = urls.select("training", F.explode(grams(F.col("address"))).alias("gram"))
    counts = stored(
        seen.groupBy("gram").agg(
            F.count_if(F.col("training") == "allow").alias("a"), F.count_if(F.col("training") == "block").alias("b"), F.count(F.lit(1)).alias("n")
        ),
        "grams",
    )
    orders = F.explode(F.transform(F.sequence(F.lit(0), F.lit(ORDER)), lambda k: F.struct(
        k.alias("k"), F.col("gram").substr(F.lit(ORDER + 1) - k, k + F.lit(1)).alias("tail"))))
    tails = counts.select("gram", "a", "b", orders.alias("o")).select("gram", "a", "b", "o.k", "o.tail")
    by_tail = tails.groupBy("tail").agg(F.min("k").alias("k"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("holders"))
    by_tail = stored(by_tail.withColumn("context", F.expr("substring(tail, 1, k)")), "tails")  # a tail's length is its order's
    by_context = stored(
        by_tail.groupBy("context").agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb"),
            F.count(F.lit(1)).alias("tails"),
        ),
        "contexts",
    )
    table = join_groups(by_tail, by_context, "context", "tails", by_tail.count()).select(
        "tail", F.struct("k", "a", "b", "na", "nb", "ta", "tb").alias("s"), "holders"
    )
    steps = join_groups(tails.select("gram", "tail"), stored(table, "steps"), "tail", "holders", (ORDER + 1) * counts.count())
    per_gram = steps.groupBy("gram").agg(F.array_sort(F.collect_list("s")).alias("steps"))

    def probability(n: str, total: str, types: str) -> Column:
        def smooth(p: Column, s: Column) -> Column:
            return F.when(s[total] > 0, (s[n] + s[types] * p) / (s[total] + s[types])).otherwise(p)

        return F.aggregate("steps", F.lit(1.0 / ALPHABET), smooth)

    ratio = F.log(probability("a", "na", "ta")) - F.log(probability("b", "nb", "tb"))
    return per_gram.select("gram", F.round(ratio * UNIT).cast("long").alias("ratio")).join(counts.select("gram", "n"), "gram")


def url_scores(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """number, score: the length-normalised log-likelihood difference.  An empty address has the score of its end.

    `urls` has address and number, which goes with each of its grams in its place.  Grams that are very frequent are joined by a broadcast of bounded size, the others by a shuffle or as Spark measures.
    """
    total = ratios.agg(F.sum("n")).first()[0] or 0
    exploded = urls.select("number", F.explode(grams(F.col("address"))).alias("gram"))
    summed = join_groups(exploded, ratios, "gram", "n", total).groupBy("number").agg(F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("grams"))
    return summed.select("number", (F.col("sum") / F.col("grams") / UNIT).alias("score"))


def calibrated(scores: DataFrame) -> float:
    """The threshold with the least sum of both error rates over scores of known `verdict`; 0 if one verdict is missing.

    It lies midway in the gap between neighbouring scores.

    Only a histogram of 2 * BINS + 1 rows reaches the driver.
    """
    bin_ = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") * 100))).cast("int")
    rows = scores.groupBy(bin_.alias("bin")).agg(
        F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")
    ).orderBy("bin").collect()
    allowed, blocked = sum(r["a"] for r in rows), sum(r["b"] for r in rows)
    if not allowed or not blocked:
        return 0.0
    best, lost, kept, before = (2.0, 0.0), 0, blocked, rows[0]["bin"]
    for r in rows:  # the threshold lies midway between the bin before and this one
        error = lost / allowed + kept / blocked
        best = min(best, (error, (before + r["bin"]) / 2))
        lost, kept, before = lost + r["a"], kept - r["b"], r["bin"] + 1
    return best[1] / 100


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, score (null where a rule decides).

    A null URL, or one without `://`, has an empty host and path and is judged by the models like any other text.
    Different URLs are scored once each, so a URL that a third of the rows share costs one.
    """
    known = (
        pages.select(F.coalesce(F.col(url), F.lit("")).alias("url")).groupBy("url").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
        .withColumn("match", matched_rule(F.col("host"), F.col("path"), rules))
        .withColumn("address", F.regexp_replace("url", r"(?s)^.*?://", ""))
    )
    trains = F.xxhash64("url") % 5 != 0
    urls = stored(
        known.select("url", "rows", "host", "path", "address", F.col("match.rule").alias("rule"), F.col("match.verdict").alias("verdict"))
        .withColumn("training", F.when(trains, F.col("verdict"))).withColumn("number", F.monotonically_increasing_id()),
        "urls",
    )
    ratios = stored(gram_ratios(urls), "ratios")
    judged = urls.where("verdict is null or training is null")
    scores = stored(url_scores(judged.select("number", "address"), ratios), "scores")
    threshold = calibrated(scores.join(judged.where("verdict is not null").select("number", "verdict"), "number"))
    decided = (
        urls.join(scores, "number", "left")
        .withColumn("score", F.when(F.col("rule").isNull(), F.col("score")))
        .select("url", "rows", "host", "path", "rule", "score",
                F.coalesce("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"))
    )
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    total = urls.agg(F.sum("rows")).first()[0] or 0
    return join_groups(rows, stored(decided, "decided"), "url", "rows", total).select("page_id", "host", "path", "rule", "verdict", "score")
