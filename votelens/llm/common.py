"""Helpers shared by the operators: tables, shared scratch tables and gapless ranks."""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ASCII letters of either case; other letters are left alone by `ascii_lower`.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`).

    Where that is unset, a new local one, but only if the executors are threads of the driver: other machines would not see it.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="votelens-")
    return _own_dirs[sc.applicationId]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and survives the loss of any executor.

    The files go when the Spark application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(temporary(spark, path))
    return spark.read.schema(df.schema).parquet(path)


def temporary(spark: SparkSession, path: str) -> str:
    """The same path, whose files go when the Spark application ends."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


#: A stored table of two numbers a row is broadcast up to so many rows, under 64 MB; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1 << 21


def if_small(df: DataFrame) -> DataFrame:
    """A stored table of ids, with the hint to broadcast it if a count shows that it may be."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Groups of more rows than this, and than a hundred-thousandth of all rows, are joined by a broadcast of at most HOT_BYTES.
HOT_ROWS, HOT_GROUPS, HOT_BYTES = 256, 100_000, 1 << 26


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes when it is broadcast: its texts' bytes, and 16 for each column."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    return sum(texts, F.lit(16 * len(df.columns))).cast("long")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows.join(groups, key), where `groups` has one row per key and `n`, how many of the `total` rows have it.

    The rows of large groups stay where they are: their groups are broadcast, the largest first, of which there are at most
    HOT_GROUPS and at most HOT_BYTES (sizes are summed by powers of two of n).  So tasks of the shuffled rest meet no large
    key, or, where groups themselves are long, Spark splits it.  Both inputs are read twice: pass stored tables.
    """
    most = max(HOT_ROWS, total // HOT_GROUPS)
    power = F.ceil(F.log2(F.col(n))).cast("int")
    large = groups.where(F.col(n) > most).groupBy(power.alias("power")).agg(F.sum(row_bytes(groups)).alias("bytes"))
    held = 0
    for r in sorted(large.collect(), key=lambda r: -r["power"]):  # at most 64 rows
        held += r["bytes"]
        if held > HOT_BYTES:
            most = max(most, 1 << r["power"])
            break
    hot = F.broadcast(groups.where(F.col(n) > most))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(n) <= most), key)
    return rows.join(hot, key).unionByName(rest)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that df has not, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def plain_id(docs: DataFrame, name: str) -> tuple[Column, str]:
    """An id as Python workers take it, and its type there: whole numbers as long, any other type as it is."""
    kind = docs.schema[name].dataType.simpleString()
    return (F.col(name).cast("long"), "bigint") if kind in ("tinyint", "smallint", "int", "bigint") else (F.col(name), kind)


def given_back(ids: pd.Series, kind: str) -> pd.Series:
    """Ids of a pandas frame for Spark: numbers with nulls among them have become floats."""
    return ids.astype("Int64") if kind == "bigint" else ids


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is.  Plain ASCII text takes the fast built-in path."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def gapless_rank(
    df: DataFrame, by: list[str], order: list[str], name: str, rows: int, bucket_rows: int = 20_000
) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... within each value of `by`, without sorting a whole group in one task.

    A group is cut by a hash of `order` into buckets of about `bucket_rows` rows; the rank is the bucket's offset (a
    running sum over the small table of counts) plus the rank inside the bucket.  `df` is read twice: pass a stored table.
    """
    buckets = min(max(32, rows // bucket_rows), 1_000_000)
    cut = df.withColumn("_cut", F.pmod(F.xxhash64(F.lit("rank"), *order), F.lit(buckets)))
    before = Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*by, "_cut").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*by, "_cut").orderBy(*order)
    ranked = cut.withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        ranked.join(offsets, [*by, "_cut"])
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_cut", "_before", "_inside")
    )
