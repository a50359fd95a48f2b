"""Reading and writing the tables: idempotent loads, slices, appends and run-scoped output."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votelens.schemas import RUN_KEY, TABLES
from votelens.sources import manifest

_own_dirs: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), or in one of our own
    where that is unset and executors are threads of the driver.  It goes when the application ends."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = _own_dirs.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="votelens-"))
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table by its fixed schema; nothing is inferred."""
    return spark.read.schema(TABLES[name]).parquet(path)


def create_empty(spark: SparkSession, path: str, name: str) -> None:
    spark.createDataFrame([], TABLES[name]).write.mode("ignore").parquet(path)


def load_if_empty(df: DataFrame, path: str) -> bool:
    """Writes df unless the target has rows; tells whether it wrote."""
    spark = df.sparkSession
    if exists(spark, path) and not spark.read.schema(df.schema).parquet(path).isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def rewrite_slices(df: DataFrame, path: str, slice_column: str, slices: list[str]) -> None:
    """Replaces `slices`, also by nothing where df has none of their rows, and no others; readers see old or new whole."""
    manifest.replace_slices(df, path, slice_column, slices)


def append_calls(calls: DataFrame, path: str, batch: str) -> bool:
    """Appends to the call log, unless a batch of that name is there; each row has an id that tells its run and its attempt."""
    told = F.concat_ws("|", *RUN_KEY, "purpose", F.col("attempts").cast("string"))
    rows = calls if "call_id" in calls.columns else calls.withColumn("call_id", F.sha1(told))
    return manifest.append_once(rows, path, batch)


def write_run(df: DataFrame, path: str, mock: bool) -> None:
    """Output of rehearsals and real runs stays apart."""
    df.drop("mock").withColumn("mock", F.lit(mock)).write.mode("append").partitionBy("mock").parquet(path)


def read_run(spark: SparkSession, path: str, mock: bool) -> DataFrame:
    return spark.read.parquet(path).where(F.col("mock") == mock)


def write_csv(df: DataFrame, path: str) -> None:
    """A report of bounded size as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json_text(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
