"""Raw pairwise judgments from files: nested conversations, each record's place in its file, and records that can't be used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A judgment as files have it; nothing is inferred, and other fields of a record are left out.
_TALK = T.ArrayType(T.StructType().add("role", T.StringType()).add("content", T.StringType()))
JUDGMENT = (
    T.StructType().add("question_id", T.IntegerType()).add("model_a", T.StringType()).add("model_b", T.StringType()).add("winner", T.StringType())
    .add("judge", T.StringType()).add("turn", T.IntegerType()).add("conversation_a", _TALK).add("conversation_b", _TALK)
)
CORRUPT = "_corrupt"
WINNERS = ("model_a", "model_b", "tie", "tie (inconsistent)")
REQUIRED = ("question_id", "model_a", "model_b", "winner", "judge", "turn")


def _source_place(row: Column) -> Column:
    """Orders records as their files do: files by path, and in a file by place, however Spark splits it."""
    return F.struct(F.col("_metadata.file_path").alias("file"), row.cast("long").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_judgments(spark: SparkSession, path: str | list[str], format: str = "json") -> DataFrame:
    """The columns of JUDGMENT, `pos` (the record's place, which orders all records) and `problem` (null of a good record).

    `json` is one record a line, plain or compressed; a line that is no such record has the problem `corrupt`, and is kept in
    `record`, as are records with a missing field or an unknown winner (`missing: ...`, `winner`).  `parquet` has the rows'
    own numbers.  Of a JSON file, `pos` is the block it was read in and the count within the task that read it: blocks of a
    file rise with its lines, and a block is read by one task.
    """
    paths = [path] if isinstance(path, str) else path
    if format == "parquet":
        rows = spark.read.schema(JUDGMENT).parquet(*paths).select("*", _source_place(F.col("_metadata.row_index")).alias("pos"), F.lit(None).cast("string").alias("record"))
        parsed = rows.withColumn("pos", F.struct("pos.file", "pos.block", F.lit(0).cast("long").alias("row")))
        corrupt = F.lit(False)
    elif format == "json":
        lines = spark.read.text(paths).select(F.col("value").alias("record"), _source_place(F.col("_metadata.file_block_start")).alias("pos")).where(F.trim("record") != "")
        fields = T.StructType([*JUDGMENT.fields, T.StructField(CORRUPT, T.StringType())])
        read = F.from_json("record", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        parsed = lines.select("record", "pos", F.inline(F.array(read)))  # a generator's: filters on its fields do not parse a line again
        corrupt = F.col(CORRUPT).isNotNull()
    else:
        raise ValueError(f"format {format}: json or parquet")
    missing = reduce(lambda found, c: found.when(F.col(c).isNull(), f"missing: {c}"), REQUIRED, F.when(corrupt, "corrupt"))
    problem = missing.when(~F.col("winner").isin(*WINNERS), "winner")
    return parsed.select(*JUDGMENT.names, "pos", problem.alias("problem"), F.when(problem.isNotNull(), F.col("record")).alias("record"))


def good(judgments: DataFrame) -> DataFrame:
    return judgments.where("problem is null").drop("problem", "record")


def quarantined(judgments: DataFrame) -> DataFrame:
    """file, block, row, problem, record: what can't be used, and where it is."""
    return judgments.where("problem is not null").select("pos.*", "problem", "record")


def problems(judgments: DataFrame) -> DataFrame:
    return judgments.where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
