"""Tables stored by item: bucketed and sorted, so that what pairs, joins or anti-joins by item moves nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votelens.params import MODES, ORDERS
from votelens.sources.tables import scratch


def store_by_item(df: DataFrame, buckets: int, name: str | None = None, path: str | None = None, key: str = "item_id") -> DataFrame:
    """Writes df in `buckets` buckets of the key, each sorted by it, as a table of the catalog, and reads that.

    Choose one number of buckets for all tables that meet: a multiple of the cluster's cores, so that a bucket fits into a
    task.  Rows are brought together once, here, which gives a file a bucket; an item has few rows in any table, so buckets
    are even.  Without `path` the files go when the application ends.
    """
    spark = df.sparkSession
    name = name or f"by_{key}_{uuid.uuid4().hex}"
    path = path or scratch(spark, name)
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def pending_by_item(items: DataFrame, grades: DataFrame, modes: tuple[str, ...] = MODES, orders: tuple[str, ...] = ORDERS) -> DataFrame:
    """(item, order, mode) without a grade, of tables stored by item: each item meets the list of what it has.

    One row an item instead of one for each of its runs meets the grades, by the item alone.
    """
    done = grades.groupBy("item_id").agg(F.collect_set(F.struct("order_label", "mode")).alias("done"))
    wanted = F.array(*[F.struct(F.lit(o).alias("order_label"), F.lit(m).alias("mode")) for o in orders for m in modes])
    joined = items.select("item_id").join(done, "item_id", "left")
    left = F.when(F.col("done").isNull(), wanted).otherwise(F.array_except(wanted, "done"))
    return joined.select("item_id", F.explode(left).alias("w")).select("item_id", "w.*")


def drop(spark: SparkSession, *tables: str) -> None:
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
