"""Running sums and ranks within groups of any size: ranges of rows are summed where they lie, and only their sums are put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_statistics import same_group
from .stored import stored


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """df with a column name: the sum of value over the rows of a group up to each row, in order.

    Rows are dealt by ranges of (by, order), so that a group of very many rows lies in several tasks. Rows that are equal in
    order come in any order. partitions: the number of ranges, by default that of shuffles.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.withColumn("__v", value).repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each range of a group
    offsets = stored(ranged.groupBy(*by, "__part").agg(F.sum("__v").alias("__sum")).select(*by, "__part", F.coalesce(before, F.lit(0)).alias("__before")), "offsets")
    own = F.sum("__v").over(Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    keys = {k: f"__by_{i}" for i, k in enumerate(by)} | {"__part": "__other_part"}
    j = ranged.withColumn("__own", own).join(offsets.withColumnsRenamed(keys), same_group([*by, "__part"], keys))
    return j.select(*df.columns, (F.col("__before") + F.col("__own")).alias(name))


def rank_within(df: DataFrame, by: list[str], order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """df with a column name: 1 for the first row of its group, and so on."""
    return running_sum(df, by, order, F.lit(1).cast("long"), name, partitions)
