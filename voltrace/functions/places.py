"""The place of every row in an order, counted by partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_place(df: DataFrame, order: list[Column], path: str, name: str = "nth") -> DataFrame:
    """df with the place (from 1) of each row in an order.

    Rows are range-partitioned and sorted; a place is the one in the partition plus the rows of all partitions before. No task sees more
    than its partition, but for one row a partition. The sorted rows are written to path, so that both steps see the same partitions.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows.write.parquet(path)
    rows = df.sparkSession.read.schema(rows.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    parts = parts.select("_part", before.alias("_before"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1
    return rows.join(F.broadcast(parts), "_part").withColumn(name, place.cast("int")).drop("_at", "_part", "_before")
