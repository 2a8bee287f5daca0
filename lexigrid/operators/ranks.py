"""Dense ids over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.sources.store import written

_LOW = (1 << 33) - 1


def dense_ids(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with `name`: 0, 1, ... in the given order.

    Rows are range-partitioned and sorted, written with their place in the partition, and each
    partition's first id comes from the sizes of those before it (a row a partition).
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    placed = written(placed, "ranks")
    part = F.shiftright("__m", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__first"))
    joined = placed.withColumn("__p", part).join(first, "__p")
    return joined.withColumn(name, F.col("__first") + F.col("__m").bitwiseAND(F.lit(_LOW))).drop("__m", "__p", "__first")
