"""Dense positions, from 0, in a total order; no window over all rows and no single partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import checkpoint


def with_positions(df: DataFrame, order_by: list[str | Column], name: str = "pos") -> DataFrame:
    """``df`` sorted by a total order, with its positions.

    Rows are range-partitioned and sorted; a row's id then holds its partition and its place there, and the sizes of
    partitions, one small row each, give every partition's offset.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by)
    ordered = checkpoint(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # a row for each partition
    placed = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).select(name, *df.columns)
