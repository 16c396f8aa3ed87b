"""Places in the order of large groups: ranges of the order are sorted in parallel, and their sizes are added up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def place_in_group(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with column ``name``: the place, from 1, of a row in its group.

    Rows are dealt by ranges of (group, order), so that a group of any size is many tasks'; a range
    only needs the number of rows of its group in the ranges before it.
    """
    placed = stored(rows.repartitionByRange(F.col(group), *order).withColumn("__part", F.spark_partition_id()), "ordering")
    here = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    counts = placed.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))  # one row a group and range
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    out = placed.withColumn(name, here).join(counts, [group, "__part"])
    return out.withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")
