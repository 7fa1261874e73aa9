"""Neighbours in a total order over a whole table, without a window over all of it or over a large group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def with_next(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """df with `next`: `value` of the next row of the same `by` in ascending `order` (nulls first), null for the last; and `is_first` of its `by`.

    Rows are dealt by ranges of (by, order), so that a group of any size is spread; what passes from range to range are the rims, a row a range.
    Rows should differ in (by, order): ties are ordered by chance.
    """
    keys = [*by, *order]
    ranged = written(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("_range", F.spark_partition_id()), "ranged")
    inner = Window.partitionBy("_range").orderBy(*keys)
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    at = F.struct(group.alias("g"), F.col(value).alias("v"))
    placed = ranged.select("*", group.alias("_g"), F.lead(at).over(inner).alias("_after"), F.lag(at).over(inner).alias("_before"))
    rims = ranged.groupBy("_range").agg(F.min(F.struct(*[F.col(c) for c in keys], at.alias("at"))).alias("low"), F.max(F.struct(*[F.col(c) for c in keys], at.alias("at"))).alias("high"))
    chain = Window.partitionBy(F.lit(0)).orderBy("_range")  # as many rows as there are ranges
    rims = rims.select("_range", F.lead("low.at").over(chain).alias("_low"), F.lag("high.at").over(chain).alias("_high"))
    met = placed.join(F.broadcast(rims), "_range", "left")
    after, before = F.coalesce("_after", "_low"), F.coalesce("_before", "_high")
    found = met.withColumn("next", F.when(after.g.eqNullSafe(F.col("_g")), after.v)).withColumn("is_first", ~F.coalesce(before.g.eqNullSafe(F.col("_g")), F.lit(False)))
    return found.drop("_range", "_g", "_after", "_before", "_low", "_high")
