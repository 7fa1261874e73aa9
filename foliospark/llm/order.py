"""The next row of a total order over a whole table, without a window over all of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism


def with_guests(df: DataFrame, id_col: str, tie: Column) -> DataFrame:
    """df, dealt into ranges of falling id_col, plus the row that follows each range, as a guest at its end.

    Adds _bucket, _guest and _n (place in the bucket from 1): (_bucket, _n) identifies a row, and the row after it in
    the bucket is its successor in the order (id_col descending with nulls last, then `tie`); the successor of the last
    row of all is the first. Ranges come from quantiles of the ids: as many numbers as there are ranges, some four a
    shuffle partition, pass through the driver; a row looks at about twice the square root of their number, and crosses one exchange.
    Rows with one id stay together, whatever their number.
    """
    n = max(16, 4 * parallelism(df.sparkSession))
    cuts = sorted(set(df.agg(F.percentile_approx(id_col, [k / n for k in range(1, n)], 100 * n).alias("q")).first().q or []))
    placed = df.select("*", F.when(F.col(id_col).isNull(), 0).otherwise(_below(cuts, F.col(id_col)) + 1).alias("_bucket"))
    heads = {r._bucket: r.head for r in placed.groupBy("_bucket").agg(F.max(id_col).alias("head")).collect()}
    goes_to = F.lit(None).cast("int")
    if heads:
        order = sorted(heads)
        # a range's head is the guest of the range above it; the head of the highest follows the lowest
        host = {b: order[(k + 1) % len(order)] for k, b in enumerate(order)}
        known = F.array(*[F.struct(F.lit(heads.get(b)).cast(df.schema[id_col].dataType).alias("head"), F.lit(host.get(b)).cast("int").alias("host")) for b in range(order[-1] + 1)])
        own = F.get(known, F.col("_bucket"))
        goes_to = F.when(own.head.eqNullSafe(F.col(id_col)), own.host)
    places = F.array_compact(F.array(F.struct(F.col("_bucket").alias("_b"), F.lit(False).alias("_guest")), F.when(goes_to.isNotNull(), F.struct(goes_to.alias("_b"), F.lit(True).alias("_guest")))))
    dealt = placed.select("*", F.inline(places)).drop("_bucket").withColumnRenamed("_b", "_bucket")
    window = Window.partitionBy("_bucket").orderBy("_guest", F.col(id_col).desc_nulls_last(), tie)
    return dealt.withColumn("_n", F.row_number().over(window))


def _below(cuts: list, value: Column) -> Column:
    """How many of the sorted cuts are not above the value: the block by its first cut, then the place in the block."""
    if not cuts:
        return F.lit(0)
    size = max(1, math.isqrt(len(cuts)))
    count = lambda values: F.size(F.filter(values, lambda q: q <= value))
    block = F.greatest(count(F.array(*map(F.lit, cuts[::size]))) - 1, F.lit(0))
    return block * size + count(F.slice(F.array(*map(F.lit, cuts)), block * size + 1, F.lit(size)))


def following(column: str) -> Column:
    """The value of `column` in the successor of a row of with_guests."""
    return F.lead(column).over(Window.partitionBy("_bucket").orderBy("_n"))
