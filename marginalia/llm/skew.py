"""Ranks and running sums within groups of any size, without a pass through one task.

Rows of a group are dealt into buckets by the leading bits of a hash, numbered
within their bucket, and shifted by what the group's earlier buckets hold. The
buckets follow from the row alone, so a task that is run again deals the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def running_total(
    df: DataFrame, by: Sequence[str], key: Column, ties: Sequence[Column], value: str, name: str,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group that come before this one.

    The order is that of ``key`` (a hash, bigint), then ``ties``; rows alike in
    all of these get either order. ``by`` columns may be null: nulls form one group."""
    width = 2**64 // buckets
    keyed = df.withColumn("_key", key).withColumn(
        "_bucket", F.floor(F.col("_key") / F.lit(float(width))).cast("int")
    )
    totals = keyed.groupBy(*by, "_bucket").agg(F.sum(value).alias("_held"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_bucket").alias("_shift_bucket"),
        F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_shift"),
    )
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy("_key", *ties).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = keyed.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = F.col("_bucket") == F.col("_shift_bucket")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = local.join(shifts, on)
    return joined.withColumn(name, F.col("_shift") + F.col("_local")).drop(
        "_key", "_bucket", "_shift_bucket", "_shift", "_local", *[f"_by_{c}" for c in by]
    )
