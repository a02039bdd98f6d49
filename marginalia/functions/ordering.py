"""First, top-k and rank within a group, safe for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import cut_lineage

ColumnLike = str | Column


def _cols(items: Sequence[ColumnLike]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in items]


def top_k(
    df: DataFrame,
    by: Sequence[ColumnLike],
    order: Sequence[ColumnLike],
    k: int = 1,
    rank: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of every group. Spark limits each map task to ``k``
    rows per group before the shuffle, so a hot group never travels whole."""
    name = rank or "_rank"
    window = Window.partitionBy(*_cols(by)).orderBy(*_cols(order))
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def rank_within(
    df: DataFrame, by: Sequence[str], order: Sequence[ColumnLike], name: str = "rank"
) -> DataFrame:
    """row_number of every row in its group, for groups of any size.

    The rows are range-partitioned by (group, order); each range is numbered
    alone and shifted by the group's rows in earlier ranges. A boundary can cut
    only one group, so the shift table has fewer rows than there are ranges."""
    by_cols, order_cols = _cols(by), _cols(order)
    part = ordered_ranges(df, [*by_cols, *order_cols])
    shifts = range_shifts(part.groupBy("_range", *by).agg(F.count("*").alias("_n")), by, "_n")
    local = part.withColumn(
        name, F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order_cols))
    )
    joined = join_shifts(local, shifts, by)
    return joined.withColumn(
        name, (F.col(name) + F.coalesce("_shift", F.lit(0))).cast("bigint")
    ).drop("_range", "_shift")


def running_sum(
    df: DataFrame, by: Sequence[str], order: Sequence[ColumnLike], value: str, name: str
) -> DataFrame:
    """Sum of ``value`` over the rows before and including each row, computed
    over ranges as in ``rank_within``; ``order`` must be a total order."""
    by_cols, order_cols = _cols(by), _cols(order)
    part = ordered_ranges(df, [*by_cols, *order_cols])
    shifts = range_shifts(part.groupBy("_range", *by).agg(F.sum(value).alias("_n")), by, "_n")
    window = Window.partitionBy("_range", *by).orderBy(*order_cols)
    rows = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = part.withColumn(name, F.sum(value).over(rows))
    joined = join_shifts(local, shifts, by)
    return joined.withColumn(name, F.col(name) + F.coalesce("_shift", F.lit(0))).drop(
        "_range", "_shift"
    )


def ordered_ranges(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Rows with the number of their range, ranges being ascending in ``keys``
    and of even size. Written out once, so the numbers stay the same however
    often the result is read or a lost executor's part is rebuilt."""
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *keys).withColumn("_range", F.spark_partition_id())
    return cut_lineage(ranged)


def range_shifts(totals: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per range and group, what earlier ranges hold of the group. Groups
    within one range are left out: their shift is nothing."""
    window = Window.partitionBy(*[F.col(c) for c in by]).orderBy("_range")
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return (
        totals.withColumn("_shift", F.sum(value).over(before))
        .filter(F.col("_shift").isNotNull())
        .select("_range", *by, "_shift")
    )


def join_shifts(local: DataFrame, shifts: DataFrame, by: Sequence[str]) -> DataFrame:
    # At most one row per range boundary and group cut by it.
    right = F.broadcast(
        shifts.select(
            F.col("_range").alias("_r"), *[F.col(c).alias(f"_g_{c}") for c in by], "_shift"
        )
    )
    on = F.col("_range") == F.col("_r")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return local.join(right, on, "left").drop("_r", *[f"_g_{c}" for c in by])
