"""Request tables: distinct keys cut into batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.ordering import rank_within

# How many keys a service takes in one request.
SERVICE_LIMITS = {"entities": 100, "titles": 50, "isbns": 40, "dois": 40, "archive_isbns": 15}


def lookup_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Distinct non-null keys in ascending batches of ``size``. The numbering
    runs over ranges, so no task sees all keys; an array holds one batch."""
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    numbered = rank_within(keys, [], [key], "_n")
    batch = F.floor((F.col("_n") - 1) / size).cast("bigint")
    return numbered.groupBy(batch.alias("batch")).agg(F.array_sort(F.collect_list(key)).alias("keys"))
