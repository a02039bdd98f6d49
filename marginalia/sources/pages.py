"""Page tables kept in buckets by page, so that what is asked of them page by page needs no shuffle.

Groupings that hold ``page_id`` and joins by it alone read the buckets as they are. A table is dealt once, when it is stored; every later
question about pages costs a scan. A page with a third of all rows would fill one bucket: ``store_by_page`` says so by
the share of the largest page, and such tables stay as they were."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
LARGEST_SHARE = 0.05  # of all rows that one page may hold


def largest_share(df: DataFrame, key: str = "page_id") -> float:
    """The share of rows that the busiest key holds; nothing for an empty table."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    row = counts.agg((F.max("n") / F.sum("n")).alias("share"), F.count("*").alias("keys")).first()
    return float(row["share"] or 0.0) if row["keys"] > 1 else 0.0


def store_by_page(df: DataFrame, name: str, key: str = "page_id", buckets: int = BUCKETS) -> DataFrame:
    """``df`` as a stored table in ``buckets`` by ``key``, sorted within; unchanged where one key holds too much for a bucket.

    Tables that are joined with one another take the same number of buckets. Each is stored under a name of its own in
    the warehouse, until ``drop_stored``. Null keys share a bucket. Columns and rows stay what they are."""
    if largest_share(df, key) > LARGEST_SHARE:
        return df
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex[:12]}"
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def drop_stored(spark: SparkSession, prefix: str) -> int:
    """Drop the tables that ``store_by_page`` made under a name; how many there were."""
    found = [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{prefix}_") and not t.isTemporary]
    for name in found:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return len(found)
