"""Where results go. An output of several tables is written to a folder of its own run; a row in the manifest, written
last, makes it the current one. A run that fails leaves no row, and readers keep what was there before."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number bigint, run string, tables array<string>"


def write_committed(frames: dict[str, DataFrame], path: str, writer: Callable = lambda df: df.write) -> None:
    """Write all ``frames``, then the manifest row that names their run. Each append of one row is one file, which is there
    whole or not at all; of two runs with the same number the greater name counts."""
    spark = next(iter(frames.values())).sparkSession
    manifest, run = f"{path}/manifest", uuid.uuid4().hex
    for name, frame in frames.items():
        writer(frame).parquet(f"{path}/runs/{run}/{name}")
    spark.createDataFrame([], MANIFEST).write.mode("append").parquet(manifest)
    last = spark.read.schema(MANIFEST).parquet(manifest).agg(F.max("number")).first()[0] or 0
    spark.createDataFrame([(last + 1, run, list(frames))], MANIFEST).coalesce(1).write.mode("append").parquet(manifest)


def read_committed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last run that came to its end; none if none did."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").agg(F.max(F.struct("number", "run", "tables")).alias("m")).first()
    if rows["m"] is None:
        return {}
    return {name: spark.read.parquet(f"{path}/runs/{rows['m']['run']}/{name}") for name in rows["m"]["tables"]}


def write_bands(bands: DataFrame, path: str) -> None:
    """Section results in article order. Pages are spread over ranges, so that
    a very long page is several files and the files read in order."""
    ordered = bands.repartitionByRange("page_id", "section_ord").sortWithinPartitions("page_id", "section_ord")
    write_committed({"bands": ordered}, path)


def write_census(rows: DataFrame, per_holder: DataFrame, control: DataFrame, queried: str, path: str) -> None:
    """A census: item rows, counts per holder, and one summary row, each under
    the day it was asked. All three become current at once."""
    day = F.lit(queried).alias("queried")
    items = rows.agg(F.countDistinct("qid").alias("items"), F.count("*").alias("rows"))
    summary = items.crossJoin(F.broadcast(control.select(F.col("n").alias("subclass_only"))))
    frames = {"rows": rows, "holders": per_holder, "summary": summary}
    write_committed({k: df.select("*", day) for k, df in frames.items()}, path, lambda df: df.write.partitionBy("queried"))
