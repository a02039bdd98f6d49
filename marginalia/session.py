"""Session settings and the shared scratch folder, in one place."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marginalia", cpus: str = "*", **conf: str) -> SparkSession:
    """A session with the settings every job here assumes. On a cluster the
    submit-time configuration wins; this is for tests and single machines."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables: the cluster's
    ``spark.checkpoint.dir`` if it names one, else the context's checkpoint
    folder. Where neither exists, a local session gets a temporary folder; on a
    cluster no machine's own folder would do, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if named is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            named = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to reliable storage, so that a lost executor costs a re-read
    and not a replay of every earlier round."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def deal(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to that many parts, which are not merged again; as they are for None."""
    return df.repartition(parts, *keys) if parts else df
