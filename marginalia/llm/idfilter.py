"""A bitmap of fixed size over ids: rows that surely are not in a large id table need no shuffle to find out."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 1 << 26  # bits: 8 MB, whatever the number of ids
_BUCKET = 1 << 15


def _slot(key: Column, digest: bool) -> Column:
    return F.pmod(key if digest else F.xxhash64(key), F.lit(SLOTS))


def id_bitmap(ids: DataFrame, column: str, digest: bool = False) -> np.ndarray:
    """One bit per slot that some id of the table falls in. More ids than slots fill it: then it keeps all rows.
    ``digest``: the ids are evenly spread numbers themselves."""
    slots = ids.select(_slot(F.col(column), digest).alias("s"))
    rows = (
        slots.groupBy((F.col("s") / _BUCKET).cast("int").alias("k"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("s"))).alias("bits"))
        .toLocalIterator()
    )
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in rows:
        out[r["k"] * (_BUCKET // 8) : (r["k"] + 1) * (_BUCKET // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


class Bitmaps:
    """Bitmaps on their way to the tasks: few bits are set in most, so they travel and lie on disk compressed."""

    def __init__(self, *held: np.ndarray | None):
        self.held = held

    def __reduce__(self):
        return _unpacked, tuple(None if b is None else zlib.compress(b, 1) for b in self.held)


def _unpacked(*held: bytes | None) -> Bitmaps:
    return Bitmaps(*(None if b is None else np.frombuffer(zlib.decompress(b), np.uint8) for b in held))


def _bits(bitmap: np.ndarray, k: np.ndarray, p: np.ndarray) -> np.ndarray:
    return ((bitmap[k * (_BUCKET // 8) + p // 8] >> (p % 8).astype(np.uint8)) & 1) == 1


def digests_in(bitmap: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """For a bitmap over digests: False only for those that are not in the table behind it."""
    slot = (digests.view(np.uint64) & np.uint64(SLOTS - 1)).astype(np.int64)
    # The column function counts places within a bucket from one.
    return _bits(bitmap, slot // _BUCKET, np.where(slot > 0, (slot - 1) % _BUCKET, 0))


def slot_columns(key: Column) -> list[Column]:
    """What a task needs of a key to look it up itself, as columns ``_bucket`` and ``_position``."""
    slot = _slot(key, False)
    return [(slot / _BUCKET).cast("int").alias("_bucket"), F.bitmap_bit_position(slot).alias("_position")]


def slots_in(bitmap: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """For a batch with ``slot_columns``: False only for keys that are not in the table behind the bitmap."""
    bucket, position = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_bucket", "_position"))
    return _bits(bitmap, bucket, position)


def maybe_in(bitmap: np.ndarray, key: Column) -> Column:
    """False only for keys that are not in the table behind the bitmap. Only the key goes through Python."""
    sent = SparkSession.active().sparkContext.broadcast(Bitmaps(bitmap))

    @F.pandas_udf("boolean")
    def hit(bucket: pd.Series, position: pd.Series) -> pd.Series:
        return pd.Series(_bits(sent.value.held[0], bucket.to_numpy(np.int64), position.to_numpy(np.int64)))

    slot = _slot(key, False)
    return hit((slot / _BUCKET).cast("int"), F.bitmap_bit_position(slot))
