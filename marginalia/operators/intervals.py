"""Chains of intervals: a row may start a quiet interval, unless it falls into
one itself; rows inside an interval are held back.

The state runs through all rows of a key in time order. To split a busy key,
all rows are range-partitioned by (key, time). Only a key that fills whole
ranges needs more than its neighbours: in each of these ranges every row that
may start an interval is followed to the end of the last interval it leads to
there, and from that end to the first starting row of a later range. These
jumps are doubled in rounds of joins, so that the rows which really start the
first interval of their range are known after as many rounds as the number of
ranges has binary digits. What an interval reaches into a range with is one
number a range; that alone goes to the second pass, which flags the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.ordering import ordered_ranges
from marginalia.session import cut_lineage

_NONE = np.iinfo(np.int64).min


def interval_chain(rows: DataFrame) -> DataFrame:
    """``rows``: key (string), at (bigint), id (bigint), length (bigint, null
    for a row that starts nothing). Adds ``held`` (inside an interval) and
    ``until`` (end of the interval the row starts, null if none)."""
    rows = rows.select("key", "at", "id", "length")
    ranged = ordered_ranges(rows, [F.col("key"), F.col("at"), F.col("id")]).sortWithinPartitions(
        "key", "at", "id"
    )
    # Two rows a range, whatever the ranges hold: its first and last key, and what reaches into it.
    bounds = ranged.groupBy("_range").agg(F.min(F.struct("key"))["key"].alias("first"), F.max(F.struct("key"))["key"].alias("last")).collect()
    carry = _carried(ranged, sorted(bounds, key=lambda r: r["_range"]))
    return ranged.mapInPandas(
        _flags(carry), "key string, at bigint, id bigint, length bigint, held boolean, until bigint"
    )


def _walk(pdf: pd.DataFrame, key: str | None, until: int):
    """One pass over a sorted batch: per row held and until; the closing state.
    Jumps from interval to interval with a binary search."""
    keys = pdf["key"].to_numpy()
    at = pdf["at"].to_numpy(np.int64)
    length = pdf["length"].to_numpy(np.float64, na_value=np.nan)
    held = np.zeros(len(pdf), bool)
    ends = np.full(len(pdf), _NONE, np.int64)
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(pdf)]):
        if hi == lo:
            continue
        if keys[lo] != key:
            key, until = keys[lo], _NONE
        starts = lo + np.flatnonzero(~np.isnan(length[lo:hi]))
        position = lo
        while True:
            free = lo + int(np.searchsorted(at[lo:hi], until, "left")) if until != _NONE else position
            held[position:free] = True
            position = max(position, free)
            nxt = int(np.searchsorted(starts, position, "left"))
            if nxt >= len(starts):
                break
            position = int(starts[nxt])
            until = int(at[position]) + int(length[position])
            ends[position] = until
            position += 1
    return held, ends, key, until


def _chain_ends(at: np.ndarray, until: np.ndarray) -> np.ndarray:
    """For every row that may start an interval, where the last interval ends
    if the first free row is this one: each leads to the first row not inside
    it, and following these by doubling comes to the last."""
    n = len(at)
    after = np.maximum(np.searchsorted(at, until, "left"), np.arange(1, n + 1))
    last = np.where(after < n, after, np.arange(n))
    while True:
        further = last[last]
        if (further == last).all():
            return until[last]
        last = further


def _exits(plan: dict[int, bool]):
    """Starting rows of a range with the end of the last interval they lead to: all of them where ``plan`` says so (a range within
    one key), else the first one of the range's last key, which goes on after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts or (number := parts[0].column("_range")[0].as_py()) not in plan:
            return
        rows = pa.Table.from_batches(parts)
        last = rows["key"][len(rows) - 1].as_py()
        begin = 0
        if not plan[number]:
            other = np.array([k != last for k in rows["key"].to_pylist()])
            begin = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        length = rows["length"].to_numpy().astype(np.float64)
        starts = begin + np.flatnonzero(~np.isnan(length[begin:]))
        at = rows["at"].to_numpy()[starts]
        fin = _chain_ends(at, at + length[starts].astype(np.int64)) if len(at) else at
        if not plan[number]:
            starts, at, fin = starts[:1], at[:1], fin[:1]
        columns = [pa.array(["-" if last is None else f"={last}"] * len(at), pa.string()), *(pa.array(x, pa.int64()) for x in (np.full(len(at), number), (number << 40) + starts, at, fin))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "range", "node", "at", "fin"])

    return run


def _next_starts(exits: DataFrame) -> DataFrame:
    """``exits`` with ``to`` and ``to_range``: the first of them, in a later range of the key, that starts at or after ``fin``."""
    start = F.struct(F.col("at").alias("t"), "node", "range")
    looking = exits.select("key", F.col("fin").alias("t"), F.lit(0).alias("kind"), "range", "node", "at", "fin", F.lit(None).cast("struct<t:bigint,node:bigint,range:bigint>").alias("start"))
    there = exits.select("key", F.col("at").alias("t"), F.lit(1).alias("kind"), "range", "node", "at", "fin", start.alias("start"))
    ordered = ordered_ranges(looking.unionByName(there), [F.col(c) for c in ("key", "t", "kind", "node")])
    firsts = ordered.groupBy("_range", "key").agg(F.min("start").alias("first"))
    later = Window.partitionBy("key").orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    after = firsts.withColumn("later", F.min("first").over(later)).filter("later IS NOT NULL")
    onward = Window.partitionBy("_range", "key").orderBy(F.desc("t"), F.desc("kind"), F.desc("node")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ordered.withColumn("near", F.last("start", ignorenulls=True).over(onward)).filter("kind = 0")
    joined = found.join(after.select("_range", "key", "later"), ["_range", "key"], "left")
    to = F.coalesce("near", "later")
    return joined.select("key", "range", "node", "at", "fin", to["node"].alias("to"), to["range"].alias("to_range"))


def _carried(ranged: DataFrame, bounds: list) -> dict[int, tuple[str, int]]:
    """For each range that an interval of its first key reaches: that key and
    the interval's end. At most one entry a range."""
    plan: dict[int, bool] = {}
    final: dict[str | None, int] = {}  # of the keys that are cut, the range they end in
    for k, r in enumerate(bounds):
        before = k > 0 and bounds[k - 1]["last"] == r["first"]
        if before:
            final[r["first"]] = r["_range"]
        if k + 1 < len(bounds) and bounds[k + 1]["first"] == r["last"]:
            plan[r["_range"]] = before and r["first"] == r["last"]
    if not plan:
        return {}
    exits = cut_lineage(ranged.mapInArrow(_exits(plan), "key string, range bigint, node bigint, at bigint, fin bigint"))
    jumps = cut_lineage(_next_starts(exits))
    chosen = exits.groupBy("key").agg(F.min("node").alias("node")).select("node")
    step = cut_lineage(jumps.filter("to IS NOT NULL").select("node", "to"))
    reach = 1
    while reach < len(bounds) and not step.isEmpty():
        chosen = cut_lineage(chosen.unionByName(chosen.join(step, "node").select(F.col("to").alias("node"))).distinct())
        further = step.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        step = cut_lineage(step.join(further, "to").select("node", F.col("beyond").alias("to")))
        reach *= 2
    carry: dict[int, tuple[str, int]] = {}
    numbers = [r["_range"] for r in bounds]
    for r in jumps.join(chosen, "node").select("key", "range", "fin", "to_range").toLocalIterator():
        key = r["key"][1:] if r["key"] != "-" else None
        upto = final[key] if r["to_range"] is None else r["to_range"]
        carry.update({n: (key, r["fin"]) for n in numbers if r["range"] < n <= upto})
    return carry


def _flags(carry: dict[int, tuple[str, int]]):
    def flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = key = None
        until = _NONE
        for pdf in batches:
            if pdf.empty:
                continue
            if number is None:
                number = int(pdf["_range"].iloc[0])
                key, until = carry.get(number, (None, _NONE))
            held, ends, key, until = _walk(pdf, key, until)
            out = pdf[["key", "at", "id", "length"]].copy()
            out["held"] = held
            out["until"] = pd.array(ends, dtype="Int64")
            out.loc[ends == _NONE, "until"] = pd.NA
            yield out

    return flag
