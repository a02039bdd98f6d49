"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations alone.

Every source has a target number of words and a weight schedule over the run's
time from 0 to 1. The schedule's integral says how much of the target is asked
for by a time; inverting it gives every document the time at which its words
are due. Documents are then sorted by that time over ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.registry import query, table
from marginalia.llm.skew import running_total
from marginalia.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
# Knots (time, weight) of the schedules, dealt to the sources in turn: level, rising, falling and a late peak.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 0.5), (0.75, 2.0), (1.0, 0.5)),
)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of ``sizes`` (source, size): its rank by code point (null last), weight,
    source_size and target. All sizes are shared by weight; a target stops at ``max_epochs`` times its
    source's size and the excess goes to the others, until none is above.

    Sources that stop are those least generous per weight, so after sorting by limit per weight
    they are a prefix: running sums over the source rows (one per source name) find it."""
    held = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = held.withColumn("source_rank", (F.row_number().over(by_name) - 1).cast("bigint")).withColumn(
        "weight", F.element_at(cycle, (F.col("source_rank") % len(weights) + 1).cast("int")).cast("bigint")
    )
    ranked = ranked.withColumn("_limit", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("_limit") / F.col("weight"), "source_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0))).alias("_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_weights"),
    )
    share = F.col("_left").cast("double") / F.col("_weights").cast("double")
    open_ = F.col("_limit").cast("double") > share * F.col("weight").cast("double")
    first_open = F.min(F.when(open_, F.struct(F.col("_limit") / F.col("weight"), F.col("source_rank"), share))).over(everything)
    level = first_open.getField("col3")
    target = F.least(F.col("_limit").cast("double"), level * F.col("weight").cast("double"))
    return ranked.select(
        "source", "source_rank", "weight", "source_size",
        F.coalesce(target, F.col("_limit").cast("double")).alias("target"),
    )


def _segments(knots: Sequence[tuple[float, float]]) -> Column:
    """The pieces of a schedule: start, end, weight at either, and the share of the integral before and within."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    whole, passed, out = sum(areas), 0.0, []
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        if area > 0:
            values = {"t0": t0, "t1": t1, "w0": w0 / whole, "w1": w1 / whole, "a0": passed / whole, "a1": (passed + area) / whole}
            out.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in values.items()]))
            passed += area
    return F.array(*out)


def due_time(share: Column, segments: Column) -> Column:
    """The time by which ``share`` (0 to 1) of a source's demand has arisen: the inverse of the integral."""
    fits = F.filter(segments, lambda s: s["a1"] >= share)
    piece = F.coalesce(F.get(fits, F.lit(0)), F.element_at(segments, -1))

    def inverse(s: Column) -> Column:
        span = s["t1"] - s["t0"]
        slope = (s["w1"] - s["w0"]) / span
        rest = F.greatest(share - s["a0"], F.lit(0.0))
        # w0·x + slope·x²/2 = rest, in the form that stays exact for a slope of nothing
        root = F.sqrt(F.greatest(s["w0"] * s["w0"] + slope * rest * 2.0, F.lit(0.0)))
        return s["t0"] + F.coalesce(F.least(F.try_divide(rest * 2.0, s["w0"] + root), span), F.lit(0.0))

    return F.get(F.transform(F.array(piece), inverse), F.lit(0))


def mix_curriculum(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source; other columns are ignored), sorted by position:
    doc_id, source, digest (of the text), size, source_size, target, taken, epochs (array of taken words per
    pass), position, positions (array of positions per pass).

    A source's documents are lined up by the digest of their id, and its target is cut from that line,
    which starts again when it ends: pass r takes what is left of the target at the document, between
    nothing and the whole. A source thus takes its target to the word, and one document of a source at most is
    taken in part. ``positions`` holds for every pass the due time of the document's first word in it (null: not taken);
    ``position`` is the first of them.

    Null text and text without words: size 0, taken 0. A null source is a source of its own. Repeated
    ids are lined up by size and text digest. Empty input gives no rows. Skew: the line of a source is
    dealt into hash buckets (``running_total``), so a source with a third of all rows is many tasks."""
    sized = cut_lineage(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("digest"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"),
        )
    )
    targets = source_targets(sized.select("source", "size"), weights, max_epochs)
    # The first 15 hex digits, spread over all of bigint.
    key = ((F.conv(F.substring("_order", 1, 15), 16, 10).cast("bigint") - F.lit(2**59)) * 16).cast("bigint")
    lined = running_total(sized, ["source"], key, ["_order", "size", "digest"], "size", "_before")
    right = targets.withColumnRenamed("source", "_source")
    joined = lined.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    demand = F.round("target").cast("bigint")

    def taken_in(r: int) -> Column:
        rest = demand - F.col("source_size") * r - F.col("_before")
        return F.greatest(F.lit(0).cast("bigint"), F.least(rest, F.col("size")))

    pieces = F.array(*[_segments(k) for k in schedules])
    segments = F.element_at(pieces, (F.col("source_rank") % len(schedules) + 1).cast("int"))

    def due_in(r: int) -> Column:
        share = (F.col("_before") + F.col("source_size") * r).cast("double") / F.col("target")
        return F.when(taken_in(r) > 0, F.round(due_time(share, segments), 9))

    out = joined.withColumn("epochs", F.array(*[taken_in(r) for r in range(max_epochs)])).withColumn(
        "taken", F.aggregate("epochs", F.lit(0).cast("bigint"), lambda a, x: a + x)
    )
    out = out.withColumn("positions", F.array(*[due_in(r) for r in range(max_epochs)])).withColumn("position", F.get("positions", F.lit(0)))
    columns = ["doc_id", "source", "digest", "size", "source_size", "target", "taken", "epochs", "position", "positions"]
    return out.orderBy(F.col("position").asc_nulls_last(), "_order").select(*columns)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself with the columns of ``docs``: a document once per pass that takes any of it, cut
    behind the last word taken, n_chars following, sorted by the pass's position. Untaken documents go."""
    rows = mix_curriculum(docs, **options)
    copies = rows.filter("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest2"), F.col("source").alias("_source"),
        F.col("size").alias("_size"), F.explode(F.arrays_zip("epochs", "positions")).alias("_pass"),
    ).select("_id", "_digest2", "_source", "_size", F.col("_pass.epochs").alias("_words"), F.col("_pass.positions").alias("_position"))
    # Rows alike in id, text and source are as many rows of ``copies`` each: one of them meets all.
    once = docs.withColumn("_digest", F.xxhash64("text")).dropDuplicates(["doc_id", "_digest", "source"])
    same = (
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_digest2"))
        & F.col("source").eqNullSafe(F.col("_source"))
    )
    joined = once.join(copies.filter("_words > 0"), same).orderBy("_position", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    parts = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.array_join(F.slice(parts, F.lit(1), (F.col("_words") + lead).cast("int")), "")
    text = F.when(F.col("_words") < F.col("_size"), cut).otherwise(F.col("text"))
    values = {"text": text} | ({"n_chars": F.length(text).cast("bigint")} if "n_chars" in docs.columns else {})
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in docs.columns])


def _sql_schedule() -> str:
    rows = []
    for rank, knots in enumerate(SCHEDULES):
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
        whole, passed = sum(areas), 0.0
        for (a, b), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
            values = (a[0], b[0], a[1] / whole, b[1] / whole, passed / whole, (passed + area) / whole)
            rows.append(f"({rank}, " + ", ".join(f"{v!r}::DOUBLE" for v in values) + ")")
            passed += area
    return ", ".join(rows)


MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR) AS ord FROM documents),
held AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk FROM held),
weighed AS (SELECT *, rk % 3 + 1 AS w, 3 * source_size AS lim FROM ranked),
sums AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0))::DOUBLE
                   / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS share
  FROM weighed WINDOW b AS (ORDER BY lim / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT share AS level FROM sums WHERE lim::DOUBLE > share * w::DOUBLE ORDER BY lim / w, rk LIMIT 1),
targets AS (SELECT source, rk, source_size, coalesce(least(lim::DOUBLE, (SELECT level FROM lev) * w::DOUBLE), lim::DOUBLE) AS target FROM sums),
lined AS (SELECT *, (coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM sized),
joined AS (SELECT l.doc_id, l.size, l.before, t.* EXCLUDE (source), round(t.target)::BIGINT AS demand
  FROM lined l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source),
took AS (SELECT *, greatest(0, least(demand - before, size)) + greatest(0, least(demand - source_size - before, size))
                + greatest(0, least(demand - 2 * source_size - before, size)) AS taken FROM joined),
pieces(sr, t0, t1, w0, w1, a0, a1) AS (VALUES {_sql_schedule()}),
due AS (SELECT k.*, p.*, before::DOUBLE / target - a0 AS rest, (w1 - w0) / (t1 - t0) AS slope
  FROM took k LEFT JOIN pieces p ON k.taken > 0 AND p.sr = k.rk % {len(SCHEDULES)} AND p.a1 >= before::DOUBLE / target
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY a0) = 1)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken > 0 THEN round(t0 + coalesce(least(greatest(rest, 0) * 2
     / nullif(w0 + sqrt(greatest(w0 * w0 + slope * greatest(rest, 0) * 2, 0)), 0), t1 - t0), 0), 9) END AS position
FROM due
"""


@query("op8_mix_curriculum", MIX_SQL)
def op8_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_curriculum(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")
