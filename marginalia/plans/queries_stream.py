"""Streams over the given tables, run to the end of what is there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from marginalia.plans.catalog import query
from marginalia.plans.views import sql_over, table, view, with_views
from marginalia.session import cut_lineage, scratch_path
from marginalia.streaming import jobs as S
from marginalia.streaming.keyed import with_keyed_state
from marginalia.streaming.runner import file_stream, run_updates, start_appends, time_slices

REQ = with_views("v_requests")


def requests(df):
    """The request view over events, for tables and streams alike."""
    return df.select(
        "event_id", F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"),
        F.when(F.col("value") < 250, F.floor(F.col("value") * 10)).alias("retry_after_s"),
        F.col("value").alias("duration_s"),
    )


STEPS = 4  # files, and so steps, that a registered stream is fed in


def _log(spark, name, df, ts, **end):
    """A table as a stream of files in order of time, ended by a row a year after all others, so that nothing waits: of nulls but
    for ``end``."""
    path = time_slices(df, ts, STEPS, scratch_path(spark, name))
    last = {ts: F.col(ts) + F.expr("INTERVAL 1 YEAR"), **{c: F.lit(v) for c, v in end.items()}}
    row = [last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    df.sparkSession.read.schema(df.schema).parquet(path).agg(F.max(ts).alias(ts)).select(*row).coalesce(1).write.mode("append").parquet(path)
    return file_stream(spark, path, df.schema, files_per_trigger=1)


@query(
    "stream_citation_coverage",
    """WITH c AS (SELECT *, l_returnflag <> 'R' AS has_isbn, l_suppkey % 10 > 0 AND (l_partkey + l_suppkey) % 10 <= 6 AS answered FROM lineitem)
SELECT l_orderkey AS page_id, l_linenumber AS section_ord, count(*) AS total,
  count(*) FILTER (WHERE has_isbn AND answered AND p_size % 4 < 2) AS open, count(*) FILTER (WHERE has_isbn AND answered AND p_size % 4 = 2) AS cataloged,
  count(*) FILTER (WHERE (NOT has_isbn OR answered AND p_size % 4 = 3) AND l_linestatus = 'O') AS linked,
  count(*) FILTER (WHERE has_isbn AND NOT answered) AS unchecked, true AS searched
FROM c JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""",
)
def stream_citation_coverage(spark, sf):
    """Every line is a cite, asked for when it ships; nine in ten lookups are answered, up to nine hours later, in time up to six."""
    lines = table(spark, sf, "lineitem")
    request = F.concat_ws("-", *[F.col(c).cast("string") for c in lines.columns])
    cites = lines.select(
        request.alias("request"), F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("section_ord"),
        F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("isbn"), (F.col("l_linestatus") == "O").alias("has_link"),
        F.col("l_shipdate").cast("timestamp").alias("cited_at"),
    )
    hours = (F.col("l_partkey") + F.col("l_suppkey")) % 10
    size = F.col("p_size") % 4
    answers = lines.filter("l_returnflag <> 'R' AND l_suppkey % 10 > 0").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).select(
        request.alias("request"), F.when(size == 0, "full").when(size == 1, "borrow").when(size == 2, "catalog").alias("access"),
        (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(hours=hours.cast("int"))).alias("answered_at"),
    ).dropDuplicates(["request"])
    # A side whose key is null is left out of the join before its time is looked at.
    told = _log(spark, "answers", answers, "answered_at", request="end")
    out = S.stream_citation_coverage(
        _log(spark, "cites", cites, "cited_at"), told, scratch_path(spark, "settled"), scratch_path(spark, "settled-state")
    )
    return out.filter("page_id IS NOT NULL")


def _chain(armers: str, length: str) -> str:
    """Intervals one after the other: the first row, then the first at or
    after its end, and so on."""
    return f"""e AS (SELECT host, event_id, epoch_us(ts) AS tm, epoch_us(ts) + {length} AS fin,
  row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS rn FROM v_requests WHERE {armers}),
nx AS (SELECT e.*, (SELECT min(f.rn) FROM e f WHERE f.host = e.host AND f.rn > e.rn AND f.tm >= e.fin) AS nxt FROM e),
ch AS (SELECT * FROM nx WHERE rn = 1 UNION ALL SELECT nx.* FROM ch JOIN nx ON nx.host = ch.host AND nx.rn = ch.nxt)"""


REST = "least(coalesce(retry_after_s, 60), 900) * 1000000"


@query(
    "suppress_cooloff",
    f"""{REQ.replace('WITH', 'WITH RECURSIVE', 1)}, {_chain('status = 429', REST)}
SELECT q.event_id, CAST(q.host AS VARCHAR) AS host, EXISTS (SELECT 1 FROM ch WHERE ch.host = q.host AND (ch.tm, ch.event_id) < (epoch_us(q.ts), q.event_id) AND epoch_us(q.ts) < ch.fin) AS suppressed,
  EXISTS (SELECT 1 FROM ch WHERE ch.event_id = q.event_id) AS arms FROM v_requests q""",
)
def suppress_cooloff(spark, sf):
    return S.suppress_cooloff(requests(table(spark, sf, "events")))


@query(
    "stream_suppress_cooloff",
    f"""{REQ.replace('WITH', 'WITH RECURSIVE', 1)}, {_chain('status = 429', REST)}
SELECT q.event_id, EXISTS (SELECT 1 FROM ch WHERE ch.host = q.host AND (ch.tm, ch.event_id) < (epoch_us(q.ts), q.event_id) AND epoch_us(q.ts) < ch.fin) AS suppressed, false AS late FROM v_requests q""",
)
def stream_suppress_cooloff(spark, sf):
    out, state, checkpoint = (scratch_path(spark, n) for n in ("cooloff", "cooloff-open", "cooloff-state"))
    S.run_cooloff(requests(file_stream(spark, f"{sf}/events.parquet")), out, state, checkpoint)
    return spark.read.parquet(out).select(F.col("id").alias("event_id"), F.col("held").alias("suppressed"), "late")


@query(
    "ttl_first_seen",
    f"""{REQ.replace('WITH', 'WITH RECURSIVE', 1)}, {_chain('true', '21600000000')}
SELECT event_id, CAST(host AS VARCHAR) AS key, event_id NOT IN (SELECT event_id FROM ch) AS hit FROM v_requests""",
)
def ttl_first_seen(spark, sf):
    answers = view(spark, sf, "v_requests").withColumnRenamed("host", "key")
    return S.ttl_first_seen(answers, 6 * 3600)


@query(
    "stream_ttl_first_seen",
    f"""{REQ.replace('WITH', 'WITH RECURSIVE', 1)}, {_chain('true', '21600000000')}
SELECT event_id, CAST(host AS VARCHAR) AS key, event_id NOT IN (SELECT event_id FROM ch) AS hit, false AS late FROM v_requests""",
)
def stream_ttl_first_seen(spark, sf):
    answers = view(spark, sf, "v_requests").select("event_id", F.col("host").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    out, checkpoint = scratch_path(spark, "seen"), scratch_path(spark, "seen-state")
    stream = S.stream_ttl_first_seen(_log(spark, "answers", answers, "ts"), 6 * 3600)
    with_keyed_state(spark, lambda: start_appends(stream, out, checkpoint).awaitTermination())
    return spark.read.schema(stream.schema).parquet(out).filter("event_id IS NOT NULL").drop("step")


RENDERS = """SELECT user_id AS title, CASE WHEN event_type = 'signup' THEN 'old' ELSE 'new' END AS build, ts, event_type <> 'error' AS complete, event_id AS render FROM events"""


@query(
    "latest_render",
    f"""WITH r AS ({RENDERS}) SELECT title, arg_max(complete, (ts, complete, render)) AS complete, arg_max(render, (ts, complete, render)) AS render FROM r WHERE build = 'new' GROUP BY title""",
)
def latest_render(spark, sf):
    """Through the stream: closed days are written and leave the state; the table merged from them shows every title."""
    events = table(spark, sf, "events")
    renders = events.select(
        F.col("user_id").alias("title"), F.when(F.col("event_type") == "signup", "old").otherwise("new").alias("build"),
        F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("complete"), F.col("event_id").alias("render"),
    )
    log = _log(spark, "renders", renders, "ts").withColumn("build", F.coalesce("build", F.lit("new")))
    out = scratch_path(spark, "closed")
    stream = S.settled_renders(log, "new")
    start_appends(stream, out, scratch_path(spark, "closed-state")).awaitTermination()
    closed = spark.read.schema(stream.schema).parquet(out).filter("title IS NOT NULL")
    return S.latest_render(closed, "new").drop("ts")


@query(
    "due_for_refresh",
    f"""WITH RECURSIVE {REQ.removeprefix('WITH ')}, {_chain('status = 429', REST)}, r AS ({RENDERS}),
cur AS (SELECT title, arg_max(complete, (ts, complete, render)) AS complete, arg_max(render, (ts, complete, render)) AS render FROM r WHERE build = 'new' GROUP BY title),
asks AS (SELECT unnest([0, 300, 600, 900]) AS after), last AS (SELECT max(epoch_us(ts)) AS at FROM v_requests)
SELECT CAST(after AS BIGINT) AS after, title, render FROM asks, cur WHERE NOT complete
  AND NOT EXISTS (SELECT 1 FROM ch, last WHERE ch.fin > last.at + after * 1000000)""",
)
def due_for_refresh(spark, sf):
    """Which thin renders are due, asked at the end of the log and at some times after it: none while a host still cools."""
    events = table(spark, sf, "events")
    renders = events.select(
        F.col("user_id").alias("title"), F.when(F.col("event_type") == "signup", "old").otherwise("new").alias("build"),
        F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("complete"), F.col("event_id").alias("render"),
    )
    current = cut_lineage(S.latest_render(renders, "new"))
    open_ = cut_lineage(S.open_intervals(requests(events)))
    out = [S.due_for_refresh(current, open_.filter(F.col("left_s") > after)).select(F.lit(after).cast("bigint").alias("after"), "title", "render") for after in (0, 300, 600, 900)]
    return reduce(lambda a, b: a.unionByName(b), out)


@query(
    "windowed_request_load",
    f"""{REQ} SELECT epoch(time_bucket(INTERVAL 10 MINUTES, ts))::BIGINT AS window_start, host, count(*) AS requests, count(*) FILTER (WHERE status = 429) AS refusals, max(duration_s) AS slowest
FROM v_requests GROUP BY 1, 2""",
)
def windowed_request_load(spark, sf):
    stream = S.windowed_request_load(requests(file_stream(spark, f"{sf}/events.parquet")))
    return run_updates(stream, ["window_start", "host"], "load").withColumn("window_start", F.unix_timestamp("window_start"))


@query(
    "sliding_request_load",
    f"""{REQ}, s AS (SELECT *, unnest([0, 1, 2]) AS k FROM v_requests)
SELECT epoch(time_bucket(INTERVAL 10 MINUTES, ts))::BIGINT - 600 * k AS window_start, host, count(*) AS requests, count(*) FILTER (WHERE status = 429) AS refusals, max(duration_s) AS slowest
FROM s GROUP BY 1, 2""",
)
def sliding_request_load(spark, sf):
    rows = S.windowed_request_load(requests(table(spark, sf, "events")), "30 minutes", "10 minutes")
    return rows.withColumn("window_start", F.unix_timestamp("window_start"))
