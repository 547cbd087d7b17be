"""Streaming queries, run to completion over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from candor.plans.catalog import r6, register
from candor.session import ensure_checkpoint_dir, tune
from candor.streaming.running import (
    burst_windows,
    bursts,
    first_seen,
    first_seen_exactly,
    read_files,
    run_available,
    running_counters,
)


def _events(spark, d):
    return read_files(tune(spark), d, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@register("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    out = run_available(first_seen(_events(spark, d), ["user_id", "event_type"], "ts", "90 days"))
    return out.select("user_id", "event_type")


@register(
    "stream_running_counters",
    f"""SELECT event_type, count(*)::BIGINT AS n, {r6('sum(value)', 'total')}, {r6('min(value)', '"min"')}, {r6('max(value)', '"max"')}
 FROM events GROUP BY event_type""",
)
def _(spark, d):
    return run_available(running_counters(_events(spark, d), ["event_type"], "value"), "complete")


@register(
    "stream_bursts",
    """WITH w AS (SELECT user_id, date_trunc('day', ts) AS "start", date_trunc('day', ts) + INTERVAL 1 DAY AS "end",
  count(*)::BIGINT AS n FROM events GROUP BY ALL) SELECT user_id, "start"::TIMESTAMP AS "start", "end"::TIMESTAMP AS "end", n FROM w
 WHERE n >= 3 AND "end" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def _(spark, d):
    return run_available(bursts(_events(spark, d), ["user_id"], "ts"))


CHUNKS = 4  # arrivals: events come in this many parts by id, each over the whole span of time


def _by_arrival(spark, d, run):
    """Let the events arrive in parts, run the stream after each, and return what the last run gives.

    Every run takes up where the one before ended, so later parts hold repeats and rows far behind the watermark.
    """
    base = f"{ensure_checkpoint_dir(tune(spark))}/arrivals-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(CHUNKS):
        events.filter(F.pmod("event_id", F.lit(CHUNKS)) == part).write.mode("append").parquet(f"{base}/in")
        out = run(read_files(spark, f"{base}/in", "*.parquet"), base)
    return out


@register(
    "stream_first_seen_exactly",
    f"""SELECT user_id, event_type, event_id FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % {CHUNKS}, ts, event_id) = 1""",
)
def _(spark, d):
    first = lambda stream, base: first_seen_exactly(stream, ["user_id", "event_type"], ["ts", "event_id"], base)
    return _by_arrival(spark, d, first).select("user_id", "event_type", "event_id")


@register(
    "stream_burst_windows",
    f"""WITH e AS (SELECT *, event_id % {CHUNKS} AS part, date_trunc('day', ts) + INTERVAL 1 DAY AS "end" FROM events WHERE ts IS NOT NULL),
 ticks AS (SELECT part, max(ts) AS last FROM e GROUP BY part),
 before AS (SELECT p.part, max(t.last) AS last FROM ticks p LEFT JOIN ticks t ON t.part < p.part GROUP BY p.part)
 SELECT user_id, ("end" - INTERVAL 1 DAY)::TIMESTAMP AS "start", "end"::TIMESTAMP AS "end", count(*)::BIGINT AS n,
 (count(*) FILTER (WHERE "end" + INTERVAL 1 HOUR <= before.last))::BIGINT AS n_late,
 "end" + INTERVAL 1 HOUR <= (SELECT max(ts) FROM e) AS "final"
 FROM e JOIN before USING (part) GROUP BY user_id, "end" HAVING count(*) >= 3""",
)
def _(spark, d):
    return _by_arrival(spark, d, lambda stream, base: burst_windows(stream, ["user_id"], "ts", base))
