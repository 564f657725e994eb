"""Queries of streams over files made from `events`: each run goes on from the checkpoint of the one
before, and the end state must be that of the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import new_path
from ..streaming import events as ev
from ..streaming import state
from .base import query

SLICES = 3
_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _spark(t):
    return t("events").sparkSession


def slices(t):
    """The events in three parts by time; every seventeenth comes one part late."""
    # The table's times are without a zone: they are taken as UTC, whatever the session's zone.
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    e = t("events").withColumn("__micros", micros)
    first, last = e.agg(F.min("__micros"), F.max("__micros")).first()
    place = F.floor(SLICES * (F.col("__micros") - F.lit(first)) / F.lit(last - first + 1))
    e = e.withColumn("__slice", F.least(F.lit(SLICES - 1), place + F.when(F.col("event_id") % 17 == 0, 1).otherwise(0)))
    e = e.withColumn("ts", F.timestamp_micros("__micros")).drop("__micros")
    return [e.filter(F.col("__slice") == k).drop("__slice") for k in range(SLICES)]


@query("""SELECT event_type AS key, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(stddev_pop(value), 4) AS deviation, min(value) AS least, max(value) AS most
FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type""")
def stream_figures(t):
    spark = _spark(t)
    found = state.replayed(spark, slices(t), new_path(spark, "figures"), lambda s: state.figures(s, "event_type", "value", "event_id"), _SCHEMA)
    s = state.summed(found)
    return s.select("key", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("deviation", 4).alias("deviation"), "least", "most")


#: Rows whose hour ended an hour before the latest row of earlier batches are too late.
_LATE = f"""WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
s AS (SELECT e.*, least({SLICES - 1}, CAST(floor({SLICES} * (epoch_us(ts) - lo) / (hi - lo + 1)) AS INT) + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) AS slice, time_bucket(INTERVAL 1 HOUR, ts) AS hour FROM events e, b),
m AS (SELECT k, (SELECT max(ts) - INTERVAL 1 HOUR FROM s WHERE slice < k) AS mark FROM range({SLICES}) r(k)),
k AS (SELECT s.* FROM s JOIN m ON m.k = s.slice WHERE mark IS NULL OR hour + INTERVAL 1 HOUR > mark)"""


@query(f"{_LATE} SELECT CAST(epoch(hour) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY ALL")
def stream_windows(t):
    spark = _spark(t)
    found = state.replayed(spark, slices(t), new_path(spark, "windows"), lambda s: ev.hourly(s, "1 hour"), _SCHEMA)
    s = state.end_state(found, "start", "event_type")
    return s.select(F.unix_seconds("start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT event_id, props AS payload, CAST(strlen(props) AS BIGINT) AS n_bytes FROM events""")
def stream_uploads(t):
    """Messages as a page sends them (a header, a comma, base64), decoded as they come."""
    spark = _spark(t)
    message = F.concat(F.lit("data:audio/wav;base64,"), F.base64(F.encode("props", "utf-8")))
    parts = [s.select("event_id", message.alias("value")) for s in slices(t)]
    found = state.replayed(spark, parts, new_path(spark, "uploads"), lambda s: s.withColumn("content", F.unbase64(F.get(F.split("value", ","), F.lit(1)))).select("event_id", "content"), "event_id long, value string", mode="append")
    return found.select("event_id", F.decode("content", "utf-8").alias("payload"), F.octet_length("content").cast("long").alias("n_bytes"))
