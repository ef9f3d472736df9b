"""Streams run over all that is there now; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.scoring import ALERTS
from ..functions.numbers import rounded
from ..functions.rules import rules_sql
from ..session import scratch
from ..sources import views as V
from ..streaming import streams
from .registry import query


def _stream(spark, sf_dir, table, columns):
    return streams.source(spark, sf_dir, f"{table}.parquet").selectExpr(*columns)


@query("stream_trips", V.with_views(f", s0 AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM telemetry), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, sample_id) AS k FROM s0) SELECT user_id, count(*) AS n_rows, {rounded('avg(speed)')} AS avg_speed, max(speed) AS max_speed, max(rpm) AS max_rpm FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM telemetry) - INTERVAL 1 HOUR", "telemetry"))
def stream_trips(spark, sf_dir):
    """Sessions that the watermark has closed; those that may still grow are not out yet."""
    out = streams.drained(streams.trips(_stream(spark, sf_dir, "events", V._TELEMETRY), "12 hours"), scratch(spark))
    return out.select("user_id", "n_rows", F.expr(rounded("avg_speed")).alias("avg_speed"), "max_speed", "max_rpm")


@query("stream_alerts", V.with_views(f"SELECT id AS trip_id, user_id, code AS alert_type, severity FROM ({rules_sql(ALERTS, 'trips', 'id', 'user_id')}) r", "trips"))
def stream_alerts(spark, sf_dir):
    trips = _stream(spark, sf_dir, "orders", V._TRIPS).selectExpr("*", f"{V.SCORE} AS score")
    return streams.drained(streams.alert_rows(trips), scratch(spark)).select("trip_id", "user_id", "alert_type", "severity")


@query("stream_kpis", V.with_views(f"SELECT trip_date AS day, count(*) AS n_trips, {rounded('sum(distance_km)', 1)} AS distance, {rounded('sum(fuel_consumed)', 2)} AS fuel FROM trips GROUP BY trip_date HAVING CAST(trip_date AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(CAST(trip_date AS TIMESTAMP)) FROM trips) - INTERVAL 1 DAY", "trips"))
def stream_kpis(spark, sf_dir):
    trips = _stream(spark, sf_dir, "orders", V._TRIPS)
    out = streams.drained(streams.daily(trips), scratch(spark))
    return out.select("day", "n_trips", F.expr(rounded("distance", 1)).alias("distance"), F.expr(rounded("fuel", 2)).alias("fuel"))
