"""Relational questions about trips: latest trips, indicators, filters, context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import ratio, rounded

LATEST = ["trip_date", "id"]
TRIP_COLUMNS = "id user_id trip_date distance_km avg_speed_kmph max_speed max_rpm fuel_consumed brake_events steering_angle angular_velocity acceleration gear_position tire_pressure engine_load throttle_position brake_pressure trip_duration score".split()
REQUIRED = "distance_km avg_speed_kmph max_speed max_rpm fuel_consumed brake_events steering_angle angular_velocity acceleration gear_position tire_pressure engine_load throttle_position trip_duration".split()


def latest(df: DataFrame, n: int, key: str = "user_id", order: list[str] = LATEST) -> DataFrame:
    """The n newest rows of each key, with their rank; Spark cuts each task's groups before the shuffle."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n)


def valid(trips: DataFrame) -> DataFrame:
    return trips.filter("distance_km > 0 AND avg_speed_kmph > 0 AND max_rpm IS NOT NULL")


def open_alerts(alerts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    return alerts.filter(~F.col("resolved") & (F.col("ts") >= since)).groupBy("user_id").agg(F.count("*").alias("open_alerts"))


def latest_alerts(alerts: DataFrame, n: int = 5) -> DataFrame:
    return latest(alerts.filter(~F.col("resolved")), n, order=["ts", "trip_id", "alert_type"])


def chat_context(trips: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """Each user's vehicle and n newest trips, one row a trip."""
    own = latest(trips, n).select("user_id", "rank", F.col("id").alias("trip_id"), "distance_km", "avg_speed_kmph")
    return users.select(F.col("id").alias("user_id"), "vehicle_number").join(own, "user_id", "left")


def user_stats(trips: DataFrame) -> DataFrame:
    load = "CASE WHEN coalesce(avg(engine_load), 0e0) = 0e0 THEN 5e1 ELSE " + rounded("avg(engine_load)") + " END"
    return trips.groupBy("user_id").agg(F.lit(15.0).alias("avg_fuel_efficiency"), F.expr(load).alias("avg_engine_load"), F.count_if(F.col("distance_km") > 0).alias("total_trips"))


def user_efficiency(trips: DataFrame, users: DataFrame, n: int = 10, default: float = 12.0) -> DataFrame:
    """Mean km per litre over the n newest trips that used fuel; default without any."""
    own = latest(trips.filter("fuel_consumed > 0"), n).groupBy("user_id").agg(F.expr(rounded("avg(distance_km / fuel_consumed)")).alias("km_per_l"))
    return users.select(F.col("id").alias("user_id")).join(own, "user_id", "left").select("user_id", F.coalesce("km_per_l", F.lit(default)).alias("km_per_l"))


def indicators(trips: DataFrame) -> DataFrame:
    mean = lambda e: F.expr(rounded(f"coalesce({e}, 0e0)", 1))
    return trips.agg(mean("sum(distance_km)").alias("total_distance"), mean("avg(avg_speed_kmph)").alias("mean_speed"), mean("sum(fuel_consumed)").alias("total_fuel"), F.count("*").alias("n_trips"))


def in_range(df: DataFrame, since: str | None = None, until: str | None = None, distance: tuple[float, float] = (0, 0), speed: tuple[float, float] = (0, 0)) -> DataFrame:
    """Rows within the bounds; a bound that is None or 0 is open, `until` includes its day."""
    tests = [(since, F.col("trip_date") >= F.lit(since).cast("date")), (until, F.col("trip_date") <= F.lit(until).cast("date"))]
    for name, (low, high) in (("distance_km", distance), ("avg_speed_kmph", speed)):
        tests += [(low, F.col(name) >= low), (high, F.col(name) <= high)]
    for given, test in tests:
        if given:
            df = df.filter(test)
    return df


def efficiency(trips: DataFrame) -> DataFrame:
    return trips.select("id", F.expr(rounded(ratio("distance_km", "fuel_consumed", "0e0"), 2)).alias("km_per_l"))


def fuel_share(trips: DataFrame) -> DataFrame:
    """A trip's share in its user's fuel, in whole percent; fuel is added up in order of id, so that halves round alike however the rows are dealt."""
    own = W.partitionBy("user_id").orderBy("id", "fuel_consumed").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = trips.select("id", "user_id", "fuel_consumed", F.sum("fuel_consumed").over(own).alias("total"))
    return total.select("id", "user_id", F.expr(rounded(ratio("fuel_consumed * 1e2", "total", "0e0"), 0)).alias("share"))


def load_gauge(trips: DataFrame) -> DataFrame:
    return trips.groupBy("user_id").agg(F.max("engine_load").alias("max_load"), (100 - F.max("engine_load")).alias("remaining"))


def trip_cost(trips: DataFrame, per_litre: float = 1.5, exchange: float = 90.0) -> DataFrame:
    return trips.select("id", F.expr(rounded(f"fuel_consumed * {per_litre:e} * {exchange:e}", 2)).alias("cost"))


def missing_fields(trips: DataFrame) -> DataFrame:
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED)))
    return trips.select("id", F.array_join(missing, ",").alias("missing"), F.size(missing).cast("long").alias("n_missing"))


def series(trips: DataFrame) -> DataFrame:
    """Every trip with its place in its user's history, newest first."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy(*(F.desc(c) for c in LATEST))).cast("long")
    return trips.select("id", "user_id", "trip_date", place.alias("place"), "distance_km", "avg_speed_kmph", "max_speed", "max_rpm", "fuel_consumed", "brake_events", "engine_load", "throttle_position", "trip_duration")
