"""Cutting samples into trips, and one row for each trip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import rounded

# Limits of the cuts.
GAP, STOP_SPEED, STOP_ROWS, RESET, LEAST_ROWS = "30 minutes", 1.0, 50, 1.0, 5


def by_gap(samples: DataFrame, key: list[str], order: list[str], gap: str = GAP) -> DataFrame:
    """trip_index from 0: a sample more than `gap` after the one before begins a trip; a NULL time never does."""
    w = W.partitionBy(*key).orderBy(*order)
    new = F.when(F.col("ts") > F.lag("ts").over(w) + F.expr(f"INTERVAL {gap}"), 1).otherwise(0)
    return samples.withColumn("_new", new).withColumn("trip_index", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def by_reset(samples: DataFrame, key: list[str], order: list[str], drop: float = RESET) -> DataFrame:
    """trip_index: a trip distance that falls by more than `drop` begins a trip; NULL counts as 0."""
    w = W.partitionBy(*key).orderBy(*order)
    d = F.coalesce("trip_distance", F.lit(0.0))
    new = F.when(d < F.lag(d).over(w) - drop, 1).otherwise(0)
    return samples.withColumn("_new", new).withColumn("trip_index", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def by_stop(samples: DataFrame, key: list[str], order: list[str], limit: int = STOP_ROWS, speed: float = STOP_SPEED, skip_first_moving: bool = True) -> DataFrame:
    """trip_index of the samples that belong to a trip: stops of more than `limit` rows are cut out.

    Stops are islands of samples at most `speed` fast (NULL is 0). One that opens
    the key's samples cuts nothing; of one that ends them the last row does not
    count; the first moving sample after a cut goes too. Trips of one row go.
    """
    w = W.partitionBy(*key).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    z = F.coalesce("speed", F.lit(0.0)) <= speed
    s = samples.withColumn("_o", F.row_number().over(w) - 1).withColumn("_z", z)
    s = s.withColumn("_i", F.sum(F.when(F.col("_z") != F.lag("_z").over(w), 1).otherwise(0)).over(upto))
    island = W.partitionBy(*key, "_i")
    s = s.withColumn("_start", F.min("_o").over(island)).withColumn("_end", F.max("_o").over(island)).withColumn("_last", F.max("_o").over(W.partitionBy(*key)))
    length = F.least(F.col("_end") + 1, F.col("_last")) - F.col("_start")
    s = s.withColumn("_cut", F.col("_z") & (F.col("_start") > 0) & (length > limit))
    after = F.coalesce(F.lag("_cut").over(w), F.lit(False)) & ~F.col("_cut") if skip_first_moving else F.lit(False)
    s = s.withColumn("_skip", F.col("_cut") | after)
    s = s.withColumn("trip_index", F.sum(F.when(F.col("_cut") & (F.col("_o") == F.col("_start")), 1).otherwise(0)).over(upto))
    kept = s.filter(~F.col("_skip")).withColumn("_n", F.count("*").over(W.partitionBy(*key, "trip_index")))
    return kept.filter("_n >= 2").drop("_o", "_z", "_i", "_start", "_end", "_last", "_cut", "_skip", "_n")


def automatic(samples: DataFrame, key: list[str], order: list[str], gap: str = GAP, **stop) -> DataFrame:
    """trip_index by gaps where the key has times, else by stops where it has speeds, else by resets where it has distances, else one trip."""
    w = W.partitionBy(*key)
    known = lambda c: F.max(F.col(c).isNotNull()).over(w)
    method = F.when(known("ts") & (F.count("*").over(w) >= 2), "gap").when(known("speed"), "stop").when(known("trip_distance"), "reset").otherwise("whole")
    s = samples.withColumn("method", method)
    of = lambda m: s.filter(F.col("method") == m)
    parts = [by_gap(of("gap"), key, order, gap), by_stop(of("stop"), key, order, **stop), by_reset(of("reset"), key, order), of("whole").withColumn("trip_index", F.lit(0).cast("long"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sized(segments: DataFrame, key: list[str], least: int = LEAST_ROWS) -> DataFrame:
    """One row a segment: its rows and whether it is long enough to be a trip."""
    return segments.groupBy(*key, "trip_index").agg(F.count("*").alias("n_rows")).withColumn("kept", F.col("n_rows") >= least)


FUEL_RATE = "(CASE WHEN max_rpm > 4000 OR brake_events > 5 THEN 12e-2 WHEN max_rpm < 3000 AND brake_events <= 2 THEN 6e-2 ELSE 8e-2 END)"
FUEL = f"greatest(1e-1, CASE WHEN fuel_first > 0 AND fuel_last > 0 AND fuel_first > fuel_last THEN fuel_first - fuel_last ELSE {FUEL_RATE} * distance_km END)"
DISTANCE = "(CASE WHEN last_distance > 0 THEN last_distance ELSE greatest(1e-1, avg_speed * n_rows / 36e2) END)"
POINTS = "((CASE WHEN max_rpm > 5000 THEN 2 ELSE 0 END) + (CASE WHEN brake_events > 5 THEN 2 ELSE 0 END) + (CASE WHEN avg_speed > 80 THEN 1 ELSE 0 END) + (CASE WHEN throttle > 70 THEN 1 ELSE 0 END))"
LABEL = f"(CASE WHEN rating IS NOT NULL THEN rating WHEN {POINTS} >= 3 THEN 'Risky' WHEN {POINTS} >= 1 THEN 'Average' ELSE 'Good' END)"
GEAR = "(CASE WHEN gear IS NOT NULL THEN CAST(floor(gear) AS INT) WHEN avg_speed < 25 THEN 2 WHEN avg_speed < 50 THEN 3 ELSE 5 END)"

DURATION = "(CASE WHEN last_time > 0 THEN last_time ELSE greatest(1e0, n_rows / 6e1) END)"
ACCELERATION = "coalesce(mean_acceleration, mean_step / 36e-1)"
TURN = "coalesce(mean_turn, mean_steering * 1e-1)"
#: Sensors whose mean is a trip's value.
MEANS = {"acceleration": "mean_acceleration", "coolant_temp": "coolant", "steering_angle": "mean_steering", "angular_velocity": "mean_turn", "gear_position": "gear", "tire_pressure": "tire", "brake_pressure": "brake"}


def aggregated(segments: DataFrame, key: list[str], order: str, run_date: str, least: int = LEAST_ROWS) -> DataFrame:
    """One row a trip of segments long enough that have speeds, rpm and throttle.

    Sensors win over what is derived from others: trip time over the number of
    rows, a rating over points, acceleration over steps of speed, turn over
    steering, gear over speed. A sensor without values is NULL (`imputed_trip`
    fills those). Steps are taken from the last known speed.
    """
    trip = [*key, "trip_index"]
    w = W.partitionBy(*trip).orderBy(order)
    # the last known speed before a sample, over those that have one
    before = F.last(F.when(F.col("speed").isNotNull(), F.col("speed")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    s = segments.withColumn("_step", F.col("speed") - before)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    t = s.groupBy(*trip).agg(
        F.count("*").alias("n_rows"),
        F.avg("speed").alias("avg_speed"),
        F.max("speed").alias("max_speed"),
        F.max("rpm").alias("max_rpm"),
        F.avg("throttle").alias("throttle"),
        F.avg("engine_load").alias("engine_load"),
        F.count_if(F.col("_step") < -10).alias("brake_events"),
        F.avg("_step").alias("mean_step"),
        last("trip_distance").alias("last_distance"),
        first("fuel_level").alias("fuel_first"),
        last("fuel_level").alias("fuel_last"),
        first("latitude").alias("lat1"),
        first("longitude").alias("lon1"),
        last("latitude").alias("lat2"),
        last("longitude").alias("lon2"),
        F.to_date(first("ts")).alias("day"),
        last("trip_time").alias("last_time"),
        first("driver_rating").alias("rating"),
        *(F.avg(c).alias(name) for c, name in MEANS.items()),
    )
    t = t.filter(f"n_rows >= {least} AND avg_speed IS NOT NULL AND max_rpm IS NOT NULL AND throttle IS NOT NULL")
    t = t.withColumn("distance_km", F.expr(DISTANCE)).withColumn("fuel_consumed", F.expr(FUEL)).withColumn("score", F.expr(LABEL)).withColumn("gear_position", F.expr(GEAR))
    place = lambda a, b: F.concat_ws(",", F.col(a).cast("string"), F.col(b).cast("string"))
    r = lambda e, d: F.expr(rounded(e, d))
    return t.select(
        *trip,
        "n_rows",
        F.coalesce("day", F.lit(run_date).cast("date")).alias("trip_date"),
        r("distance_km", 2).alias("distance_km"),
        r("avg_speed", 2).alias("avg_speed_kmph"),
        r("max_speed", 2).alias("max_speed"),
        F.col("max_rpm").cast("int").alias("max_rpm"),
        r("fuel_consumed", 3).alias("fuel_consumed"),
        "brake_events",
        r("mean_steering", 2).alias("steering_angle"),
        r(TURN, 3).alias("angular_velocity"),
        r(ACCELERATION, 3).alias("acceleration"),
        "gear_position",
        r("tire", 1).alias("tire_pressure"),
        r("brake", 2).alias("brake_pressure"),
        r("coolant", 1).alias("coolant_temp"),
        r("engine_load", 1).alias("engine_load"),
        r("throttle", 1).alias("throttle_position"),
        r(DURATION, 2).alias("trip_duration"),
        F.when(F.expr("lat1 IS NOT NULL AND lon1 IS NOT NULL"), F.concat(F.lit("["), place("lat1", "lon1"), F.lit("]"))).alias("gps_path"),
        place("lat1", "lon1").alias("start_location"),
        place("lat2", "lon2").alias("end_location"),
        "score",
    )
