"""Route options between two places: distance, traffic, fuel, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import rounded

# Profiles of routes, traffic factors, scores, places.
PRICE = "11e1"
#: ord, type, distance factor, km per hour, fuel factor, base score, bonus.
PROFILES = [(1, "direct", 1.05, 50.0, 1.0, 75, 0), (2, "eco", 1.2, 45.0, 0.85, 85, 6), (3, "fastest", 1.1, 70.0, 1.15, 65, 0)]
HAVERSINE = (
    "(2 * 6371e0 * atan2(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)),"
    " sqrt(1 - (pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))))"
)
RUSH = "((dep_hour >= 7 AND dep_hour < 9) OR (dep_hour >= 17 AND dep_hour < 19))"
DELAY = (
    f"(CASE WHEN {RUSH} AND NOT weekend THEN CASE type WHEN 'fastest' THEN 16e-1 WHEN 'direct' THEN 13e-1 ELSE 11e-1 END"
    " WHEN weekend THEN CASE type WHEN 'fastest' THEN 56e-2 ELSE 7e-1 END"
    " ELSE CASE type WHEN 'fastest' THEN 8e-1 WHEN 'eco' THEN 11e-1 ELSE 1e0 END END)"
)
LEVEL = f"(CASE WHEN {RUSH} AND NOT weekend AND type = 'fastest' THEN 'heavy' WHEN {RUSH} AND NOT weekend AND type = 'direct' THEN 'moderate' ELSE 'light' END)"
DELAY_MINUTES = "floor(greatest(0e0, (delay - 1) * 30) + 5e-1) / 1e0"
CONGESTION = "(CASE level WHEN 'heavy' THEN 4 WHEN 'moderate' THEN 2 ELSE 0 END)"
SCORE = (
    "greatest(0, least(100, base_score + bonus"
    " + (CASE WHEN fuel > 0 AND distance > 18 * fuel THEN 10 WHEN fuel > 0 AND distance > 15 * fuel THEN 5 WHEN fuel > 0 AND distance < 10 * fuel THEN -10 ELSE 0 END)"
    " + (CASE WHEN minutes <= 0 THEN 5 WHEN distance * 60 > 60 * minutes THEN 8 WHEN distance * 60 > 40 * minutes THEN 5 WHEN distance * 60 < 25 * minutes THEN -8 ELSE 0 END)"
    " + (CASE WHEN delay_minutes = 0 THEN 8 WHEN delay_minutes < 5 THEN 4 WHEN delay_minutes > 15 THEN -12 ELSE 0 END)"
    " + (CASE WHEN type = 'fastest' AND delay_minutes < 5 THEN 4 ELSE 0 END)"
    " + (CASE WHEN cost < 50 THEN 6 WHEN cost < 100 THEN 3 WHEN cost > 200 THEN -6 ELSE 0 END)))"
)
PLACES = [
    ("new york", 40.7128, -74.006),
    ("los angeles", 34.0522, -118.2437),
    ("chicago", 41.8781, -87.6298),
    ("houston", 29.7604, -95.3698),
    ("phoenix", 33.4484, -112.074),
    ("philadelphia", 39.9526, -75.1652),
    ("san antonio", 29.4241, -98.4936),
    ("san diego", 32.7157, -117.1611),
    ("dallas", 32.7767, -96.797),
    ("san jose", 37.3382, -121.8863),
    ("mumbai", 19.076, 72.8777),
    ("delhi", 28.7041, 77.1025),
    ("bangalore", 12.9716, 77.5946),
    ("hyderabad", 17.385, 78.4867),
    ("chennai", 13.0827, 80.2707),
    ("kolkata", 22.5726, 88.3639),
    ("pune", 18.5204, 73.8567),
    ("ahmedabad", 23.0225, 72.5714),
]


def distances(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", F.expr(rounded(HAVERSINE)).alias("km"))


def expanded(requests: DataFrame) -> DataFrame:
    """Three rows a request, one for each profile; the table of profiles has three rows."""
    profiles = requests.sparkSession.createDataFrame(PROFILES, "ord int, type string, by_distance double, kmh double, by_fuel double, base_score int, bonus int")
    wide = requests.withColumn("base_km", F.expr(HAVERSINE)).withColumn("weekend", F.expr("weekday(dep_date) >= 5")).crossJoin(F.broadcast(profiles))
    wide = wide.withColumn("delay", F.expr(DELAY)).withColumn("level", F.expr(LEVEL)).withColumn("delay_minutes", F.expr(DELAY_MINUTES))
    return wide.withColumn("km", F.col("base_km") * F.col("by_distance"))


def fuel(requests: DataFrame, stats: DataFrame | None = None, efficiency: float = 15.0, load: float = 50.0) -> DataFrame:
    """`expanded` with litres, for the user's own efficiency and mean engine load if stats (user_id, avg_fuel_efficiency, avg_engine_load) has them."""
    wide = expanded(requests)
    if stats is not None:
        wide = wide.join(stats.select("user_id", "avg_fuel_efficiency", "avg_engine_load"), "user_id", "left")
    else:
        wide = wide.withColumn("avg_fuel_efficiency", F.lit(None).cast("double")).withColumn("avg_engine_load", F.lit(None).cast("double"))
    wide = wide.withColumn("kmpl", F.coalesce("avg_fuel_efficiency", F.lit(efficiency))).withColumn("load", F.coalesce("avg_engine_load", F.lit(load)))
    return wide.withColumn("fuel", F.expr(rounded("greatest(1e-1, km / kmpl * by_fuel * (8e-1 + 4e-1 * (load / 5e1)))", 2)))


def options(requests: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    wide = fuel(requests, stats).withColumn("distance", F.expr(rounded("km", 1))).withColumn("minutes", F.expr(rounded("km / kmh * 6e1 * delay", 0))).withColumn("cost", F.expr(rounded(f"fuel * {PRICE}", 2)))
    return wide.withColumn("score", F.expr(SCORE))


def ranked(requests: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    place = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("score"), "ord"))
    return options(requests, stats).withColumn("place", place.cast("long"))


def pick(requests: DataFrame, stats: DataFrame, efficiency: DataFrame) -> DataFrame:
    """The option advised, by the user's km per litre, and what the best saves against the worst."""
    at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    own = ranked(requests, stats).groupBy("request_id", "user_id").agg(at(1, "type").alias("first"), (at(3, "cost") - at(1, "cost")).alias("saved"), (at(3, "minutes") - at(1, "minutes")).alias("minutes_saved"))
    own = own.join(efficiency, "user_id", "left")
    choice = F.when(F.coalesce("km_per_l", F.lit(8.0)) < 7, "eco").otherwise(F.col("first"))
    return own.select("request_id", choice.alias("choice"), F.expr(rounded("saved", 2)).alias("fuel_savings"), "minutes_saved", F.expr(rounded("saved * 20", 2)).alias("monthly_savings"))


def saved(requests: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """The best option of each request, in the columns of a saved route."""
    place = lambda a, b: F.concat_ws(",", F.col(a).cast("string"), F.col(b).cast("string"))
    return ranked(requests, stats).filter("place = 1").select(
        "user_id",
        F.concat("type", F.lit(" route")).alias("route_name"),
        place("lat1", "lon1").alias("start_location"),
        place("lat2", "lon2").alias("end_location"),
        F.col("type").alias("route_type"),
        F.col("distance").alias("distance_km"),
        F.col("minutes").cast("int").alias("travel_time_minutes"),
        F.col("fuel").alias("fuel_consumption"),
        F.col("cost").alias("fuel_cost"),
        F.col("score").cast("int").alias("efficiency_score"),
    )


def savings(requests: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """What each option costs more than the eco one."""
    own = options(requests, stats).select("request_id", "type", "cost", "fuel", "minutes")
    eco = own.filter("type = 'eco'").select("request_id", F.col("cost").alias("eco_cost"), F.col("fuel").alias("eco_fuel"), F.col("minutes").alias("eco_minutes"))
    return own.join(eco, "request_id").select("request_id", "type", F.expr(rounded("cost - eco_cost", 2)).alias("extra_cost"), F.expr(rounded("fuel - eco_fuel", 2)).alias("extra_fuel"), F.expr("minutes - eco_minutes").alias("extra_minutes"))


def located(names: DataFrame) -> DataFrame:
    """lat and lon of known places, whatever case and space around their names."""
    table = names.sparkSession.createDataFrame(PLACES, "place string, lat double, lon double")
    return names.withColumn("place", F.trim(F.lower("name"))).join(F.broadcast(table), "place", "left")
