"""Ranked recommendations for a trip and tips for its circumstances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.rules import Rule, exploded, fired

# Limits, priorities, shares of fuel saved.
PRICE = 110
_KMPL = ratio("distance_km", "fuel_consumed", "15e0")
_BRAKES = ratio("brake_events", "distance_km", "0e0")
_relevance = lambda column, word: f"CASE WHEN {column} = '{word}' THEN 'high' ELSE 'medium' END"
FUEL = [
    Rule("optimal_speed", "fuel_efficiency", "avg_speed_kmph > 85", f"fuel_consumed * 18e-2 * {PRICE}", score=85, text="easy", note=_relevance("traffic", "light")),
    Rule("early_shift", "fuel_efficiency", "max_rpm > 3500", f"fuel_consumed * 10e-2 * {PRICE}", score=75, text="medium", note="'high'"),
    Rule("eco_driving", "fuel_efficiency", f"{_KMPL} < 10", f"fuel_consumed * 25e-2 * {PRICE}", score=90, text="medium", note="'high'"),
]
SAFETY = [
    Rule("smooth_braking", "safety", f"{_BRAKES} > 5", score=80, text="medium", note=_relevance("traffic", "heavy")),
    Rule("speed_limit", "safety", "max_speed > 100", score=95, text="easy", note="'high'"),
    Rule("weather_care", "safety", "weather IN ('rain', 'fog', 'snow')", score=85, text="medium", note="'high'"),
]
PERFORMANCE = [
    Rule("gentle_acceleration", "performance", "abs(acceleration) > 3", score=60, text="medium", note="'medium'"),
    Rule("smooth_steering", "performance", "abs(steering_angle) > 15", score=50, text="easy", note="'medium'"),
]
MAINTENANCE = [
    Rule("tire_pressure", "maintenance", "tire_pressure < 30 OR tire_pressure > 36", score=70, text="easy", note="'high'"),
    Rule("engine_load", "maintenance", "engine_load > 75", score=65, text="medium", note="'medium'"),
]
ALL = FUEL + SAFETY + PERFORMANCE + MAINTENANCE
#: kind, value, place and key of each tip, in order.
TIPS = [
    ("weather", "rain", 1, "slow_down_wet"),
    ("weather", "rain", 2, "more_distance"),
    ("weather", "rain", 3, "headlights"),
    ("weather", "fog", 4, "low_beams"),
    ("weather", "fog", 5, "road_markings"),
    ("weather", "fog", 6, "much_slower"),
    ("traffic", "heavy", 7, "steady_speed"),
    ("traffic", "heavy", 8, "extra_time"),
    ("traffic", "heavy", 9, "stay_calm"),
    ("time_of_day", "night", 10, "clean_lights"),
    ("time_of_day", "night", 11, "take_breaks"),
    ("time_of_day", "night", 12, "unknown_roads"),
]


def with_context(trips: DataFrame, requests: DataFrame) -> DataFrame:
    """Trips with weather, traffic and time of day; without any, clear, normal and day."""
    own = requests.select(F.col("request_id").alias("id"), F.coalesce("weather", F.lit("clear")).alias("weather"), F.coalesce("traffic", F.lit("normal")).alias("traffic"), F.coalesce("time_of_day", F.lit("day")).alias("time_of_day"))
    return trips.join(own, "id")


def given(trips: DataFrame, rules: list[Rule]) -> DataFrame:
    rows = exploded(trips, rules, "id")
    return rows.select("id", "ord", "code", F.col("severity").alias("category"), F.col("score").alias("priority"), F.expr("floor(value + 5e-1) / 1e0").alias("savings"), F.col("text").alias("difficulty"), F.col("note").alias("relevance"))


def top(trips: DataFrame, n: int = 8) -> DataFrame:
    """The n recommendations of a trip with the highest priority, and how many there were: sorted inside the row, so nothing is shuffled."""
    keyed = F.transform(fired(ALL), lambda r: F.struct((-r["score"]).alias("last"), r["ord"].alias("ord"), r["code"].alias("code"), r["severity"].alias("category"), r["score"].alias("priority")))
    rows = trips.select("id", F.array_sort(keyed).alias("all"))
    rows = rows.select("id", F.size("all").cast("long").alias("generated"), F.posexplode(F.slice("all", 1, n)).alias("at", "r"))
    return rows.select("id", (F.col("at") + 1).cast("long").alias("place"), "r.code", "r.category", "r.priority", "generated")


def categories(trips: DataFrame, n: int = 8) -> DataFrame:
    return top(trips, n).groupBy("id", "category").agg(F.count("*").alias("n"))


def personalisation(profiles: DataFrame) -> DataFrame:
    """How much of a profile (experience, goals, vehicle_type, history) is known."""
    known = sum(F.col(c).isNotNull().cast("int") for c in ("experience", "goals", "vehicle_type", "history"))
    return profiles.select("user_id", F.when(known >= 3, "high").when(known >= 2, "medium").otherwise("low").alias("level"))


def tips(requests: DataFrame, n: int = 5) -> DataFrame:
    """The first n tips for a request's weather, traffic and time of day; the table of tips is a dozen rows."""
    table = requests.sparkSession.createDataFrame(TIPS, "kind string, of string, ord int, tip string")
    facts = requests.select("request_id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("of")) for k in ("weather", "traffic", "time_of_day")))))
    found = facts.join(F.broadcast(table), ["kind", "of"])
    listed = F.array_sort(F.collect_list(F.struct("ord", "tip")))
    return found.groupBy("request_id").agg(F.array_join(F.transform(F.slice(listed, 1, n), lambda x: x["tip"]), ",").alias("tips"))
