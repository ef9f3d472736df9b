"""What a drive costs in four ways of driving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import bands, rounded

# Multipliers of efficiency, ratings, price and emission of a litre.
PRICE, CO2 = "11e1", "231e-2"
#: ord, scenario, multiplier, rating, points for rating, points for practicality.
SCENARIOS = [
    (1, "eco_driving", 1.25, "A+", 40, 25),
    (2, "normal_driving", 1.0, "B", 30, 30),
    (3, "aggressive_driving", 0.7, "D", 10, 10),
    (4, "sport_driving", 0.48, "F", 10, 10),
]
ROUTE = [
    ("eco_driving", "highway", 1.1),
    ("eco_driving", "city", 0.9),
    ("eco_driving", "mixed", 1.0),
    ("eco_driving", "rural", 1.05),
    ("normal_driving", "highway", 1.05),
    ("normal_driving", "city", 0.85),
    ("normal_driving", "mixed", 1.0),
    ("normal_driving", "rural", 1.0),
    ("aggressive_driving", "highway", 0.8),
    ("aggressive_driving", "city", 0.75),
    ("aggressive_driving", "mixed", 0.8),
    ("aggressive_driving", "rural", 0.85),
]
TRAFFIC = [
    ("eco_driving", "light", 1.0),
    ("eco_driving", "normal", 1.1),
    ("eco_driving", "heavy", 1.2),
    ("normal_driving", "light", 1.1),
    ("normal_driving", "normal", 1.0),
    ("normal_driving", "heavy", 0.8),
    ("aggressive_driving", "light", 0.9),
    ("aggressive_driving", "normal", 0.8),
    ("aggressive_driving", "heavy", 0.7),
]


def _factor(rows: list[tuple[str, str, float]], scenario: str, column: str) -> Column:
    """What a scenario's efficiency is multiplied with for a value of the column; 1 for values without an entry."""
    return F.coalesce(*(F.when(F.col(column) == of, F.lit(factor)) for name, of, factor in rows if name == scenario), F.lit(1.0))


def priced(requests: DataFrame, base: float = 12.0) -> DataFrame:
    """The requests with ways, an array of one struct for each scenario: all comparisons of a request stay in its row."""
    of = {name: F.lit(base) * multiplier * _factor(ROUTE, name, "route_type") * _factor(TRAFFIC, name, "traffic") for _, name, multiplier, *_ in SCENARIOS}
    rows = requests.withColumns({f"_{name}": kmpl for name, kmpl in of.items()})
    way = lambda k, name, _, rating, points, practical: F.struct(
        F.lit(k).alias("ord"), F.lit(name).alias("scenario"), F.lit(rating).alias("rating"), F.lit(points + practical).alias("points"), F.col(f"_{name}").alias("kmpl"),
        (F.col("distance_km") / F.col(f"_{name}")).alias("litres"), F.expr(rounded(f"distance_km / _{name} * {PRICE}", 2)).alias("cost"),
    )
    return rows.select(*requests.columns, F.array(*(way(*s) for s in SCENARIOS)).alias("ways"))


def table(requests: DataFrame) -> DataFrame:
    """Four rows a request: km per litre, litres, cost and emissions."""
    rows = priced(requests).select("request_id", F.inline("ways"))
    return rows.select("request_id", "scenario", F.expr(rounded("kmpl", 1)).alias("kmpl"), F.expr(rounded("litres", 2)).alias("litres"), "cost", F.expr(rounded(f"litres * {CO2}", 2)).alias("co2_kg"), "rating")


def _cost(scenario: str) -> Column:
    return F.get("ways", F.lit([name for _, name, *_ in SCENARIOS].index(scenario)))["cost"]


def costs(requests: DataFrame) -> DataFrame:
    """Per request: the normal cost, the best and the worst, and what the difference makes over a month and a year."""
    by_cost = F.array_sort(F.transform("ways", lambda w: F.struct(w["cost"].alias("cost"), w["ord"].alias("ord"), w["scenario"].alias("scenario"))))
    rows = priced(requests).select("request_id", _cost("normal_driving").alias("normal_cost"), by_cost.alias("sorted"))
    out = rows.select("request_id", "normal_cost", F.get("sorted", F.lit(0))["cost"].alias("best_cost"), F.get("sorted", F.lit(len(SCENARIOS) - 1))["cost"].alias("worst_cost"), F.get("sorted", F.lit(0))["scenario"].alias("best"))
    spread = "worst_cost - best_cost"
    return out.select("*", F.expr(rounded(spread, 2)).alias("savings"), F.expr(rounded(f"({spread}) * 20", 2)).alias("monthly"), F.expr(rounded(f"({spread}) * 240", 2)).alias("yearly"))


def best(requests: DataFrame) -> DataFrame:
    """The scenario with the most points for rating, practicality and savings; the first of equals."""
    saved = lambda w: F.floor((F.col("normal") - w["cost"]) * 100.0 + 0.5) / 100.0
    point = lambda w: w["points"] + F.when(saved(w) > 0, F.least(F.lit(30.0), saved(w))).otherwise(0.0)
    ordered = F.array_sort(F.transform("ways", lambda w: F.struct((-point(w)).alias("last"), w["ord"].alias("ord"), w["scenario"].alias("scenario"), point(w).alias("points"), saved(w).alias("saved"))))
    rows = priced(requests).withColumn("normal", _cost("normal_driving")).select("request_id", F.get(ordered, F.lit(0)).alias("w"))
    return rows.select("request_id", "w.scenario", "w.points", "w.saved")


def tips(requests: DataFrame, least: float = 20.0) -> DataFrame:
    gap = priced(requests).select("request_id", (_cost("normal_driving") - _cost("eco_driving")).alias("gap"))
    return gap.select("request_id", F.concat_ws(",", F.when(F.col("gap") > least, "driving_style"), F.lit("route_planning"), F.lit("vehicle_maintenance")).alias("tips"))


def factors(requests: DataFrame) -> DataFrame:
    distance = bands("distance_km", [("> 100", "'high'"), ("< 20", "'low'")], "'medium'")
    note = bands("route_type", [("= 'highway'", "'steady_speeds'"), ("= 'city'", "'stop_and_go'")], "''")
    return requests.select("request_id", F.expr(distance).alias("distance_impact"), F.expr(note).alias("route_note"))


def confidence(profiles: DataFrame) -> DataFrame:
    """70 and points for what is known of user and vehicle, 95 at most."""
    points = {"efficiency": 10, "style": 5, "history": 10, "engine_size": 5, "vehicle_type": 5, "age": 5}
    total = sum((F.when(F.col(c).isNotNull(), p).otherwise(0) for c, p in points.items()), F.lit(70))
    return profiles.select("user_id", F.least(F.lit(95), total).alias("confidence"))
