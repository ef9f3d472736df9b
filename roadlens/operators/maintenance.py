"""Forecasts of wear for four components of a user's vehicle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import bands, rounded
from .history import ranked

# Lives, limits and costs.
LIMIT = 30
#: How much history each component looks at: the oldest of the newest trips.
DEPTH = {"brake": 20, "engine": 10, "tire": 50, "transmission": 15}
_RATE = "(CASE WHEN distance_km > 0 THEN brake_events / distance_km ELSE 0e0 END)"
HISTORY = {
    "h_brakes": (DEPTH["brake"], "avg(CASE WHEN distance_km > 0 THEN brake_events / distance_km END)"),
    "h_engine": (DEPTH["engine"], "sum(CASE WHEN max_rpm > 3500 THEN 1 ELSE 0 END)"),
    "h_distance": (DEPTH["tire"], "sum(distance_km)"),
    "h_gears": (DEPTH["transmission"], "sum(CASE WHEN max_rpm > 3500 THEN 1 ELSE 0 END)"),
}
_FACTOR = f"(CASE WHEN h_brakes > 0 THEN {_RATE} / h_brakes ELSE 1e0 END)"
_ENGINE = f"({bands('max_rpm', [('> 4000', '30e0'), ('> 3000', '15e0')], '0e0')} + {bands('engine_load', [('> 80', '25e0'), ('> 60', '10e0')], '0e0')}) * least(2e0, age_months / 24e0) + (CASE WHEN h_engine > 5 THEN 20e0 ELSE 0e0 END)"
_TIRE = f"({bands('tire_pressure', [('< 28', '40'), ('< 30', '20'), ('> 36', '15')], '0')} + {bands('max_speed', [('> 100', '25'), ('> 80', '10')], '0')})"
_MILEAGE = "((distance_km + h_distance) / 5e4 * 1e2)"
_GEAR = f"({bands('max_rpm', [('> 4000', '30'), ('> 3500', '15')], '0')} + (CASE WHEN gear_position > 5 THEN 10 ELSE 0 END) + 2 * h_gears)"
#: component: risk, wear in percent, urgency by risk, costs by risk.
COMPONENTS = {
    "brake": (
        f"(CASE WHEN {_RATE} > 6 OR brake_pressure > 80 THEN 'high' WHEN {_RATE} > 4 OR brake_pressure > 65 THEN 'medium' ELSE 'low' END)",
        f"least(95e0, greatest(1e1, 1e2 - 1e2 / greatest({_FACTOR}, 5e-1)))",
        {"high": 90, "medium": 60, "low": 30},
        {"high": (150, 400), "medium": (100, 250), "low": (100, 250)},
    ),
    "engine": (bands(f"({_ENGINE})", [("> 60", "'high'"), ("> 30", "'medium'")], "'low'"), f"least(9e1, {_ENGINE})", {"high": 85, "medium": 50, "low": 25}, {"high": (150, 300), "medium": (80, 150), "low": (80, 150)}),
    "tire": (
        f"(CASE WHEN {_TIRE} > 50 OR {_MILEAGE} > 80 THEN 'high' WHEN {_TIRE} > 25 OR {_MILEAGE} > 60 THEN 'medium' ELSE 'low' END)",
        f"least(95e0, {_MILEAGE})",
        {"high": 80, "medium": 45, "low": 20},
        {"high": (400, 800), "medium": (50, 100), "low": (50, 100)},
    ),
    "transmission": (f"(CASE WHEN {_GEAR} > 40 THEN 'medium' ELSE 'low' END)", f"CAST(least(70, {_GEAR}) AS DOUBLE)", {"high": 40, "medium": 40, "low": 20}, {"high": (120, 250), "medium": (120, 250), "low": (120, 250)}),
}


def by_risk(component: str, what) -> str:
    """SQL of a number that depends on the risk."""
    risk = COMPONENTS[component][0]
    return "(CASE " + " ".join(f"WHEN {risk} = '{r}' THEN {what(r)}" for r in ("high", "medium", "low")) + " END)"


def state(trips: DataFrame, age_months: int = 24, limit: int = LIMIT) -> DataFrame:
    """Each user's newest trip with what its history says."""
    own = ranked(trips, limit)
    part = [F.expr(sql.replace("CASE WHEN", f"CASE WHEN rank > n - {depth} AND", 1) if "CASE" in sql else sql).alias(name) for name, (depth, sql) in HISTORY.items()]
    past = own.groupBy("user_id").agg(*part)
    return own.filter("rank = 1").drop("rank", "n").join(past, "user_id").withColumn("age_months", F.lit(age_months))


def component(trips: DataFrame, name: str, **options) -> DataFrame:
    risk, wear, urgency, cost = COMPONENTS[name]
    return state(trips, **options).select("user_id", F.lit(name).alias("component"), F.expr(risk).alias("risk"), F.expr(rounded(wear, 2)).alias("wear"), F.expr(by_risk(name, lambda r: urgency[r])).alias("urgency"), F.expr(by_risk(name, lambda r: cost[r][0])).alias("cost_low"), F.expr(by_risk(name, lambda r: cost[r][1])).alias("cost_high"))


def forecast(trips: DataFrame, **options) -> DataFrame:
    """Four rows a user, the most urgent first."""
    one = lambda k, name: F.struct(
        F.lit(k).alias("ord"),
        F.lit(name).alias("component"),
        F.expr(COMPONENTS[name][0]).alias("risk"),
        F.expr(rounded(COMPONENTS[name][1], 2)).alias("wear"),
        F.expr(by_risk(name, lambda r: COMPONENTS[name][2][r])).alias("urgency"),
        F.expr(by_risk(name, lambda r: COMPONENTS[name][3][r][0])).alias("cost_low"),
        F.expr(by_risk(name, lambda r: COMPONENTS[name][3][r][1])).alias("cost_high"),
    )
    rows = F.array(*(one(k, name) for k, name in enumerate(COMPONENTS, 1)))
    sorted_ = F.array_sort(rows, lambda a, b: F.when(a["urgency"] != b["urgency"], b["urgency"] - a["urgency"]).otherwise(a["ord"] - b["ord"]))
    return state(trips, **options).select("user_id", F.posexplode(sorted_).alias("place", "x")).select("user_id", (F.col("place") + 1).cast("long").alias("place"), "x.component", "x.risk", "x.wear", "x.urgency", "x.cost_low", "x.cost_high")


def costs(trips: DataFrame, **options) -> DataFrame:
    urgent = F.when(F.col("risk") == "high", F.col("cost_high")).otherwise(0)
    return forecast(trips, **options).groupBy("user_id").agg(F.sum("cost_low").alias("total_low"), F.sum("cost_high").alias("total_high"), F.sum(urgent).alias("urgent_cost"), F.count_if(F.col("risk") == "high").alias("n_urgent"))


def next_service(trips: DataFrame, **options) -> DataFrame:
    km = F.when(F.bool_or(F.col("risk") == "high"), 500).when(F.bool_or(F.col("risk") == "medium"), 2000).otherwise(5000)
    return forecast(trips, **options).groupBy("user_id").agg(km.alias("next_service_km"))
