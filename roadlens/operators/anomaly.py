"""Anomalies of a trip against limits and against its user's history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rule, exploded, fired
from .history import with_history

# Limits and weights of the rules.
_DEVIATION = "abs(avg_speed_kmph - h_speed) / h_speed"
_BRAKES = "brake_events / distance_km"
_KMPL = "distance_km / fuel_consumed"
SPEED = [
    Rule("speed_deviation", "high", f"h_speed > 0 AND {_DEVIATION} > 5e-1", "avg_speed_kmph", "h_speed"),
    Rule("speed_deviation", "medium", f"h_speed > 0 AND {_DEVIATION} > 3e-1 AND {_DEVIATION} <= 5e-1", "avg_speed_kmph", "h_speed"),
    Rule("excessive_speed", "high", "max_speed > 120", "max_speed"),
]
RPM = [
    Rule("excessive_rpm", "high", "max_rpm > 4500", "max_rpm"),
    Rule("high_rpm", "medium", "max_rpm > 3500 AND max_rpm <= 4500", "max_rpm"),
    Rule("rpm_spike", "medium", "h_rpm > 0 AND max_rpm > 14e-1 * h_rpm", "max_rpm", "h_rpm"),
]
BRAKE = [
    Rule("excessive_braking", "high", f"distance_km > 0 AND {_BRAKES} > 8", "brake_events"),
    Rule("frequent_braking", "medium", f"distance_km > 0 AND {_BRAKES} > 5 AND {_BRAKES} <= 8", "brake_events"),
]
FUEL = [
    Rule("low_efficiency", "high", f"fuel_consumed > 0 AND distance_km > 0 AND {_KMPL} < 8", "fuel_consumed"),
    Rule("efficiency_drop", "medium", f"fuel_consumed > 0 AND distance_km > 0 AND h_kmpl > 0 AND {_KMPL} < 7e-1 * h_kmpl", "fuel_consumed", "h_kmpl"),
]
ALL = SPEED + RPM + BRAKE + FUEL
WEIGHTS = {"low": 1, "medium": 3, "high": 5}


def found(trips: DataFrame, rules: list[Rule], mode: str = "trailing") -> DataFrame:
    """A row an anomaly: id, code, severity, value and the history that it is held against."""
    return exploded(with_history(trips, mode), rules, "id", "user_id").select("id", "user_id", "ord", "code", "severity", "value", "baseline")


def summary(trips: DataFrame, mode: str = "trailing") -> DataFrame:
    """Anomalies of every trip as an array, how many of each severity, the risk and the advice."""
    wide = with_history(trips, mode).select("id", "user_id", fired(ALL).alias("anomalies"))
    n = lambda s: F.size(F.filter("anomalies", lambda a: a["severity"] == s)).cast("long")
    wide = wide.withColumns({s: n(s) for s in WEIGHTS} | {"total": F.size("anomalies").cast("long")})
    risk = F.least(F.lit(100), sum(10 * w * F.col(s) for s, w in WEIGHTS.items()))
    codes = lambda s: F.slice(F.transform(F.filter("anomalies", lambda a: a["severity"] == s), lambda a: a["code"]), 1, 2)
    nothing = F.array().cast("array<string>")
    parts = [F.when(F.col(s) > 0, F.concat(F.array(F.lit(head)), codes(s))).otherwise(nothing) for s, head in (("high", "act"), ("medium", "watch"))]
    advice = F.slice(F.concat(*parts, F.when(F.col("total") > 3, F.array(F.lit("assess"))).otherwise(nothing)), 1, 6)
    return wide.select("id", "user_id", "total", "low", "medium", "high", risk.cast("long").alias("risk"), F.array_join(advice, ",").alias("advice"), "anomalies")
