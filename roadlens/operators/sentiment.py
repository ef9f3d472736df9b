"""The mood of a trip, from its numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import bands, rounded
from ..functions.rules import Rule, exploded, fired

# Points, bands and tags.
_POINTS = " + ".join(
    [
        "70",
        "(CASE WHEN avg_speed_kmph >= 50 AND avg_speed_kmph <= 80 THEN 15 WHEN avg_speed_kmph > 100 THEN -20 WHEN avg_speed_kmph < 30 THEN -10 ELSE 0 END)",
        bands("brake_events / greatest(distance_km, 1e0)", [("< 2", "10"), ("> 5", "-15")], "0"),
        bands("max_rpm", [("> 4000", "-12"), ("< 2500", "8")], "0"),
        bands("abs(acceleration)", [("< 2", "8"), ("> 4", "-10")], "0"),
    ]
)
SCORE = f"CAST(greatest(0, least(100, {_POINTS})) AS BIGINT)"
MOOD = [("positive", "relaxed", 80), ("neutral", "focused", 60), ("negative", "stressed", None)]
INSIGHTS = [
    Rule("frequent_braking", "info", "brake_events > 3 * distance_km", "brake_events"),
    Rule("high_rpm", "info", "max_rpm > 3500", "max_rpm"),
    Rule("high_speed", "info", "avg_speed_kmph > 90", "avg_speed_kmph"),
]
TAGS = [
    Rule("smooth,efficient,controlled", "", "mood_score >= 80"),
    Rule("steady,consistent", "", "mood_score >= 60 AND mood_score < 80"),
    Rule("erratic,aggressive", "", "mood_score < 60"),
    Rule("frequent-braking", "", "brake_events > 4 * distance_km"),
    Rule("high-rpm", "", "max_rpm > 3500"),
    Rule("high-speed", "", "avg_speed_kmph > 85"),
]
CONFIDENCE = rounded("least(95e0, 6e1 + 7e-1 * abs(mood_score - 50))", 2)


def scored(trips: DataFrame) -> DataFrame:
    return trips.withColumn("mood_score", F.expr(SCORE))


def moods(trips: DataFrame) -> DataFrame:
    pick = lambda k: F.when(F.col("mood_score") >= 80, MOOD[0][k]).when(F.col("mood_score") >= 60, MOOD[1][k]).otherwise(MOOD[2][k])
    return scored(trips).select("id", "user_id", "mood_score", pick(0).alias("sentiment"), pick(1).alias("emotion"), F.expr(CONFIDENCE).alias("confidence"))


def insights(trips: DataFrame) -> DataFrame:
    return exploded(trips, INSIGHTS, "id").select("id", "ord", "code", "value")


def tags(trips: DataFrame) -> DataFrame:
    return scored(trips).select("id", F.array_join(F.transform(fired(TAGS), lambda r: r["code"]), ",").alias("tags"))


def trend(trips: DataFrame, n: int = 10, recent: int = 3) -> DataFrame:
    """Per user: the mean mood of the newest trips against that of the rest of the last n."""
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("trip_date"), F.desc("id")))
    own = scored(trips).withColumn("rank", rank).filter(F.col("rank") <= n)
    both = own.groupBy("user_id").agg(F.count("*").alias("n_trips"), F.avg(F.when(F.col("rank") <= recent, F.col("mood_score"))).alias("new"), F.avg(F.when(F.col("rank") > recent, F.col("mood_score"))).alias("old"))
    change = F.col("new") - F.col("old")
    word = F.when(F.col("n_trips") <= recent, "insufficient").when(change > 5, "improving").when(change < -5, "declining").otherwise("stable")
    return both.select("user_id", "n_trips", word.alias("trend"), F.expr(rounded("new - old", 2)).alias("change"))
