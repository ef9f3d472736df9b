"""What came before a trip: windows that every history-relative rule shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# SQL of the means over history; zero means not measured.
MEANS = {"h_speed": "avg(nullif(avg_speed_kmph, 0e0))", "h_rpm": "avg(CASE WHEN max_rpm <> 0 THEN CAST(max_rpm AS DOUBLE) END)", "h_kmpl": "avg(CASE WHEN fuel_consumed > 0 AND distance_km > 0 THEN distance_km / fuel_consumed END)"}


def trailing(trips: DataFrame, n: int = 10) -> DataFrame:
    """Means over the n trips before each one, itself left out: one sort for all of them."""
    w = W.partitionBy("user_id").orderBy("trip_date", "id").rowsBetween(-n, -1)
    return trips.select("*", *(F.expr(sql).over(w).alias(name) for name, sql in MEANS.items()))


def ranked(trips: DataFrame, limit: int) -> DataFrame:
    """The `limit` newest trips of each user: rank (1 is the newest) and n, how many there are."""
    w = W.partitionBy("user_id")
    rank = F.row_number().over(w.orderBy(F.desc("trip_date"), F.desc("id")))
    # n by a second window would need all rows; the rank of the oldest kept one is n
    kept = trips.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= limit)
    return kept.withColumn("n", F.max("rank").over(w))


def served(trips: DataFrame, limit: int = 20, n: int = 10) -> DataFrame:
    """Means over the oldest n of each user's `limit` newest trips."""
    own = ranked(trips, limit).filter(F.col("rank") > F.col("n") - n)
    return own.groupBy("user_id").agg(*(F.expr(sql).alias(name) for name, sql in MEANS.items()))


def with_history(trips: DataFrame, mode: str = "trailing", limit: int = 20, n: int = 10) -> DataFrame:
    """Trips with h_speed, h_rpm and h_kmpl; in mode served all trips of a user are held against the same means."""
    return trailing(trips, n) if mode == "trailing" else trips.join(served(trips, limit, n), "user_id", "left")
