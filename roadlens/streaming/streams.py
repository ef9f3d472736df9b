"""Structured Streaming forms of segments, alerts and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import alerts


def source(spark: SparkSession, path: str, name: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """A stream over a folder's Parquet files, with the schema they have now."""
    schema = spark.read.parquet(f"{path}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_trigger).parquet(path)


def trips(samples: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A row for each user's session of samples no more than `gap` apart; what comes later than the watermark is dropped."""
    s = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = s.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n_rows"), F.avg("speed").alias("avg_speed"), F.max("speed").alias("max_speed"), F.max("rpm").alias("max_rpm"))
    return out.select("user_id", F.col("session.start").alias("start"), "n_rows", "avg_speed", "max_speed", "max_rpm")


def alert_rows(trips_: DataFrame) -> DataFrame:
    """Alerts of each trip as it comes: no state."""
    return alerts(trips_)


def daily(trips_: DataFrame, late: str = "1 day") -> DataFrame:
    """Indicators by day."""
    t = trips_.withColumn("at", F.col("trip_date").cast("timestamp")).withWatermark("at", late)
    out = t.groupBy(F.window("at", "1 day").alias("day")).agg(F.count("*").alias("n_trips"), F.sum("distance_km").alias("distance"), F.sum("fuel_consumed").alias("fuel"))
    return out.select(F.to_date("day.start").alias("day"), "n_trips", "distance", "fuel")


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into Parquet (append) or memory (complete), and reads the result."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").start(f"{path}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
