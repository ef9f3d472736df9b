"""Where results go: trips, alerts, routes, exports."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the exported columns.
EXPORT = {
    "id": "Trip ID", "trip_date": "Date", "distance_km": "Distance (km)", "avg_speed_kmph": "Average Speed (km/h)", "max_speed": "Max Speed (km/h)", "max_rpm": "Max RPM", "fuel_consumed": "Fuel Consumed (L)",
    "brake_events": "Brake Events", "steering_angle": "Steering Angle", "angular_velocity": "Angular Velocity", "acceleration": "Acceleration", "gear_position": "Gear Position", "tire_pressure": "Tire Pressure",
    "engine_load": "Engine Load", "throttle_position": "Throttle Position", "brake_pressure": "Brake Pressure", "trip_duration": "Trip Duration", "score": "Score",
}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder, in one step of the file system; False if the target is there already."""
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(fs.Path(target).toUri(), spark._jsc.hadoopConfiguration())
    plainly = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context.rename(fs.Path(source), fs.Path(target), plainly)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def append(rows: DataFrame, path: str, batch: str | None = None, by: tuple[str, ...] = ()) -> bool:
    """Appends rows as one batch; False if a batch of this name is stored already.

    The rows are written to a staging folder, which readers don't see, and become visible
    by one rename. A job that failed before it has left nothing; one that is tried again
    after it changes nothing. Without a name a batch is always new.
    """
    spark = rows.sparkSession
    target = f"{path}/batch={batch or uuid.uuid4().hex}"
    if exists(spark, target):
        return False
    staged = f"{path}/_staged/{uuid.uuid4().hex}"
    rows.write.partitionBy(*by).parquet(staged)
    return _moved(spark, staged, target)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the committed batches."""
    return spark.read.parquet(path).drop("batch")


def append_trips(trips: DataFrame, path: str | None, batch: str | None = None) -> DataFrame:
    """Appends by month, so that a folder's files stay large; without a path it is a dry run."""
    if path is not None:
        append(trips.withColumn("trip_month", F.date_format("trip_date", "yyyy-MM")), path, batch, ("trip_month",))
    return trips


ALERT = ["trip_id", "alert_type"]


def append_alerts(alerts: DataFrame, path: str, batch: str | None = None) -> DataFrame:
    """Appends those alerts that aren't stored yet, by trip and type, and returns them.

    Two writers at once may both store an alert; `stored_alerts` has it once.
    """
    spark = alerts.sparkSession
    new = alerts.dropDuplicates(ALERT)
    if exists(spark, path):
        new = new.join(stored_alerts(spark, path).select(*ALERT), ALERT, "left_anti")
    append(new, path, batch)
    return new


def stored_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Every stored alert once, as the batch with the least name has it."""
    rows = spark.read.option("basePath", path).parquet(path)
    columns = [c for c in rows.columns if c not in (*ALERT, "batch")]
    first = rows.groupBy(*ALERT).agg(F.min_by(F.struct(*columns), "batch").alias("row")) if columns else rows.select(*ALERT).distinct()
    return first.select(*ALERT, "row.*") if columns else first


def append_route(routes: DataFrame, path: str, saved: str, batch: str | None = None) -> None:
    append(routes.withColumn("saved_date", F.lit(saved).cast("timestamp")), path, batch)


def exported(trips: DataFrame) -> DataFrame:
    return trips.select(*(F.col(c).alias(name) for c, name in EXPORT.items()))


def export(trips: DataFrame, selected: DataFrame, path: str, kind: str = "csv") -> None:
    """Writes the selected trips, or all of them if none is selected."""
    rows = exported(trips if selected.isEmpty() else selected)
    writer = rows.write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.json(path)
