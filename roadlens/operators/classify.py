"""Driver-behaviour classification: its data, folds and metrics as relations, its pipelines with MLlib."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from .scoring import HEURISTIC

# Features, classes, sizes of models.
FEATURES = ["avg_speed_kmph", "max_speed", "throttle_position", "engine_load", "trip_duration", "distance_km"]
LABELS = ["Average", "Good", "Risky"]
#: The larger set, for the classes that `scoring.HEURISTIC` gives.
WIDE_FEATURES = [
    "avg_speed_kmph", "max_speed", "max_rpm", "fuel_consumed", "brake_events", "steering_angle", "angular_velocity", "acceleration",
    "gear_position", "tire_pressure", "engine_load", "throttle_position", "brake_pressure", "trip_duration",
]
WIDE_LABELS = ["Aggressive", "Moderate", "Safe"]
#: Hex digits of a hash that make a range: 4096 of them.
RANGE_DIGITS = 3


def prepared(trips: DataFrame, features: list[str] = FEATURES, labels: list[str] = LABELS) -> DataFrame:
    """id, user_id, features and score of trips with a known class and no NULL, NaN or infinite feature."""
    sane = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    out = trips.select("id", "user_id", *(F.col(c).try_cast("double").alias(c) for c in features), "score")
    return out.select("id", "user_id", *(sane(c).alias(c) for c in features), "score").filter(F.col("score").isin(labels)).dropna(subset=features)


def prepared_wide(trips: DataFrame) -> DataFrame:
    """The larger set of features, with the classes of the rule about speed and rpm as score."""
    return prepared(trips.withColumn("score", F.expr(HEURISTIC)), WIDE_FEATURES, WIDE_LABELS)


def scaled(data: DataFrame) -> DataFrame:
    """id, label (classes that occur, numbered in alphabetical order) and features less their mean over their population spread; a constant is 0."""
    stats = data.agg(*(f(c).alias(f"_{n}_{c}") for c in FEATURES for n, f in (("m", F.avg), ("s", F.stddev_pop))), F.array_sort(F.collect_set("score")).alias("_classes"))
    rows = data.crossJoin(F.broadcast(stats))  # one row
    label = (F.array_position("_classes", F.col("score")) - 1).cast("int")
    unit = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return rows.select("id", label.alias("label"), *(unit(c).alias(c) for c in FEATURES))


def duplicates(data: DataFrame) -> DataFrame:
    """Rows whose features another row has already."""
    groups = data.groupBy(*FEATURES, "score").agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count("*")).alias("n_duplicates"))


def classes(trips: DataFrame) -> DataFrame:
    return trips.groupBy("score").agg(F.count("*").alias("n"))


def _placed(data: DataFrame) -> DataFrame:
    """_place of each row in its class, from 1 in order of a hash of the id, and _of, the size of the class.

    Rows are ranked in ranges of the hash only: a class is never one task's. What
    lies before a range comes from a table of at most 4096 rows for each class.
    """
    rows = data.withColumn("_hash", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))).withColumn("_range", F.substring("_hash", 1, RANGE_DIGITS))
    by_class = W.partitionBy("_class")
    sizes = rows.groupBy(F.col("score").alias("_class"), F.col("_range").alias("_at")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(by_class.orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("_class", "_at", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(by_class).alias("_of"))
    both = rows.join(sizes, F.col("score").eqNullSafe(F.col("_class")) & (F.col("_range") == F.col("_at")))
    rank = F.row_number().over(W.partitionBy("score", "_range").orderBy("_hash", "id"))
    return both.withColumn("_place", F.col("_before") + rank).select(*data.columns, "_place", "_of")


def split(data: DataFrame, share: float = 0.3) -> DataFrame:
    """Stratified: in order of a hash of the id, the first `share` of each class is the test side."""
    return _placed(data).withColumn("test", F.col("_place") <= F.floor(F.col("_of") * share + 0.5)).drop("_place", "_of")


def folds(data: DataFrame, k: int = 5) -> DataFrame:
    return _placed(data).withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place", "_of")


def user_folds(data: DataFrame, k: int = 5) -> DataFrame:
    """user_id, n (trips), fold: folds of like size, to which users go whole.

    Users in order of their trips, most first, are dealt to the folds to and fro, so that
    sizes differ by the trips of one user at most. Users of equally many trips are in order of
    a hash, ranked in its ranges only; what lies before a range is counted, so no task ranks all.
    """
    users = data.groupBy("user_id").agg(F.count("*").alias("n"))
    users = users.withColumn("_hash", F.md5(F.coalesce(F.col("user_id").cast("string"), F.lit("")))).withColumn("_range", F.substring("_hash", 1, RANGE_DIGITS))
    ranges = users.groupBy("n", "_range").agg(F.count("*").alias("_users"))
    earlier = W.unboundedPreceding, -1
    more = ranges.groupBy("n").agg(F.sum("_users").alias("_all"))  # a row for each number of trips
    more = more.select("n", F.coalesce(F.sum("_all").over(W.orderBy(F.desc("n")).rowsBetween(*earlier)), F.lit(0)).alias("_more"))
    ranges = ranges.select("n", "_range", F.coalesce(F.sum("_users").over(W.partitionBy("n").orderBy("_range").rowsBetween(*earlier)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("n", "_range").orderBy("_hash", "user_id"))
    place = F.col("_more") + F.col("_before") + rank - 1
    lap = F.pmod(place, F.lit(2 * k))
    ranked = users.join(ranges, ["n", "_range"]).join(more, "n")
    return ranked.select("user_id", "n", F.when(lap < k, lap).otherwise(2 * k - 1 - lap).cast("int").alias("fold"))


def group_folds(data: DataFrame, k: int = 5) -> DataFrame:
    """All trips of a user are in one fold, and folds are of like size."""
    dealt = user_folds(data, k).select(F.col("user_id").alias("_user"), "fold")
    return data.join(dealt, F.col("user_id").eqNullSafe(F.col("_user"))).drop("_user")


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("label").pivot("prediction", LABELS).agg(F.count("label")).na.fill(0)


def metrics(predicted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, and their plain means and the accuracy as class `all`."""
    pairs = predicted.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    rows = pairs.select("n", (F.col("label") == F.col("prediction")).alias("hit"), F.inline(F.array(F.struct(F.col("label").alias("class"), F.lit(True).alias("actual")), F.struct(F.col("prediction").alias("class"), F.lit(False).alias("actual")))))
    hit = F.sum(F.when(F.col("hit") & F.col("actual"), F.col("n")).otherwise(0))
    c = rows.groupBy("class").agg(hit.alias("hits"), F.sum(F.when(F.col("actual"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("actual"), F.col("n")).otherwise(0)).alias("guessed"))
    c = c.withColumns({"precision": F.expr("coalesce(try_divide(hits, guessed), 0e0)"), "recall": F.expr("coalesce(try_divide(hits, support), 0e0)")})
    c = c.withColumn("f1", F.expr("coalesce(try_divide(2e0 * precision * recall, precision + recall), 0e0)"))
    total = c.agg(F.lit("all").alias("class"), F.sum("hits").alias("hits"), F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    both = c.unionByName(total)
    return both.select("class", "support", *(F.expr(rounded(m)).alias(m) for m in ("precision", "recall", "f1")), F.expr(rounded("try_divide(hits * 1e0, support)")).alias("accuracy"))


def pipeline(classifier, features: list[str] = FEATURES, scaled: bool = True) -> Pipeline:
    """Index, assemble and scale inside the pipeline, so that a fold's scaler sees that fold only."""
    stages = [StringIndexer(inputCol="score", outputCol="label_index", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=features, outputCol="raw" if scaled else "features")]
    return Pipeline(stages=[*stages, *([StandardScaler(inputCol="raw", outputCol="features", withMean=True)] if scaled else []), classifier])


def predicted(model: PipelineModel, data: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, model.stages[0].labels))
    return model.transform(data).select("id", F.col("score").alias("label"), F.get(names, F.col("prediction").cast("int")).alias("prediction"))


def _normal(seed: int, field: str):
    """A standard normal number by the Box-Muller transform of two MD5 sums of seed, id, field."""
    u = lambda k: (F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(seed), F.col("id").cast("string"), F.lit(field), F.lit(k))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1))


def noisy(data: DataFrame, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Features with normal noise of a share of their spread; the noise depends on id, feature and seed only."""
    spread = data.agg(*(F.stddev_samp(c).alias(c) for c in FEATURES))
    spread = F.broadcast(spread.select(*(F.col(c).alias(f"_{c}") for c in FEATURES)))
    return data.crossJoin(spread).select("id", "user_id", *((F.col(c) + _normal(seed, c) * F.col(f"_{c}") * share).alias(c) for c in FEATURES), "score")


def scored(model: PipelineModel, trips: DataFrame) -> DataFrame:
    """Class and confidence in percent of every trip; a missing feature is 0."""
    names = F.array(*map(F.lit, model.stages[0].labels))
    known = trips.select("id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES), "score")
    out = model.transform(known)
    return out.select("id", F.get(names, F.col("prediction").cast("int")).alias("prediction"), (F.array_max(vector_to_array("probability")) * 100).alias("confidence"))


def saved_and_loaded(data: DataFrame, path: str) -> PipelineModel:
    """Fits, writes model and metadata, and reads the model back."""
    model = pipeline(DecisionTreeClassifier(maxDepth=6, seed=42, featuresCol="features", labelCol="label_index")).fit(data)
    model.write().overwrite().save(f"{path}/model")
    spark = data.sparkSession
    spark.createDataFrame([(FEATURES, model.stages[0].labels)], "features array<string>, classes array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return PipelineModel.load(f"{path}/model")
