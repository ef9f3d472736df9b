"""Queries about classification: data, folds, metrics, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import classify as L
from ..operators import saved_model, scoring, validation
from ..session import scratch
from ..sources import views as V
from .registry import query

_FEATURES = ", ".join(L.FEATURES)
_PREP = f", prep AS (SELECT id, user_id, {_FEATURES}, score FROM trips WHERE score IN ('Average', 'Good', 'Risky') AND " + " AND ".join(f"{c} IS NOT NULL" for c in L.FEATURES) + ")"
PREP = lambda sql: V.with_views(f"{_PREP} {sql}", "trips")
_ORDER = "PARTITION BY score ORDER BY md5(CAST(id AS STRING)), id"
#: A plain guess of a trip's class, so that metrics have something to measure.
GUESS = "CASE WHEN max_rpm > 5200 THEN 'Risky' WHEN avg_speed_kmph > 75 OR brake_events > 8 THEN 'Average' ELSE 'Good' END"
_GUESSED = f", guessed AS (SELECT score AS label, {GUESS} AS prediction FROM trips)"


def _data(spark, sf_dir):
    return L.prepared(V.trips(spark, sf_dir))


def _guessed(spark, sf_dir):
    return V.trips(spark, sf_dir).select(F.col("score").alias("label"), F.expr(GUESS).alias("prediction"))


@query("ml_prep", PREP("SELECT * FROM prep"))
def ml_prep(spark, sf_dir):
    return _data(spark, sf_dir)


_unit = lambda c: f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1e0)"


@query("ml_scaled", PREP(f"SELECT id, CAST(dense_rank() OVER (ORDER BY score) - 1 AS INT) AS label, {', '.join(f'{rounded(_unit(c))} AS {c}' for c in L.FEATURES)} FROM prep"))
def ml_scaled(spark, sf_dir):
    return L.scaled(_data(spark, sf_dir)).select("id", "label", *(F.expr(rounded(c)).alias(c) for c in L.FEATURES))


@query("ml_dups", PREP(f"SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) AS BIGINT) - count(*) AS n_duplicates FROM (SELECT count(*) AS n FROM prep GROUP BY {_FEATURES}, score) g"))
def ml_dups(spark, sf_dir):
    return L.duplicates(_data(spark, sf_dir))


@query("ml_classes", V.with_views("SELECT score, count(*) AS n FROM trips GROUP BY score", "trips"))
def ml_classes(spark, sf_dir):
    return L.classes(V.trips(spark, sf_dir))


@query("ml_split", PREP(f"SELECT id, score, row_number() OVER ({_ORDER}) <= floor(count(*) OVER (PARTITION BY score) * 3e-1 + 5e-1) AS test FROM prep"))
def ml_split(spark, sf_dir):
    return L.split(_data(spark, sf_dir)).select("id", "score", "test")


@query("ml_folds", PREP(f"SELECT id, score, CAST((row_number() OVER ({_ORDER}) - 1) % 5 AS INT) AS fold FROM prep"))
def ml_folds(spark, sf_dir):
    return L.folds(_data(spark, sf_dir)).select("id", "score", "fold")


@query("ml_metrics", V.with_views(
    f"{_GUESSED}, c AS (SELECT k.\"class\", count(*) FILTER (WHERE label = k.\"class\" AND prediction = k.\"class\") AS hits, count(*) FILTER (WHERE label = k.\"class\") AS support, count(*) FILTER (WHERE prediction = k.\"class\") AS guesses FROM guessed, (SELECT DISTINCT label AS \"class\" FROM guessed UNION SELECT DISTINCT prediction FROM guessed) k GROUP BY k.\"class\")"
    ", m AS (SELECT *, coalesce(hits / CAST(nullif(guesses, 0) AS DOUBLE), 0e0) AS precision, coalesce(hits / CAST(nullif(support, 0) AS DOUBLE), 0e0) AS recall FROM c)"
    ", f AS (SELECT \"class\", hits, support, precision, recall, coalesce(2e0 * precision * recall / nullif(precision + recall, 0e0), 0e0) AS f1 FROM m)"
    ", b AS (SELECT * FROM f UNION ALL SELECT 'all', CAST(sum(hits) AS BIGINT), CAST(sum(support) AS BIGINT), avg(precision), avg(recall), avg(f1) FROM f)"
    f" SELECT \"class\", support, {rounded('precision')} AS precision, {rounded('recall')} AS recall, {rounded('f1')} AS f1, {rounded('hits * 1e0 / nullif(support, 0)')} AS accuracy FROM b",
    "trips",
))
def ml_metrics(spark, sf_dir):
    return L.metrics(_guessed(spark, sf_dir))


@query("ml_confusion", V.with_views(f"{_GUESSED} SELECT label, " + ", ".join(f"count(*) FILTER (WHERE prediction = '{c}') AS \"{c}\"" for c in L.LABELS) + " FROM guessed GROUP BY label", "trips"))
def ml_confusion(spark, sf_dir):
    return L.confusion(_guessed(spark, sf_dir))


_WIDE = f", wide AS (SELECT id, user_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in L.WIDE_FEATURES)}, {scoring.HEURISTIC} AS score FROM trips WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in L.WIDE_FEATURES) + ")"


@query("ml_prep_wide", V.with_views(f"{_WIDE} SELECT * FROM wide", "trips"))
def ml_prep_wide(spark, sf_dir):
    return L.prepared_wide(V.trips(spark, sf_dir))


_LAP = "(row_number() OVER (ORDER BY n DESC, md5(CAST(user_id AS STRING)), user_id) - 1) % 10"


@query("ml_group_folds", PREP(f", users AS (SELECT user_id, count(*) AS n FROM prep GROUP BY user_id), dealt AS (SELECT *, {_LAP} AS lap FROM users) SELECT user_id, n, CAST(CASE WHEN lap < 5 THEN lap ELSE 9 - lap END AS INT) AS fold FROM dealt"))
def ml_group_folds(spark, sf_dir):
    return L.user_folds(_data(spark, sf_dir))


_uniform = lambda c, k: f"((CAST(concat('0x', substr(md5(concat_ws('_', '42', CAST(id AS STRING), '{c}', '{k}')), 1, 8)) AS BIGINT) + 5e-1) / 4294967296e0)"
_noise = lambda c: f"{c} + sqrt(-2 * ln({_uniform(c, 0)})) * cos(2 * pi() * {_uniform(c, 1)}) * stddev_samp({c}) OVER () * 5e-2"


@query("ml_noise", PREP("SELECT id, score, " + ", ".join(f"{rounded(_noise(c))} AS {c}" for c in L.FEATURES) + " FROM prep"))
def ml_noise(spark, sf_dir):
    return L.noisy(_data(spark, sf_dir)).select("id", "score", *(F.expr(rounded(c)).alias(c) for c in L.FEATURES))


# --- the saved tree: its rules are SQL

_TREE = saved_model.default()


@query("ml_score", V.with_views(f"SELECT id, {_TREE.class_sql()} AS prediction, {_TREE.confidence_sql()} AS confidence FROM trips", "trips"))
def ml_score(spark, sf_dir):
    return saved_model.applied(V.trips(spark, sf_dir))


@query("ml_saved_rules", V.with_views(f"SELECT score AS label, {_TREE.class_sql()} AS prediction, count(*) AS n FROM trips GROUP BY ALL", "trips"))
def ml_saved_rules(spark, sf_dir):
    """Rules written to shared storage, read back and applied."""
    folder = scratch(spark)
    saved_model.saved(_TREE, spark, folder)
    label, _ = saved_model.loaded(spark, folder).columns()
    return V.trips(spark, sf_dir).groupBy(F.col("score").alias("label"), label.alias("prediction")).agg(F.count("*").alias("n"))


# --- models: no SQL says these


@query("ml_compare")
def ml_compare(spark, sf_dir):
    return validation.compared(_data(spark, sf_dir))


@query("ml_cv")
def ml_cv(spark, sf_dir):
    return validation.cross_validated(L.folds(_data(spark, sf_dir)))


@query("ml_group_cv")
def ml_group_cv(spark, sf_dir):
    return validation.cross_validated(L.group_folds(_data(spark, sf_dir)), ["random_forest", "gradient_boosting"])


@query("ml_importance")
def ml_importance(spark, sf_dir):
    return validation.importance(_data(spark, sf_dir))


@query("ml_wide")
def ml_wide(spark, sf_dir):
    return validation.wide(L.prepared_wide(V.trips(spark, sf_dir)), L.WIDE_FEATURES)


@query("ml_sweep")
def ml_sweep(spark, sf_dir):
    return validation.swept(_data(spark, sf_dir))


@query("ml_grid")
def ml_grid(spark, sf_dir):
    return validation.grid_searched(_data(spark, sf_dir), scratch(spark))


@query("ml_save_load")
def ml_save_load(spark, sf_dir):
    data = _data(spark, sf_dir)
    model = L.saved_and_loaded(data, scratch(spark))
    return L.predicted(model, data).groupBy("label", "prediction").agg(F.count("*").alias("n"))
