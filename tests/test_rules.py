"""Rules at, below and above their limits."""

import pytest
from pyspark.sql import functions as F

from roadlens.operators import anomaly, scoring, sentiment
from roadlens.operators import trips as T
from roadlens.sources import views as V

BASE = dict(id=1, user_id=1, trip_date=None, distance_km=100.0, avg_speed_kmph=60.0, max_speed=100.0, max_rpm=3000, fuel_consumed=5.0, brake_events=5, steering_angle=0.0, angular_velocity=0.0, acceleration=0.0, gear_position=3, tire_pressure=32.0, engine_load=50.0, throttle_position=50.0, brake_pressure=50.0, trip_duration=60.0)


def trips(spark, *changes):
    schema = "id long, user_id long, trip_date date, distance_km double, avg_speed_kmph double, max_speed double, max_rpm int, fuel_consumed double, brake_events int, steering_angle double, angular_velocity double, acceleration double, gear_position int, tire_pressure double, engine_load double, throttle_position double, brake_pressure double, trip_duration double"
    rows = [tuple((BASE | {"id": k} | c).values()) for k, c in enumerate(changes, 1)]
    return spark.createDataFrame(rows, schema).selectExpr("*", f"{V.SCORE} AS score")


CASES = [
    (dict(tire_pressure=28.0), []),
    (dict(tire_pressure=27.9), ["tire_pressure"]),
    (dict(tire_pressure=42.0), []),
    (dict(tire_pressure=42.1), ["tire_pressure"]),
    (dict(tire_pressure=None), []),
    (dict(engine_load=90.0), []),
    (dict(engine_load=90.5), ["engine_load"]),
    (dict(brake_events=15), []),
    (dict(brake_events=16), ["brake_events"]),
    (dict(brake_events=30), ["brake_events"]),
    (dict(brake_events=31), ["brake_events"]),
    (dict(max_rpm=6000), []),
    (dict(max_rpm=6001), ["high_rpm"]),
    (dict(fuel_consumed=0.0), []),
    (dict(fuel_consumed=12.5), []),
    (dict(fuel_consumed=12.6), ["fuel_efficiency"]),
    (dict(max_speed=120.0), []),
    (dict(max_speed=120.1), ["speeding"]),
    (dict(trip_duration=181.0, distance_km=49.0), ["idle_time"]),
    (dict(trip_duration=180.0, distance_km=49.0), []),
]


def test_alerts(spark):
    found = {r["trip_id"]: r["t"] for r in scoring.alerts(trips(spark, *(c for c, _ in CASES))).groupBy("trip_id").agg(F.collect_list("alert_type").alias("t")).collect()}
    assert [found.get(k, []) for k in range(1, len(CASES) + 1)] == [w for _, w in CASES]


def test_driving_score_of_null_is_unknown(spark):
    row = scoring.driving_score(trips(spark, dict(tire_pressure=None))).first()
    assert row["driving_score"] is None and row["behaviour"] == "Unknown"


def test_driving_score_by_hand(spark):
    # .1*(.6+.5+10/15+.5+.5+0) + .05*(1+1+1+.5+7+.5) = .2767 + .55
    assert scoring.driving_score(trips(spark, {})).first()["driving_score"] == pytest.approx(82.67, abs=0.01)


@pytest.mark.parametrize("change, points", [({}, 93 + 10), (dict(avg_speed_kmph=101.0), 68), (dict(avg_speed_kmph=29.0), 78), (dict(max_rpm=4001), 91), (dict(acceleration=4.1), 85), (dict(distance_km=0.0), 93)])
def test_mood(spark, change, points):
    # 70 +15 speed, +10 brakes per km, +8 gentle acceleration
    assert sentiment.moods(trips(spark, change)).first()["mood_score"] == min(100, points)


def test_anomalies_without_history(spark):
    out = anomaly.summary(trips(spark, dict(max_speed=121.0, max_rpm=4600))).first()
    assert (out["high"], out["medium"], out["risk"]) == (2, 0, 100)


def test_trend_needs_more_than_three(spark):
    out = sentiment.trend(trips(spark, {}, {}, {})).first()
    assert (out["trend"], out["n_trips"]) == ("insufficient", 3)


def test_noise_is_normal_and_fixed(spark, data):
    """Noise has the spread asked for, and the same values however the rows are dealt."""
    from roadlens.operators import classify
    from roadlens.sources import views

    rows = classify.prepared(views.trips(spark, data))
    field = classify.FEATURES[0]
    spread = rows.agg(F.stddev_samp(field)).first()[0]
    told = [{r["id"]: r[field] for r in classify.noisy(rows.repartition(n), 0.5).select("id", field).collect()} for n in (1, 7)]
    assert told[0] == pytest.approx(told[1])
    plain = {r["id"]: r[field] for r in rows.collect()}
    noise = [(told[0][k] - plain[k]) / spread for k in plain]
    mean = sum(noise) / len(noise)
    assert abs(mean) < 0.1 and abs((sum((x - mean) ** 2 for x in noise) / len(noise)) ** 0.5 - 0.5) < 0.1


def test_fuel_is_added_up_in_order_of_id(spark):
    """20.7 of this fuel is 22.5%, which a sum from the other end rounds to 23."""
    fuel = [20.7, 16.12, 24.13, 1.42, 19.68, 9.95]
    rows = trips(spark, *({"fuel_consumed": v} for v in fuel)).orderBy("id", ascending=False).coalesce(1)
    assert {r["id"]: r["share"] for r in T.fuel_share(rows).collect()}[1] == 22
    none = T.fuel_share(trips(spark, {"user_id": None, "fuel_consumed": 4.0})).collect()
    assert [r["share"] for r in none] == [100]
