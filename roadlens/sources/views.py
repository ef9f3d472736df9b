"""The tables of the fleet, derived from the star schema at hand.

Select lists are SQL that Spark and other engines read alike, so a test can derive
the same rows elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCORE_POINTS = "(CASE WHEN max_rpm > 5000 THEN 2 ELSE 0 END + CASE WHEN brake_events > 5 THEN 2 ELSE 0 END + CASE WHEN avg_speed_kmph > 80 THEN 1 ELSE 0 END + CASE WHEN throttle_position > 70 THEN 1 ELSE 0 END)"
SCORE = f"(CASE WHEN {SCORE_POINTS} >= 3 THEN 'Risky' WHEN {SCORE_POINTS} >= 1 THEN 'Average' ELSE 'Good' END)"

_TRIPS = [
    "o_orderkey AS id",
    "CAST(floor(o_custkey / 4e0) AS BIGINT) AS user_id",
    "CAST(o_orderdate AS DATE) AS trip_date",
    "CAST((o_orderkey * 7919) % 2001 AS DOUBLE) / 1e1 + 5e-1 AS distance_km",
    "CAST((o_orderkey * 6007) % 1201 AS DOUBLE) / 1e1 AS avg_speed_kmph",
    "CAST((o_orderkey * 6007) % 1201 AS DOUBLE) / 1e1 + CAST((o_orderkey * 31) % 51 AS DOUBLE) AS max_speed",
    "CAST(1500 + (o_orderkey * 4801) % 5501 AS INT) AS max_rpm",
    "CAST((o_orderkey * 3571) % 3001 AS DOUBLE) / 1e2 AS fuel_consumed",
    "CAST((o_orderkey * 211) % 46 AS INT) AS brake_events",
    "CAST((o_orderkey * 523) % 601 AS DOUBLE) / 1e1 - 3e1 AS steering_angle",
    "CAST((o_orderkey * 617) % 351 AS DOUBLE) / 1e2 AS angular_velocity",
    "CAST((o_orderkey * 733) % 1001 AS DOUBLE) / 1e2 - 5e0 AS acceleration",
    "CAST(1 + o_orderkey % 6 AS INT) AS gear_position",
    "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 24e0 + CAST((o_orderkey * 829) % 221 AS DOUBLE) / 1e1 END AS tire_pressure",
    "CAST(20 + (o_orderkey * 977) % 81 AS DOUBLE) AS engine_load",
    "CAST((o_orderkey * 1093) % 1001 AS DOUBLE) / 1e1 AS throttle_position",
    "CAST((o_orderkey * 1201) % 1001 AS DOUBLE) / 1e1 AS brake_pressure",
    "CAST(1 + (o_orderkey * 1301) % 300 AS DOUBLE) AS trip_duration",
]
_TELEMETRY = [
    "event_id AS sample_id",
    "user_id",
    "ts",
    "CASE WHEN event_type = 'error' THEN NULL ELSE CAST((event_id * 37) % 1301 AS DOUBLE) / 1e1 END AS speed",
    "CAST(800 + (event_id * 389) % 5201 AS DOUBLE) AS rpm",
    "CAST((event_id * 53) % 101 AS DOUBLE) AS throttle",
    "CASE WHEN event_type = 'signup' THEN NULL ELSE CAST((event_id * 71) % 101 AS DOUBLE) END AS engine_load",
    "CAST(100 - event_id % 100 AS DOUBLE) AS fuel_level",
    "CAST((event_id * 17) % 900 AS DOUBLE) / 1e1 AS trip_distance",
    "8e0 + CAST((event_id * 29) % 2900 AS DOUBLE) / 1e2 AS latitude",
    "68e0 + CAST((event_id * 43) % 2900 AS DOUBLE) / 1e2 AS longitude",
    # sensors that only some files have
    "CASE WHEN user_id % 3 = 0 THEN CAST((event_id * 7) % 90 AS DOUBLE) END AS trip_time",
    "CASE WHEN user_id % 5 = 0 THEN CAST((event_id * 11) % 81 AS DOUBLE) / 1e1 - 4e0 END AS acceleration",
    "CASE WHEN event_id % 6 <> 0 THEN CAST(70 + (event_id * 13) % 51 AS DOUBLE) END AS coolant_temp",
    "CASE WHEN user_id % 7 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'Good' WHEN 1 THEN 'Average' ELSE 'Risky' END END AS driver_rating",
    "CASE WHEN user_id % 4 <> 1 THEN CAST((event_id * 19) % 401 AS DOUBLE) / 1e1 - 2e1 END AS steering_angle",
    "CASE WHEN user_id % 4 = 2 THEN CAST((event_id * 23) % 301 AS DOUBLE) / 1e2 END AS angular_velocity",
    "CASE WHEN user_id % 6 = 0 THEN CAST(1 + event_id % 6 AS DOUBLE) END AS gear_position",
    "CASE WHEN user_id % 2 = 0 THEN CAST(28 + event_id % 9 AS DOUBLE) END AS tire_pressure",
    "CASE WHEN user_id % 2 = 1 THEN CAST((event_id * 3) % 61 AS DOUBLE) END AS brake_pressure",
    "CONCAT(CAST((event_id * 53) % 101 AS STRING), ',', CAST(event_id % 10 AS STRING), ' %') AS raw_throttle",
    "CONCAT(CAST(800 + (event_id * 389) % 5201 AS STRING), ' RPM') AS raw_rpm",
    "CASE event_id % 4 WHEN 0 THEN 'mp09 ab1234' WHEN 1 THEN '(MH12-cd 5678)' WHEN 2 THEN 'ka 01  ef--9012' ELSE '' END AS raw_vehicle_number",
]
_MESSAGES = [
    "user_id AS conv_id",
    "event_id AS turn",
    "'user' AS role",
    "ts",
    """CASE event_id % 10
        WHEN 0 THEN CONCAT('How can I save fuel at ', CAST(event_id % 140 AS STRING), ' km/h?')
        WHEN 1 THEN CONCAT('My car used ', CAST(event_id % 60 AS STRING), ' liters over ', CAST(event_id % 300 AS STRING), ' km')
        WHEN 2 THEN 'There is a problem with the brake, it feels terrible'
        WHEN 3 THEN 'Please show me the maintenance schedule'
        WHEN 4 THEN 'Great advice, thanks! I love it'
        WHEN 5 THEN CONCAT('Engine hit ', CAST(event_id % 7000 AS STRING), ' rpm at 10:30')
        WHEN 6 THEN 'Compare my trip vs last week'
        WHEN 7 THEN 'What about rain and fog?'
        WHEN 8 THEN 'Hello'
        ELSE CONCAT('zzz ', event_type) END AS text""",
]
_ROUTES = [
    "id AS request_id",
    "user_id",
    "8e0 + CAST((id * 29) % 2900 AS DOUBLE) / 1e2 AS lat1",
    "68e0 + CAST((id * 43) % 2900 AS DOUBLE) / 1e2 AS lon1",
    "8e0 + CAST((id * 31) % 2900 AS DOUBLE) / 1e2 AS lat2",
    "68e0 + CAST((id * 47) % 2900 AS DOUBLE) / 1e2 AS lon2",
    "trip_date AS dep_date",
    "CAST(id % 24 AS INT) AS dep_hour",
]
_FUEL = [
    "id AS request_id",
    "user_id",
    "distance_km",
    "CASE id % 5 WHEN 0 THEN 'highway' WHEN 1 THEN 'city' WHEN 2 THEN 'mixed' WHEN 3 THEN 'rural' ELSE 'other' END AS route_type",
    "CASE id % 4 WHEN 0 THEN 'light' WHEN 1 THEN 'normal' WHEN 2 THEN 'heavy' ELSE 'other' END AS traffic",
    "CASE id % 5 WHEN 0 THEN 'clear' WHEN 1 THEN 'rain' WHEN 2 THEN 'fog' WHEN 3 THEN 'snow' END AS weather",
    "CASE WHEN id % 2 = 0 THEN 'day' ELSE 'night' END AS time_of_day",
]
_USERS = ["user_id AS id", "concat('user', CAST(user_id AS STRING)) AS username", "concat('MP09-AB', CAST(1000 + user_id % 9000 AS STRING)) AS vehicle_number"]

CTE = {
    "trips0": f"SELECT {', '.join(_TRIPS)} FROM orders",
    "trips": f"SELECT *, {SCORE} AS score FROM trips0",
    "telemetry": f"SELECT {', '.join(_TELEMETRY)} FROM events",
    "messages": f"SELECT {', '.join(_MESSAGES)} FROM events",
    "route_requests": f"SELECT {', '.join(_ROUTES)} FROM trips",
    "fuel_requests": f"SELECT {', '.join(_FUEL)} FROM trips",
    "users": f"SELECT {', '.join(_USERS)} FROM (SELECT DISTINCT user_id FROM trips) u",
}
_NEEDS = {"trips": ["trips0"], "route_requests": ["trips0", "trips"], "fuel_requests": ["trips0", "trips"], "users": ["trips0", "trips"]}


def with_views(sql: str, *names: str) -> str:
    """The SQL with the named views, and more of its own, as common table expressions: `sql` may begin with further ones and a comma."""
    needed = list(dict.fromkeys(n for name in names for n in [*_NEEDS.get(name, []), name]))
    head = "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in needed)
    return f"{head}{sql}" if sql.lstrip().startswith(",") else f"{head}\n{sql}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(*_TRIPS).selectExpr("*", f"{SCORE} AS score")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(*_TELEMETRY)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(*_MESSAGES)


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).selectExpr(*_ROUTES)


def fuel_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).selectExpr(*_FUEL)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).select("user_id").distinct().selectExpr(*_USERS)
