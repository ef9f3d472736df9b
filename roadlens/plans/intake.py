"""Queries about ingestion: keys, validity, segments, features, files."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.rules import rules_sql
from ..operators import cleaning as C
from ..operators import scoring
from ..operators import segments as S
from ..session import scratch
from ..sources import sinks, telemetry_files
from ..sources import views as V
from .registry import query

TELE = lambda sql: V.with_views(sql, "telemetry")
GAP = "12 hours"
KEY, ORDER = ["user_id"], ["ts", "sample_id"]

# --- cleaning and keys

_number = lambda c: f"TRY_CAST(trim(replace(regexp_replace({c}, '%|km/h|mph|RPM|rpm|\\[|\\]|\\(|\\)|\\bA\\b', '', 'g'), ',', '.')) AS DOUBLE)"


@query("col_clean", TELE(f"SELECT sample_id, {_number('raw_throttle')} AS throttle, {_number('raw_rpm')} AS rpm FROM telemetry"))
def col_clean(spark, sf_dir):
    return V.telemetry(spark, sf_dir).select("sample_id", telemetry_files.number("raw_throttle").alias("throttle"), telemetry_files.number("raw_rpm").alias("rpm"))


_STANDARD = lambda c: f"trim(regexp_replace(trim(upper(regexp_replace({c}, '[^A-Za-z0-9 -]', '', 'g'))), '[\\s-]+', '-', 'g'), '-')"


@query("vehicle_std", TELE(f"SELECT sample_id, {_STANDARD('raw_vehicle_number')} AS vehicle_number FROM telemetry"))
def vehicle_std(spark, sf_dir):
    return V.telemetry(spark, sf_dir).select("sample_id", C.vehicle_standard(F.col("raw_vehicle_number")).alias("vehicle_number"))


@query("vehicle_check", TELE(f"SELECT sample_id, regexp_matches(replace({_STANDARD('raw_vehicle_number')}, '-', ''), '{C.PLATE}') AS ok FROM telemetry"))
def vehicle_check(spark, sf_dir):
    return V.telemetry(spark, sf_dir).select("sample_id", C.is_plate(F.replace(C.vehicle_standard(F.col("raw_vehicle_number")), F.lit("-"), F.lit(""))).alias("ok"))


_HEX = lambda k, n, size: f"CAST(concat('0x', substr(md5(concat('vehicle_', CAST(user_id AS STRING))), {k}, {n})) AS BIGINT) % {size}"
_GENERATED = f"concat([{', '.join(map(repr, C.STATES))}][{_HEX(1, 4, 10)} + 1], lpad(CAST({_HEX(5, 4, 99)} + 1 AS STRING), 2, '0'), '-', chr(CAST({_HEX(9, 2, 26)} + 65 AS INT)), chr(CAST({_HEX(11, 2, 26)} + 65 AS INT)), CAST({_HEX(13, 4, 9000)} + 1000 AS STRING))"
_VEHICLE_GIVEN = "CASE WHEN user_id % 3 = 0 THEN raw_vehicle_number WHEN user_id % 3 = 1 THEN ' - ' END"
_VEHICLE_FILE = "CASE WHEN sample_id % 2 = 0 THEN concat('log_mp09ab', CAST(1000 + user_id % 9000 AS STRING), '.csv') ELSE 'IDLE28.csv' END"


@query("vehicle_resolve", TELE(f"SELECT sample_id, coalesce(nullif({_STANDARD('given')}, ''), nullif(upper(regexp_extract(file, '(?i)({C.PLATE.strip('^$')})', 1)), ''), {_GENERATED}) AS vehicle_number FROM (SELECT sample_id, user_id, {_VEHICLE_GIVEN} AS given, {_VEHICLE_FILE} AS file FROM telemetry) t"))
def vehicle_resolve(spark, sf_dir):
    t = V.telemetry(spark, sf_dir).selectExpr("sample_id", "user_id", f"{_VEHICLE_GIVEN} AS given", f"{_VEHICLE_FILE} AS file")
    return t.select("sample_id", C.vehicle_number(F.col("given"), F.col("file"), F.col("user_id")).alias("vehicle_number"))


_HASH = lambda c, n: f"(CAST(concat('0x', substr(md5({c}), 1, 8)) AS BIGINT) % {n}) + 1"
_GIVEN = "CASE sample_id % 5 WHEN 0 THEN CAST(user_id AS STRING) ELSE 'n/a' END"
_FILE = "CASE sample_id % 5 WHEN 1 THEN concat('user_', CAST(user_id AS STRING), '.csv') WHEN 2 THEN concat('Driver', CAST(user_id AS STRING), '_log.csv') ELSE concat('trip', CAST(sample_id AS STRING), '.csv') END"
_NAMED = " , ".join(f"TRY_CAST(nullif(regexp_extract(lower(file), '{p}', 1), '') AS BIGINT)" for p in C.FILE_USER)


@query("user_id_resolve", TELE(f"SELECT sample_id, coalesce(TRY_CAST(given AS BIGINT), {_NAMED}, {_HASH('file', 1000)}) AS resolved FROM (SELECT sample_id, {_GIVEN} AS given, {_FILE} AS file FROM telemetry) t"))
def user_id_resolve(spark, sf_dir):
    t = V.telemetry(spark, sf_dir).selectExpr("sample_id", f"{_GIVEN} AS given", f"{_FILE} AS file")
    return t.select("sample_id", C.user_id(F.col("given"), F.col("file")).alias("resolved"))


_KEY = "concat_ws('_', CAST(sample_id AS STRING), CAST(user_id % 7 AS STRING), CAST(user_id AS STRING))"


@query("trip_key", TELE(f"SELECT sample_id, {_HASH(_KEY, 100000)} AS trip_key FROM telemetry"))
def trip_key(spark, sf_dir):
    t = V.telemetry(spark, sf_dir)
    return t.select("sample_id", C.trip_key(F.col("sample_id").cast("string"), F.col("user_id") % 7, F.col("user_id")).alias("trip_key"))


_ODD = "SELECT id, user_id, trip_date, CASE WHEN id % 11 = 0 THEN NULL ELSE distance_km * 12e0 END AS distance_km, CASE WHEN id % 13 = 0 THEN -1e0 ELSE avg_speed_kmph * 3e0 END AS avg_speed_kmph, trip_duration, score FROM trips"
_cut = lambda c, limit, to: f"CASE WHEN {c} > {limit} THEN {to} ELSE {c} END AS {c}"
_ERRORS = "concat_ws(',', " + ", ".join([f"CASE WHEN {c} IS NULL THEN 'missing {c}' END" for c in ("user_id", "trip_date", "distance_km", "avg_speed_kmph", "score")] + ["CASE WHEN trip_duration < 2 THEN 'too short' END", "CASE WHEN avg_speed_kmph < 0 THEN 'negative speed' END"]) + ")"


@query("trip_validate", V.with_views(f", odd AS ({_ODD}) SELECT id, {_cut('distance_km', '2e3', '2e3')}, {_cut('trip_duration', '144e1', '144e1')}, {_cut('avg_speed_kmph', '3e2', '2e2')}, {_ERRORS} AS errors FROM odd", "trips"))
def trip_validate(spark, sf_dir):
    odd = V.trips(spark, sf_dir).selectExpr(*[c.strip() for c in _split(_ODD)])
    return C.validated(odd).select("id", "distance_km", "trip_duration", "avg_speed_kmph", F.array_join("errors", ",").alias("errors"))


def _split(select: str) -> list[str]:
    """Columns of a flat select list without commas inside."""
    return select.removeprefix("SELECT ").partition(" FROM ")[0].split(",")


@query("users_upsert", V.with_views(", known AS (SELECT id FROM users WHERE id % 3 = 0) SELECT u.id, lower(regexp_replace(vehicle_number, '[^A-Za-z0-9]', '', 'g')) AS username, vehicle_number FROM users u ANTI JOIN known k ON u.id = k.id", "users"))
def users_upsert(spark, sf_dir):
    users = V.users(spark, sf_dir)
    return C.new_users(users.select("id", "vehicle_number"), users.filter("id % 3 = 0"))


@query("users_restandardised", V.with_views(f"SELECT count(*) FILTER (WHERE {_STANDARD('v')} IS DISTINCT FROM v) AS changed FROM (SELECT CASE WHEN id % 2 = 0 THEN lower(vehicle_number) ELSE vehicle_number END AS v FROM users) u", "users"))
def users_restandardised(spark, sf_dir):
    users = V.users(spark, sf_dir).withColumn("vehicle_number", F.expr("CASE WHEN id % 2 = 0 THEN lower(vehicle_number) ELSE vehicle_number END"))
    return C.restandardised(users)[1]


# --- segments

_LAG = "lag({}) OVER (PARTITION BY user_id ORDER BY ts, sample_id)"
_SEG_GAP = f", s0 AS (SELECT *, CASE WHEN ts > {_LAG.format('ts')} + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM telemetry), seg AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, sample_id) AS BIGINT) AS trip_index FROM s0)"
_SEG_RESET = f", s0 AS (SELECT *, CASE WHEN coalesce(trip_distance, 0e0) < {_LAG.format('coalesce(trip_distance, 0e0)')} - 1 THEN 1 ELSE 0 END AS fresh FROM telemetry), seg AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, sample_id) AS BIGINT) AS trip_index FROM s0)"
_SEG_STOP = (
    ", s0 AS (SELECT *, row_number() OVER w - 1 AS o, coalesce(speed, 0e0) <= 60 AS z FROM telemetry WINDOW w AS (PARTITION BY user_id ORDER BY ts, sample_id))"
    ", s1 AS (SELECT *, CASE WHEN z <> lag(z) OVER (PARTITION BY user_id ORDER BY o) THEN 1 ELSE 0 END AS flip, max(o) OVER (PARTITION BY user_id) AS final FROM s0)"
    ", s2 AS (SELECT *, sum(flip) OVER (PARTITION BY user_id ORDER BY o) AS island FROM s1)"
    ", s3 AS (SELECT *, min(o) OVER i AS st, least(max(o) OVER i + 1, final) AS en FROM s2 WINDOW i AS (PARTITION BY user_id, island))"
    ", s4 AS (SELECT *, z AND st > 0 AND en - st > 1 AS cut FROM s3)"
    ", s5 AS (SELECT *, cut OR (coalesce(lag(cut) OVER (PARTITION BY user_id ORDER BY o), false) AND NOT cut) AS gone, CAST(sum(CASE WHEN cut AND o = st THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY o) AS BIGINT) AS trip_index FROM s4)"
    ", s6 AS (SELECT *, count(*) OVER (PARTITION BY user_id, trip_index) AS size FROM s5 WHERE NOT gone), seg AS (SELECT * FROM s6 WHERE size >= 2)"
)
_SIZED = "SELECT user_id, trip_index, count(*) AS n_rows, count(*) >= 5 AS kept FROM seg GROUP BY user_id, trip_index"


def _samples(spark, sf_dir):
    return V.telemetry(spark, sf_dir)


@query("seg_gap", TELE(f"{_SEG_GAP} {_SIZED}"))
def seg_gap(spark, sf_dir):
    return S.sized(S.by_gap(_samples(spark, sf_dir), KEY, ORDER, GAP), KEY)


@query("seg_stop", TELE(f"{_SEG_STOP} {_SIZED}"))
def seg_stop(spark, sf_dir):
    return S.sized(S.by_stop(_samples(spark, sf_dir), KEY, ORDER, limit=1, speed=60.0), KEY)


@query("seg_reset", TELE(f"{_SEG_RESET} {_SIZED}"))
def seg_reset(spark, sf_dir):
    return S.sized(S.by_reset(_samples(spark, sf_dir), KEY, ORDER), KEY)


_BLANK = {"ts": "user_id % 4 <> 0", "speed": "user_id % 8 <> 0", "trip_distance": "user_id % 16 <> 0"}


def _blanked(spark, sf_dir):
    """Samples of some users without times, of some of those without speeds, and so on."""
    return _samples(spark, sf_dir).withColumns({c: F.when(F.expr(test), F.col(c)) for c, test in _BLANK.items()})


_AUTO = (
    ", tele AS (SELECT * REPLACE (" + ", ".join(f"CASE WHEN {t} THEN {c} END AS {c}" for c, t in _BLANK.items()) + ") FROM telemetry)"
    ", m AS (SELECT user_id, CASE WHEN bool_or(ts IS NOT NULL) AND count(*) >= 2 THEN 'gap' WHEN bool_or(speed IS NOT NULL) THEN 'stop' WHEN bool_or(trip_distance IS NOT NULL) THEN 'reset' ELSE 'whole' END AS method FROM tele GROUP BY user_id)"
    ", g AS (SELECT user_id, method, sample_id, CASE WHEN method = 'gap' AND ts > lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 WHEN method = 'reset' AND coalesce(trip_distance, 0e0) < lag(coalesce(trip_distance, 0e0)) OVER w - 1 THEN 1 ELSE 0 END AS fresh FROM tele JOIN m USING (user_id) WHERE method <> 'stop' WINDOW w AS (PARTITION BY user_id ORDER BY sample_id))"
    ", seg AS (SELECT user_id, method, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY sample_id) AS BIGINT) AS trip_index FROM g)"
    ", stopped AS (SELECT tele.* FROM tele JOIN m USING (user_id) WHERE method = 'stop')"
    + _SEG_STOP.replace("FROM telemetry", "FROM stopped").replace("ORDER BY ts, sample_id", "ORDER BY sample_id").replace("seg AS (", "stops AS (")
    + ", parts AS (SELECT user_id, method, trip_index FROM seg UNION ALL SELECT user_id, 'stop', trip_index FROM stops)"
    " SELECT method, count(*) AS n_samples, count(DISTINCT concat_ws('_', CAST(user_id AS STRING), CAST(trip_index AS STRING))) AS n_segments FROM parts GROUP BY method"
)


@query("seg_auto", TELE(_AUTO))
def seg_auto(spark, sf_dir):
    """How many samples and segments each method gives."""
    out = S.automatic(_blanked(spark, sf_dir), KEY, ["sample_id"], GAP, limit=1, speed=60.0)
    return out.groupBy("method").agg(F.count("*").alias("n_samples"), F.countDistinct("user_id", "trip_index").alias("n_segments"))


# --- features

_FEATURES = (
    f"{_SEG_GAP}, st AS (SELECT *, speed - last_value(speed IGNORE NULLS) OVER (PARTITION BY user_id, trip_index ORDER BY ts, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step FROM seg)"
    ", t0 AS (SELECT user_id, trip_index, count(*) AS n_rows, avg(speed) AS avg_speed, max(speed) AS max_speed, max(rpm) AS max_rpm, avg(throttle) AS throttle, avg(engine_load) AS engine_load, count(*) FILTER (WHERE step < -10) AS brake_events, avg(step) AS mean_step,"
    " arg_max(trip_time, sample_at) FILTER (WHERE trip_time IS NOT NULL) AS last_time, arg_min(driver_rating, sample_at) FILTER (WHERE driver_rating IS NOT NULL) AS rating, avg(acceleration) AS mean_acceleration, avg(coolant_temp) AS coolant, avg(steering_angle) AS mean_steering, avg(angular_velocity) AS mean_turn, avg(gear_position) AS gear, avg(tire_pressure) AS tire, avg(brake_pressure) AS brake,"
    " arg_max(trip_distance, sample_at) FILTER (WHERE trip_distance IS NOT NULL) AS last_distance, arg_min(fuel_level, sample_at) FILTER (WHERE fuel_level IS NOT NULL) AS fuel_first, arg_max(fuel_level, sample_at) FILTER (WHERE fuel_level IS NOT NULL) AS fuel_last,"
    " arg_min(latitude, sample_at) AS lat1, arg_min(longitude, sample_at) AS lon1, arg_max(latitude, sample_at) AS lat2, arg_max(longitude, sample_at) AS lon2, CAST(min(ts) AS DATE) AS day"
    " FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, sample_id) AS sample_at FROM st) s GROUP BY user_id, trip_index)"
    f", t1 AS (SELECT *, {S.DISTANCE} AS distance_km FROM t0 WHERE n_rows >= 5 AND avg_speed IS NOT NULL AND max_rpm IS NOT NULL AND throttle IS NOT NULL)"
    f", t AS (SELECT *, {S.FUEL} AS fuel_consumed, {S.LABEL} AS score, {S.GEAR} AS gear_position FROM t1)"
)
_R = rounded


def _features(spark, sf_dir):
    seg = S.by_gap(_samples(spark, sf_dir), KEY, ORDER, GAP).withColumn("sample_at", F.row_number().over(W.partitionBy(*KEY).orderBy(*ORDER)))
    return S.aggregated(seg, KEY, "sample_at", "2001-08-01")


_FEATURE_COLUMNS = (
    f"user_id, trip_index, n_rows, day AS trip_date, {_R('distance_km', 2)} AS distance_km, {_R('avg_speed', 2)} AS avg_speed_kmph, {_R('max_speed', 2)} AS max_speed, CAST(max_rpm AS INT) AS max_rpm, {_R('fuel_consumed', 3)} AS fuel_consumed, brake_events,"
    f" {_R('mean_steering', 2)} AS steering_angle, {_R(S.TURN, 3)} AS angular_velocity, {_R(S.ACCELERATION, 3)} AS acceleration, gear_position, {_R('tire', 1)} AS tire_pressure, {_R('brake', 2)} AS brake_pressure, {_R('coolant', 1)} AS coolant_temp,"
    f" {_R('engine_load', 1)} AS engine_load, {_R('throttle', 1)} AS throttle_position, {_R(S.DURATION, 2)} AS trip_duration, '[' || CAST(lat1 AS STRING) || ',' || CAST(lon1 AS STRING) || ']' AS gps_path, CAST(lat1 AS STRING) || ',' || CAST(lon1 AS STRING) AS start_location, CAST(lat2 AS STRING) || ',' || CAST(lon2 AS STRING) AS end_location, score"
)


@query("trip_features", TELE(f"{_FEATURES} SELECT {_FEATURE_COLUMNS} FROM t"))
def trip_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query("trip_fuel", TELE(f"{_FEATURES} SELECT user_id, trip_index, {_R('distance_km', 2)} AS distance_km, {_R('fuel_consumed', 3)} AS fuel_consumed FROM t"))
def trip_fuel(spark, sf_dir):
    return _features(spark, sf_dir).select("user_id", "trip_index", "distance_km", "fuel_consumed")


@query("trip_label", TELE(f"{_FEATURES} SELECT user_id, trip_index, score, brake_events FROM t"))
def trip_label(spark, sf_dir):
    return _features(spark, sf_dir).select("user_id", "trip_index", "score", "brake_events")


# --- missing values

_unit = lambda key, field: f"(CAST(CAST(concat('0x', substr(md5(concat_ws('_', {', '.join(f'CAST({k} AS STRING)' for k in key)}, '{field}')), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296e0)"
_flags = lambda fields: "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in fields) + ") AS imputed"
_SERIES = (
    ", holes AS (SELECT sample_id, user_id, speed, CASE WHEN sample_id % 9 > 0 THEN rpm END AS rpm, CASE WHEN sample_id % 7 > 0 THEN throttle END AS throttle FROM telemetry)"
    f", moved AS (SELECT sample_id, user_id, rpm, throttle, {_flags(['speed', 'rpm', 'throttle'])}, coalesce(speed, 30e0 + 40e0 * {_unit(['user_id'], 'speed')} + 10e0 * ({_unit(['user_id', 'sample_id'], 'noise')} - 5e-1)) AS speed FROM holes)"
    ", steps AS (SELECT *, speed - lag(speed) OVER (PARTITION BY user_id ORDER BY sample_id) AS rise FROM moved)"
    f" SELECT sample_id, user_id, speed, coalesce(rpm, greatest(6e2, least(7e3, 800 + speed * (30e0 + 10e0 * {_unit(['user_id'], 'rpm')})))) AS rpm,"
    " coalesce(throttle, greatest(0e0, least(1e2, CASE WHEN rise > 0 THEN rise * 5 + 20 ELSE greatest(10e0, speed * 3e-1) END))) AS throttle, imputed FROM steps"
)


@query("impute_series", TELE(_SERIES))
def impute_series(spark, sf_dir):
    t = _samples(spark, sf_dir).withColumn("rpm", F.when(F.col("sample_id") % 9 > 0, F.col("rpm"))).withColumn("throttle", F.when(F.col("sample_id") % 7 > 0, F.col("throttle")))
    return C.imputed_series(t, KEY, "sample_id").select("sample_id", "user_id", "speed", "rpm", "throttle", F.array_join("imputed", ",").alias("imputed"))


#: Values of some trips are taken away, and coordinates given to most.
_HOLES = {
    "steering_angle": "CASE WHEN id % 5 > 0 THEN steering_angle END",
    "angular_velocity": "CASE WHEN id % 10 > 0 THEN angular_velocity END",
    "gear_position": "CASE WHEN id % 7 > 0 THEN gear_position END",
    "engine_load": "CASE WHEN id % 6 > 0 THEN engine_load END",
    "latitude": "CASE WHEN id % 4 > 0 THEN CAST(8 + id % 29 AS DOUBLE) END",
    "longitude": "CASE WHEN id % 4 > 0 THEN CAST(68 + id % 29 AS DOUBLE) END",
}
_FILLED = ["steering_angle", "angular_velocity", "tire_pressure", "brake_pressure", "gear_position", "engine_load", "latitude", "longitude"]
_between = lambda field, lo, width: f"coalesce({field}, {lo} + {width} * {_unit(['id'], field)})"
_TRIP_FILL = (
    f", holes AS (SELECT id, avg_speed_kmph, throttle_position, tire_pressure, brake_pressure, {', '.join(f'{e} AS {c}' for c, e in _HOLES.items())} FROM trips)"
    f" SELECT id, {_between('steering_angle', '-2e1', '4e1')} AS steering_angle, coalesce(angular_velocity, {_between('steering_angle', '-2e1', '4e1')} * 1e-1) AS angular_velocity,"
    f" {_between('tire_pressure', '28e0', '8e0')} AS tire_pressure, {_between('brake_pressure', '2e1', '6e1')} AS brake_pressure, coalesce(gear_position, CASE WHEN avg_speed_kmph < 25 THEN 2 WHEN avg_speed_kmph < 50 THEN 3 ELSE 5 END) AS gear_position,"
    f" coalesce(engine_load, least(1e2, greatest(0e0, throttle_position * 8e-1 + (-1e1 + 2e1 * {_unit(['id'], 'engine_load')})))) AS engine_load,"
    f" {_between('latitude', '8e0', '29e0')} AS latitude, {_between('longitude', '68e0', '29e0')} AS longitude, {_flags(_FILLED)} FROM holes"
)


@query("impute_trip", V.with_views(_TRIP_FILL, "trips"))
def impute_trip(spark, sf_dir):
    t = V.trips(spark, sf_dir).withColumns({c: F.expr(e) for c, e in _HOLES.items()})
    return C.imputed_trip(t, ["id"]).select("id", *_FILLED, F.array_join("imputed", ",").alias("imputed"))


# --- files

def _as_files(spark, sf_dir) -> str:
    """The samples as CSV files under two headers and encodings, one for users of each remainder by 8; a file with too few columns and one of 0 bytes."""
    folder = scratch(spark)
    t = _samples(spark, sf_dir).withColumn("part", F.col("user_id") % 8)
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    one = t.filter("user_id % 2 = 0").select(
        "part", time.alias("Timestamp"), F.concat(F.col("speed").cast("string"), F.lit(" km/h")).alias("Vehicle Speed Sensor [km/h]"),
        F.col("raw_rpm").alias("Engine RPM [RPM]"), F.col("throttle").alias("Absolute Throttle Position [%]"), F.col("user_id").alias("User ID"),
    )
    two = t.filter("user_id % 2 = 1").select(
        "part", F.col("user_id").alias("driver_id"), F.col("speed").alias("VEHICLE_SPEED ()"), F.col("rpm").alias("ENGINE_RPM ()"),
        F.col("throttle").alias("THROTTLE ()"), F.col("engine_load").alias("Coolant Temperature(°C)"), time.alias("Time"),
    )
    one.repartition(4, "part").sortWithinPartitions("part", "User ID", "Timestamp").write.option("header", "true").partitionBy("part").csv(f"{folder}/dataset1")
    latin = two.repartition(4, "part").sortWithinPartitions("part", "driver_id", "Time").write.option("header", "true").option("encoding", "ISO-8859-1")
    latin.partitionBy("part").csv(f"{folder}/dataset2")
    t.select(F.col("user_id").alias("a"), F.col("speed").alias("b")).limit(3).coalesce(1).write.option("header", "true").csv(f"{folder}/dataset3")
    nothing = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/nothing.csv")
    nothing.getFileSystem(spark._jsc.hadoopConfiguration()).create(nothing).close()
    return folder


#: What `_as_files` writes, as rows of files.
_FILES = (
    "files AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'UTF-8' ELSE 'ISO-8859-1' END AS encoding, 'admitted' AS state, user_id % 8 AS part, count(*) AS n_rows FROM telemetry GROUP BY ALL"
    " UNION ALL SELECT 'UTF-8', 'too few columns', NULL, count(*) FROM (SELECT 1 FROM telemetry LIMIT 3) t UNION ALL SELECT NULL, 'zero bytes', NULL, 0)"
)


@query("csv_scan", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS n_speed FROM events GROUP BY user_id")
def csv_scan(spark, sf_dir):
    samples, _ = telemetry_files.read(spark, _as_files(spark, sf_dir))
    return samples.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count("*").alias("n"), F.count("speed").alias("n_speed"))


@query("encoding_split", TELE(f", {_FILES} SELECT encoding, state, count(*) AS n_files, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM files GROUP BY encoding, state"))
def encoding_split(spark, sf_dir):
    files = telemetry_files.manifest(spark, _as_files(spark, sf_dir))
    return files.groupBy("encoding", F.coalesce("reject_reason", F.lit("admitted")).alias("state")).agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"))


_INGESTED = (
    f", {_FILES}, g AS (SELECT *, CASE WHEN s > lag(s) OVER (PARTITION BY user_id ORDER BY s) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM (SELECT *, date_trunc('second', ts) AS s FROM telemetry) x)"
    ", seg AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, sample_id) AS trip_index FROM g)"
    ", made AS (SELECT count(*) AS trips FROM (SELECT 1 FROM seg GROUP BY user_id, trip_index HAVING count(*) >= 5 AND count(speed) > 0 AND count(rpm) > 0 AND count(throttle) > 0) x)"
    ", n AS (SELECT count(*) AS found, count(*) FILTER (WHERE state = 'admitted') AS processed, count(*) FILTER (WHERE state <> 'admitted') AS skipped FROM files)"
    " SELECT *, processed * 1e2 / nullif(found, 0) AS success_rate, trips / CAST(nullif(processed, 0) AS DOUBLE) AS trips_per_file FROM n, made"
)


@query("ingest_report", TELE(_INGESTED))
def ingest_report(spark, sf_dir):
    samples, files = telemetry_files.read(spark, _as_files(spark, sf_dir))
    s = samples.withColumn("ts", F.try_to_timestamp("timestamp")).withColumn("user_id", F.col("user_id").cast("long"))
    trips = S.aggregated(S.by_gap(s, ["source_file", "user_id"], ["ts", "ordinal"], GAP), ["source_file", "user_id"], "ordinal", "2001-08-01")
    return telemetry_files.report(files, samples, trips)


@query("export_roundtrip", V.with_views(f"SELECT {', '.join(sinks.EXPORT)} FROM trips WHERE user_id % 2 = 0", "trips"))
def export_roundtrip(spark, sf_dir):
    """All exported columns, read back from CSV."""
    trips = V.trips(spark, sf_dir)
    folder = scratch(spark)
    sinks.export(trips, trips.filter("user_id % 2 = 0"), folder)
    back = spark.read.option("header", "true").schema(sinks.exported(trips).schema).csv(folder)
    return back.select(*(F.col(f"`{name}`").alias(c) for c, name in sinks.EXPORT.items()))


@query("trip_append", V.with_views("SELECT trip_date, count(*) AS n FROM trips GROUP BY trip_date", "trips"))
def trip_append(spark, sf_dir):
    trips, folder = V.trips(spark, sf_dir), scratch(spark)
    sinks.append_trips(trips.repartition(F.date_format("trip_date", "yyyy-MM")), folder)
    return sinks.stored(spark, folder).groupBy("trip_date").agg(F.count("*").alias("n"))


@query("alert_append", V.with_views(f", a AS ({rules_sql(scoring.ALERTS, 'trips', 'id')}) SELECT code AS alert_type, count(*) AS n FROM (SELECT DISTINCT id, code FROM a) d GROUP BY code", "trips"))
def alert_append(spark, sf_dir):
    """Alerts appended twice are stored once."""
    rows, folder = scoring.alerts(V.trips(spark, sf_dir)), scratch(spark)
    for part in ("trip_id % 2 = 0", "true"):
        sinks.append_alerts(rows.filter(part), folder)
    return sinks.stored_alerts(spark, folder).groupBy("alert_type").agg(F.count("*").alias("n"))
