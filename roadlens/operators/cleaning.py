"""Keys, vehicle numbers and validity of what comes from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Patterns and bounds.
PLATE = r"^[A-Z]{2}\d{2}[A-Z]{2}\d{4}$"
STATES = ["MP", "MH", "DL", "KA", "TN", "UP", "GJ", "RJ", "WB", "AP"]
FILE_USER = [r"user_?(\d+)", r"driver_?(\d+)", r"u(\d+)", r"d(\d+)"]
MAX_DISTANCE, MAX_DURATION, MIN_DURATION, MAX_SPEED = 2000.0, 1440.0, 2.0, 200.0


def vehicle_standard(column: Column) -> Column:
    """Upper case, words joined by dashes, nothing but letters, digits and dashes."""
    bare = F.upper(F.regexp_replace(column, r"[^A-Za-z0-9 -]", ""))
    return F.trim(F.regexp_replace(F.trim(bare), r"[\s-]+", "-"), F.lit("-"))


def is_plate(column: Column) -> Column:
    return F.upper(F.trim(column)).rlike(PLATE)


def generated_vehicle(user: Column) -> Column:
    """A number like MP09-AB1234 that depends on the user only."""
    digits = F.md5(F.concat(F.lit("vehicle_"), user.cast("string")))
    part = lambda k, n, size: F.conv(F.substring(digits, k, n), 16, 10).cast("long") % size
    letter = lambda k: F.char(part(k, 2, 26) + 65)
    state = F.element_at(F.array(*map(F.lit, STATES)), (part(1, 4, len(STATES)) + 1).cast("int"))
    district = F.lpad((part(5, 4, 99) + 1).cast("string"), 2, "0")
    return F.concat(state, district, F.lit("-"), letter(9), letter(11), (part(13, 4, 9000) + 1000).cast("string"))


def vehicle_number(given: Column, file_name: Column, user: Column) -> Column:
    """The standard form of a given number, else the plate in the file's name, else a generated one; nothing but signs is no number."""
    plate = F.upper(F.regexp_extract(file_name, f"(?i)({PLATE.strip('^$')})", 1))
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(vehicle_standard(given)), some(plate), generated_vehicle(user))


def hashed_id(column: Column, size: int) -> Column:
    """A number from 1 to size by the first eight hex digits of an MD5."""
    return F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long") % size + 1


def user_id(given: Column, file_name: Column) -> Column:
    """A given number, else one that the file's name holds, else a hash of the name."""
    from_name = [F.nullif(F.regexp_extract(F.lower(file_name), p, 1), F.lit("")).try_cast("long") for p in FILE_USER]
    return F.coalesce(given.try_cast("long"), *from_name, hashed_id(file_name, 1000))


def trip_key(file: Column, trip: Column, user: Column) -> Column:
    return hashed_id(F.concat_ws("_", file, trip.cast("string"), user.cast("string")), 100_000)


def wide_trip_key(file: Column, trip: Column, user: Column) -> Column:
    """64 bits: with 100 000 keys a few hundred trips already collide."""
    return F.xxhash64(file, trip, user)


def validated(trips: DataFrame) -> DataFrame:
    """Trips with speeds, distances and durations cut at their bounds, and why a trip is rejected, if so."""
    required = ["user_id", "trip_date", "distance_km", "avg_speed_kmph", "score"]
    tests = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    tests += [F.when(F.col("trip_duration") < MIN_DURATION, F.lit("too short")), F.when(F.col("avg_speed_kmph") < 0, F.lit("negative speed"))]
    errors = F.array_compact(F.array(*tests))
    cut = lambda c, limit, to: F.when(F.col(c) > limit, to).otherwise(F.col(c))
    return trips.withColumn("errors", errors).withColumns({"distance_km": cut("distance_km", MAX_DISTANCE, MAX_DISTANCE), "trip_duration": cut("trip_duration", MAX_DURATION, MAX_DURATION), "avg_speed_kmph": cut("avg_speed_kmph", 300.0, MAX_SPEED)})


def new_users(found: DataFrame, users: DataFrame) -> DataFrame:
    """Users (id, vehicle_number) that aren't known yet, with a name from their vehicle."""
    name = F.lower(F.regexp_replace("vehicle_number", r"[^A-Za-z0-9]", ""))
    return found.dropDuplicates(["id"]).join(users.select("id"), "id", "left_anti").select("id", name.alias("username"), "vehicle_number")


def restandardised(users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users with standard vehicle numbers, and how many of them changed."""
    out = users.withColumn("_new", vehicle_standard(F.col("vehicle_number")))
    changed = out.agg(F.count_if(~F.col("_new").eqNullSafe(F.col("vehicle_number"))).alias("changed"))
    return out.withColumn("vehicle_number", F.col("_new")).drop("_new"), changed


def unit(key: list[str], field: str) -> Column:
    """A number from 0 to 1 that depends on a row's key and the field only."""
    digits = F.substring(F.md5(F.concat_ws("_", *(F.col(c).cast("string") for c in key), F.lit(field))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


def imputed_trip(trips: DataFrame, key: list[str]) -> DataFrame:
    """Trips whose missing sensors, and coordinates if they have such columns, are filled by rule; `imputed` names what was filled."""
    between = lambda field, lo, hi: F.lit(lo) + F.lit(hi - lo) * unit(key, field)
    gear = F.when(F.col("avg_speed_kmph") < 25, 2).when(F.col("avg_speed_kmph") < 50, 3).otherwise(5)
    steering = F.coalesce("steering_angle", between("steering_angle", -20.0, 20.0))
    fill = {
        "steering_angle": steering,
        "angular_velocity": steering * 0.1,
        "tire_pressure": between("tire_pressure", 28.0, 36.0),
        "brake_pressure": between("brake_pressure", 20.0, 80.0),
        "gear_position": gear,
        "engine_load": F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("throttle_position") * 0.8 + between("engine_load", -10.0, 10.0))),
    }
    fill |= {c: between(c, *range_) for c, range_ in {"latitude": (8.0, 37.0), "longitude": (68.0, 97.0)}.items() if c in trips.columns}
    flags = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in fill)))
    return trips.withColumn("imputed", flags).withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def imputed_series(samples: DataFrame, key: list[str], order: str) -> DataFrame:
    """Samples with speed, rpm and throttle filled from each other; `imputed` names what was filled."""
    flags = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("speed", "rpm", "throttle"))))
    base = 30.0 + 40.0 * unit(key, "speed")
    filled = samples.withColumn("imputed", flags).withColumn("speed", F.coalesce("speed", base + 10.0 * (unit([*key, order], "noise") - 0.5)))
    rise = F.col("speed") - F.lag("speed").over(W.partitionBy(*key).orderBy(order))
    throttle = F.when(rise > 0, rise * 5 + 20).otherwise(F.greatest(F.lit(10.0), F.col("speed") * 0.3))
    bound = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    rpm = bound(800 + F.col("speed") * (30.0 + 10.0 * unit(key, "rpm")), 600.0, 7000.0)
    return filled.withColumns({"throttle": F.coalesce("throttle", bound(throttle, 0.0, 100.0)), "rpm": F.coalesce("rpm", rpm)})
