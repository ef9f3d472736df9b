"""Places and paths as text: `lat,lon`, and `[lat,lon]` for each point of a path, with commas between.

Parsing is strict: text that isn't wholly of the form, or that names a point off the
globe, is NULL, never half a path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms, and the radius of the earth in km.
NUMBER = r"\s*[+-]?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?\s*"
PLACE = f"{NUMBER},{NUMBER}"
PATH = rf"\s*\[{PLACE}\](?:\s*,\s*\[{PLACE}\])*\s*"
RADIUS = 6371.0
POINT = "struct<lat: double, lon: double>"


def place(text: Column) -> Column:
    """(lat, lon) of `lat,lon`."""
    parts = F.split(text, ",")
    lat, lon = (F.trim(F.get(parts, k)).try_cast("double") for k in (0, 1))
    sound = text.rlike(f"^{PLACE}$") & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(sound, F.struct(lat.alias("lat"), lon.alias("lon")))


def path(text: Column) -> Column:
    """The points of a path, in order."""
    points = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\]\[]*)\]"), F.lit(1)), place)
    return F.when(text.rlike(f"^{PATH}$") & F.forall(points, lambda p: p.isNotNull()), points)


def place_text(lat: Column, lon: Column) -> Column:
    """`lat,lon`; NULL if either is."""
    return F.concat(lat.cast("string"), F.lit(","), lon.cast("string"))


def path_text(points: Column) -> Column:
    """What `path` reads; NULL for no points."""
    texts = F.transform(points, lambda p: F.concat(F.lit("["), place_text(p["lat"], p["lon"]), F.lit("]")))
    return F.when(F.size(points) > 0, F.array_join(texts, ","))


def distance_km(a: Column, b: Column) -> Column:
    """Great-circle distance of two points."""
    turn = F.pow(F.sin(F.radians(b["lat"] - a["lat"]) / 2), F.lit(2)) + F.cos(F.radians(a["lat"])) * F.cos(F.radians(b["lat"])) * F.pow(F.sin(F.radians(b["lon"] - a["lon"]) / 2), F.lit(2))
    return 2 * RADIUS * F.atan2(F.sqrt(turn), F.sqrt(1 - turn))


def length_km(points: Column) -> Column:
    """Sum of the distances from point to point; 0 for one point, NULL for NULL."""
    legs = F.transform(F.slice(points, 2, F.size(points)), lambda p, k: distance_km(F.get(points, k), p))
    return F.when(points.isNotNull(), F.aggregate(legs, F.lit(0.0), lambda total, km: total + km))
