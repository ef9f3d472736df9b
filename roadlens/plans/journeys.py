"""Queries about fuel scenarios and route options."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import places
from ..functions.numbers import bands, rounded
from ..operators import fuel, routes
from ..operators import trips as T
from ..session import scratch
from ..sources import sinks
from ..sources import views as V
from .fleet import _EFFICIENCY, _PROFILES, profiles
from .registry import query

TRIP = V.with_views
_rows = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x:e}" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
_SCENARIOS = (
    f", ways(ord, scenario, multiplier, rating, rating_points, practical_points) AS (VALUES {_rows(fuel.SCENARIOS)}), by_route(scenario, route_type, by_route) AS (VALUES {_rows(fuel.ROUTE)}), by_traffic(scenario, traffic, by_traffic) AS (VALUES {_rows(fuel.TRAFFIC)})"
    ", s1 AS (SELECT f.*, w.*, 12e0 * multiplier * coalesce(by_route, 1e0) * coalesce(by_traffic, 1e0) AS kmpl FROM fuel_requests f CROSS JOIN ways w LEFT JOIN by_route r ON r.scenario = w.scenario AND r.route_type = f.route_type LEFT JOIN by_traffic t ON t.scenario = w.scenario AND t.traffic = f.traffic)"
    f", s2 AS (SELECT *, distance_km / kmpl AS litres FROM s1), s AS (SELECT *, {rounded(f'litres * {fuel.PRICE}', 2)} AS cost FROM s2)"
)
FUEL = lambda sql: TRIP(f"{_SCENARIOS} {sql}", "fuel_requests")


@query("fuel_scenarios", FUEL(f"SELECT request_id, scenario, {rounded('kmpl', 1)} AS kmpl, {rounded('litres', 2)} AS litres, cost, {rounded(f'litres * {fuel.CO2}', 2)} AS co2_kg, rating FROM s"))
def fuel_scenarios(spark, sf_dir):
    return fuel.table(V.fuel_requests(spark, sf_dir))


_spread = "worst_cost - best_cost"


@query("fuel_costs", FUEL(f"SELECT *, {rounded(_spread, 2)} AS savings, {rounded(f'({_spread}) * 20', 2)} AS monthly, {rounded(f'({_spread}) * 240', 2)} AS yearly FROM (SELECT request_id, max(CASE WHEN scenario = 'normal_driving' THEN cost END) AS normal_cost, min(cost) AS best_cost, max(cost) AS worst_cost, first(scenario ORDER BY cost, ord) AS best FROM s GROUP BY request_id) g"))
def fuel_costs(spark, sf_dir):
    return fuel.costs(V.fuel_requests(spark, sf_dir))


@query("fuel_best", FUEL(f", n AS (SELECT *, max(CASE WHEN scenario = 'normal_driving' THEN cost END) OVER (PARTITION BY request_id) AS normal FROM s), p AS (SELECT *, {rounded('normal - cost', 2)} AS saved FROM n), q AS (SELECT *, rating_points + practical_points + CASE WHEN saved > 0 THEN least(3e1, saved) ELSE 0e0 END AS points FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY points DESC, ord) AS place FROM q) SELECT request_id, scenario, points, saved FROM r WHERE place = 1"))
def fuel_best(spark, sf_dir):
    return fuel.best(V.fuel_requests(spark, sf_dir))


@query("fuel_tips", FUEL("SELECT request_id, CASE WHEN max(CASE WHEN scenario = 'normal_driving' THEN cost END) - max(CASE WHEN scenario = 'eco_driving' THEN cost END) > 20 THEN 'driving_style,' ELSE '' END || 'route_planning,vehicle_maintenance' AS tips FROM s GROUP BY request_id"))
def fuel_tips(spark, sf_dir):
    return fuel.tips(V.fuel_requests(spark, sf_dir))


_impact = bands("distance_km", [("> 100", "'high'"), ("< 20", "'low'")], "'medium'")
_note = bands("route_type", [("= 'highway'", "'steady_speeds'"), ("= 'city'", "'stop_and_go'")], "''")


@query("fuel_factors", TRIP(f"SELECT request_id, {_impact} AS distance_impact, {_note} AS route_note FROM fuel_requests", "fuel_requests"))
def fuel_factors(spark, sf_dir):
    return fuel.factors(V.fuel_requests(spark, sf_dir))


_points = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {p} ELSE 0 END" for c, p in {"efficiency": 10, "style": 5, "history": 10, "engine_size": 5, "vehicle_type": 5, "age": 5}.items())


@query("fuel_confidence", TRIP(f"{_PROFILES} SELECT user_id, least(95, 70 + {_points}) AS confidence FROM profiles", "trips"))
def fuel_confidence(spark, sf_dir):
    return fuel.confidence(profiles(spark, sf_dir))


# --- routes

_ROUTES = (
    f", profiles(ord, type, by_distance, kmh, by_fuel, base_score, bonus) AS (VALUES {_rows(routes.PROFILES)})"
    f", stats AS (SELECT user_id, 15e0 AS avg_fuel_efficiency, {rounded('avg(engine_load)')} AS avg_engine_load FROM trips GROUP BY user_id)"
    f", r0 AS (SELECT q.*, {routes.HAVERSINE} AS base_km, isodow(dep_date) >= 6 AS weekend, p.*, coalesce(avg_fuel_efficiency, 15e0) AS kmpl, coalesce(avg_engine_load, 5e1) AS load FROM route_requests q CROSS JOIN profiles p LEFT JOIN stats USING (user_id))"
    f", r1 AS (SELECT *, {routes.DELAY} AS delay, {routes.LEVEL} AS level, base_km * by_distance AS km FROM r0)"
    f", r2 AS (SELECT *, {routes.DELAY_MINUTES} AS delay_minutes, {rounded('greatest(1e-1, km / kmpl * by_fuel * (8e-1 + 4e-1 * (load / 5e1)))', 2)} AS fuel FROM r1)"
    f", r3 AS (SELECT *, {rounded('km', 1)} AS distance, {rounded('km / kmh * 6e1 * delay', 0)} AS minutes, {rounded(f'fuel * {routes.PRICE}', 2)} AS cost FROM r2)"
    f", r4 AS (SELECT *, {routes.SCORE} AS score FROM r3), r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, ord) AS place FROM r4)"
)
ROUTE = lambda sql: TRIP(f"{_ROUTES} {sql}", "trips", "route_requests")


def _stats(spark, sf_dir):
    return T.user_stats(V.trips(spark, sf_dir))


@query("haversine", TRIP(f"SELECT request_id, {rounded(routes.HAVERSINE)} AS km FROM route_requests", "route_requests"))
def haversine(spark, sf_dir):
    return routes.distances(V.route_requests(spark, sf_dir))


@query("route_fuel", ROUTE("SELECT request_id, type, fuel FROM r"))
def route_fuel(spark, sf_dir):
    return routes.fuel(V.route_requests(spark, sf_dir), _stats(spark, sf_dir)).select("request_id", "type", "fuel")


@query("route_traffic", ROUTE(f"SELECT request_id, type, level, delay, delay_minutes, {routes.CONGESTION} AS congestion FROM r"))
def route_traffic(spark, sf_dir):
    return routes.expanded(V.route_requests(spark, sf_dir)).select("request_id", "type", "level", "delay", "delay_minutes", F.expr(routes.CONGESTION).alias("congestion"))


@query("route_options", ROUTE(f"SELECT request_id, type, distance, minutes, fuel, cost, CASE WHEN type = 'eco' THEN {rounded('fuel * 15e-2 * 231e-2', 2)} END AS co2_cut, CASE WHEN type = 'fastest' THEN greatest(0e0, 45 - minutes) END AS minutes_saved FROM r"))
def route_options(spark, sf_dir):
    out = routes.options(V.route_requests(spark, sf_dir), _stats(spark, sf_dir))
    return out.select("request_id", "type", "distance", "minutes", "fuel", "cost", F.expr(f"CASE WHEN type = 'eco' THEN {rounded('fuel * 15e-2 * 231e-2', 2)} END").alias("co2_cut"), F.expr("CASE WHEN type = 'fastest' THEN greatest(0e0, 45 - minutes) END").alias("minutes_saved"))


@query("route_score", ROUTE("SELECT request_id, type, score, place FROM r"))
def route_score(spark, sf_dir):
    return routes.ranked(V.route_requests(spark, sf_dir), _stats(spark, sf_dir)).select("request_id", "type", "score", "place")


@query("route_pick", ROUTE(f", e AS ({_EFFICIENCY}), b AS (SELECT request_id, user_id, max(CASE WHEN place = 1 THEN type END) AS first, max(CASE WHEN place = 3 THEN cost END) - max(CASE WHEN place = 1 THEN cost END) AS saved, max(CASE WHEN place = 3 THEN minutes END) - max(CASE WHEN place = 1 THEN minutes END) AS minutes_saved FROM r GROUP BY request_id, user_id) SELECT request_id, CASE WHEN coalesce(km_per_l, 8e0) < 7 THEN 'eco' ELSE first END AS choice, {rounded('saved', 2)} AS fuel_savings, minutes_saved, {rounded('saved * 20', 2)} AS monthly_savings FROM b LEFT JOIN e USING (user_id)"))
def route_pick(spark, sf_dir):
    trips, users = V.trips(spark, sf_dir), V.users(spark, sf_dir)
    known = T.user_efficiency(trips, users, default=8.0)
    return routes.pick(V.route_requests(spark, sf_dir), _stats(spark, sf_dir), known)


@query("route_savings", ROUTE(f"SELECT r.request_id, r.type, {rounded('r.cost - e.cost', 2)} AS extra_cost, {rounded('r.fuel - e.fuel', 2)} AS extra_fuel, r.minutes - e.minutes AS extra_minutes FROM r JOIN r e ON r.request_id = e.request_id AND e.type = 'eco'"))
def route_savings(spark, sf_dir):
    return routes.savings(V.route_requests(spark, sf_dir), _stats(spark, sf_dir))


_NAMED = "CASE id % 4 WHEN 0 THEN ' Mumbai' WHEN 1 THEN 'NEW YORK' WHEN 2 THEN 'pune ' ELSE 'nowhere' END"


@query("city_lookup", TRIP(f", places(place, lat, lon) AS (VALUES {_rows(routes.PLACES)}), n AS (SELECT id, {_NAMED} AS name FROM trips) SELECT id, name, lat, lon FROM n LEFT JOIN places p ON trim(lower(n.name)) = p.place", "trips"))
def city_lookup(spark, sf_dir):
    return routes.located(V.trips(spark, sf_dir).selectExpr("id", f"{_NAMED} AS name")).select("id", "name", "lat", "lon")


_PLACE = lambda a, b: f"CAST({a} AS STRING) || ',' || CAST({b} AS STRING)"


@query("route_append", ROUTE(f"SELECT q.user_id, r.type || ' route' AS route_name, {_PLACE('q.lat1', 'q.lon1')} AS start_location, {_PLACE('q.lat2', 'q.lon2')} AS end_location, r.type AS route_type, r.distance AS distance_km, CAST(r.minutes AS INT) AS travel_time_minutes, r.fuel AS fuel_consumption, r.cost AS fuel_cost, CAST(r.score AS INT) AS efficiency_score, DATE '2001-08-01' AS saved_date FROM r JOIN route_requests q USING (request_id) WHERE r.place = 1"))
def route_append(spark, sf_dir):
    folder = scratch(spark)
    sinks.append_route(routes.saved(V.route_requests(spark, sf_dir), _stats(spark, sf_dir)), folder, "2001-08-01")
    return sinks.stored(spark, folder).withColumn("saved_date", F.to_date("saved_date"))


# --- places and paths as text

#: Texts of a sample's place: some malformed, some off the globe.
_PATHS = (
    "CASE sample_id % 7 WHEN 0 THEN 'path_to_gps_data' WHEN 1 THEN NULL WHEN 2 THEN '[95.5,10.25]' WHEN 3 THEN concat('[', CAST(latitude AS STRING), ',', CAST(longitude AS STRING))"
    " WHEN 4 THEN concat(' [ ', CAST(latitude AS STRING), ' ,', CAST(longitude AS STRING), '] ') ELSE concat('[', CAST(latitude AS STRING), ',', CAST(longitude AS STRING), ']') END"
)
_NUMBERS = r"^\s*\[\s*([+-]?[0-9]+(?:[.][0-9]+)?)\s*,\s*([+-]?[0-9]+(?:[.][0-9]+)?)\s*\]\s*$"
_PARSED = (
    f", texts AS (SELECT sample_id, {_PATHS} AS path FROM telemetry)"
    f", found AS (SELECT *, TRY_CAST(nullif(regexp_extract(path, '{_NUMBERS}', 1), '') AS DOUBLE) AS a, TRY_CAST(nullif(regexp_extract(path, '{_NUMBERS}', 2), '') AS DOUBLE) AS b FROM texts)"
    ", sound AS (SELECT sample_id, CASE WHEN abs(a) <= 90 AND abs(b) <= 180 THEN a END AS lat, CASE WHEN abs(a) <= 90 AND abs(b) <= 180 THEN b END AS lon FROM found)"
    " SELECT sample_id, lat, lon, '[' || CAST(lat AS STRING) || ',' || CAST(lon AS STRING) || ']' AS written FROM sound"
)


@query("gps_parse", TRIP(_PARSED, "telemetry"))
def gps_parse(spark, sf_dir):
    """A path's first point, and the path written again; what isn't a path is NULL."""
    points = V.telemetry(spark, sf_dir).selectExpr("sample_id", f"{_PATHS} AS path").select("sample_id", places.path(F.col("path")).alias("points"))
    first = F.get("points", F.lit(0))
    return points.select("sample_id", first["lat"].alias("lat"), first["lon"].alias("lon"), places.path_text(F.col("points")).alias("written"))


_LEG = lambda a, b: routes.HAVERSINE.replace("lat2", f"lat{b}").replace("lon2", f"lon{b}").replace("lat1", f"lat{a}").replace("lon1", f"lon{a}")
_VIA = "SELECT request_id, lat1, lon1, lat2 AS lat3, lon2 AS lon3, CAST(10 + request_id % 20 AS DOUBLE) AS lat2, CAST(70 + request_id % 20 AS DOUBLE) AS lon2 FROM route_requests"


@query("path_length", TRIP(f", via AS ({_VIA}) SELECT request_id, {rounded(f'{_LEG(1, 2)} + {_LEG(2, 3)}', 3)} AS km, CAST(3 AS INT) AS n_points FROM via", "route_requests"))
def path_length(spark, sf_dir):
    """Length of a path that is written as text, over a place on the way."""
    point = lambda lat, lon: F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    via = F.struct((10 + F.col("request_id") % 20).cast("double").alias("lat"), (70 + F.col("request_id") % 20).cast("double").alias("lon"))
    text = V.route_requests(spark, sf_dir).select("request_id", places.path_text(F.array(point("lat1", "lon1"), via, point("lat2", "lon2"))).alias("path"))
    points = text.select("request_id", places.path(F.col("path")).alias("points"))
    return points.withColumn("km", places.length_km(F.col("points"))).select("request_id", F.expr(rounded("km", 3)).alias("km"), F.size("points").alias("n_points"))
