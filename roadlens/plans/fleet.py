"""Queries about trips: relational, scores, anomalies, moods, wear, recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import ratio, rounded
from ..functions.rules import rules_sql
from ..operators import anomaly, history, maintenance, recommend, saved_model, scoring, sentiment
from ..operators import trips as T
from ..sources import views as V
from .registry import query

AS_OF = "2001-08-01"
TRIP = V.with_views
_RANKED = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY trip_date DESC, id DESC) AS rank FROM trips)"
_ALERTS = f", alerts AS (SELECT id AS trip_id, user_id, code AS alert_type, severity, text AS title, note AS icon, value, trip_date AS ts, id % 3 = 0 AS resolved FROM ({rules_sql(scoring.ALERTS, 'trips', 'id', 'user_id', 'trip_date')}) a)"


def _alerts(spark, sf_dir):
    return scoring.alerts(V.trips(spark, sf_dir))


@query("recent_trips", TRIP(f"{_RANKED} SELECT {', '.join(T.TRIP_COLUMNS)}, rank FROM ranked WHERE rank <= 15", "trips"))
def recent_trips(spark, sf_dir):
    return T.latest(V.trips(spark, sf_dir).select(*T.TRIP_COLUMNS), 15)


@query("valid_trips", TRIP("SELECT id, user_id, distance_km, avg_speed_kmph, max_rpm FROM trips WHERE distance_km > 0 AND avg_speed_kmph > 0 AND max_rpm IS NOT NULL", "trips"))
def valid_trips(spark, sf_dir):
    return T.valid(V.trips(spark, sf_dir)).select("id", "user_id", "distance_km", "avg_speed_kmph", "max_rpm")


@query("open_alerts", TRIP(f"{_ALERTS} SELECT user_id, count(*) AS open_alerts FROM alerts WHERE NOT resolved AND ts >= DATE '{AS_OF}' - INTERVAL 30 DAY GROUP BY user_id", "trips"))
def open_alerts(spark, sf_dir):
    return T.open_alerts(_alerts(spark, sf_dir), AS_OF)


@query("recent_alerts", TRIP(f"{_ALERTS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, trip_id DESC, alert_type DESC) AS rank FROM alerts WHERE NOT resolved) a WHERE rank <= 5", "trips"))
def recent_alerts(spark, sf_dir):
    return T.latest_alerts(_alerts(spark, sf_dir))


@query("trip_lookup", TRIP("SELECT id, user_id, trip_date, distance_km, score FROM trips WHERE id = 7 AND user_id = (SELECT min(user_id) FROM trips WHERE id = 7)", "trips"))
def trip_lookup(spark, sf_dir):
    trips = V.trips(spark, sf_dir).filter("id = 7")
    owner = trips.agg(F.min("user_id").alias("owner"))
    return trips.join(owner, F.col("user_id") == F.col("owner")).select("id", "user_id", "trip_date", "distance_km", "score")


@query("chat_context", TRIP(f"{_RANKED} SELECT u.id AS user_id, vehicle_number, rank, r.id AS trip_id, distance_km, avg_speed_kmph FROM users u LEFT JOIN ranked r ON u.id = r.user_id AND r.rank <= 10", "trips", "users"))
def chat_context(spark, sf_dir):
    return T.chat_context(V.trips(spark, sf_dir), V.users(spark, sf_dir))


@query("trip_counts", TRIP("SELECT user_id, count(*) AS n_trips FROM trips GROUP BY user_id", "trips"))
def trip_counts(spark, sf_dir):
    return V.trips(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_trips"))


@query("user_stats", TRIP(f"SELECT user_id, 15e0 AS avg_fuel_efficiency, CASE WHEN coalesce(avg(engine_load), 0e0) = 0e0 THEN 5e1 ELSE {rounded('avg(engine_load)')} END AS avg_engine_load, count(*) FILTER (WHERE distance_km > 0) AS total_trips FROM trips GROUP BY user_id", "trips"))
def user_stats(spark, sf_dir):
    return T.user_stats(V.trips(spark, sf_dir))


_EFFICIENCY = f"SELECT user_id, {rounded('avg(distance_km / fuel_consumed)')} AS km_per_l FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY trip_date DESC, id DESC) AS rank FROM trips WHERE fuel_consumed > 0) f WHERE rank <= 10 GROUP BY user_id"


@query("user_efficiency", TRIP(f"SELECT u.id AS user_id, coalesce(km_per_l, 12e0) AS km_per_l FROM users u LEFT JOIN ({_EFFICIENCY}) e ON u.id = e.user_id", "trips", "users"))
def user_efficiency(spark, sf_dir):
    return T.user_efficiency(V.trips(spark, sf_dir), V.users(spark, sf_dir))


_kpi = lambda e: rounded(f"coalesce({e}, 0e0)", 1)


@query("kpis", TRIP(f"SELECT {_kpi('sum(distance_km)')} AS total_distance, {_kpi('avg(avg_speed_kmph)')} AS mean_speed, {_kpi('sum(fuel_consumed)')} AS total_fuel, count(*) AS n_trips FROM trips", "trips"))
def kpis(spark, sf_dir):
    return T.indicators(V.trips(spark, sf_dir))


@query("range_filter", TRIP("SELECT id, trip_date, distance_km, avg_speed_kmph FROM trips WHERE trip_date >= DATE '1997-01-01' AND trip_date <= DATE '1999-12-31' AND distance_km >= 20 AND distance_km <= 150 AND avg_speed_kmph <= 90", "trips"))
def range_filter(spark, sf_dir):
    return T.in_range(V.trips(spark, sf_dir), "1997-01-01", "1999-12-31", (20, 150), (0, 90)).select("id", "trip_date", "distance_km", "avg_speed_kmph")


@query("trip_efficiency", TRIP(f"SELECT id, {rounded(ratio('distance_km', 'fuel_consumed', '0e0'), 2)} AS km_per_l FROM trips", "trips"))
def trip_efficiency(spark, sf_dir):
    return T.efficiency(V.trips(spark, sf_dir))


@query("fuel_share", TRIP(f"SELECT id, user_id, {rounded(ratio('fuel_consumed * 1e2', 'total', '0e0'), 0)} AS share FROM (SELECT *, sum(fuel_consumed) OVER (PARTITION BY user_id) AS total FROM trips) t", "trips"))
def fuel_share(spark, sf_dir):
    return T.fuel_share(V.trips(spark, sf_dir))


@query("engine_load_gauge", TRIP("SELECT user_id, max(engine_load) AS max_load, 100 - max(engine_load) AS remaining FROM trips GROUP BY user_id", "trips"))
def engine_load_gauge(spark, sf_dir):
    return T.load_gauge(V.trips(spark, sf_dir))


@query("trip_cost", TRIP(f"SELECT id, {rounded('fuel_consumed * 15e-1 * 9e1', 2)} AS cost FROM trips", "trips"))
def trip_cost(spark, sf_dir):
    return T.trip_cost(V.trips(spark, sf_dir))


_MISSING = "list_filter([" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in T.REQUIRED) + "], lambda x: x IS NOT NULL)"


@query("missing_fields", TRIP(f"SELECT id, array_to_string({_MISSING}, ',') AS missing, len({_MISSING}) AS n_missing FROM trips", "trips"))
def missing_fields(spark, sf_dir):
    return T.missing_fields(V.trips(spark, sf_dir))


@query("trip_series", TRIP(f"{_RANKED} SELECT id, user_id, trip_date, rank AS place, distance_km, avg_speed_kmph, max_speed, max_rpm, fuel_consumed, brake_events, engine_load, throttle_position, trip_duration FROM ranked", "trips"))
def trip_series(spark, sf_dir):
    return T.series(V.trips(spark, sf_dir))


# --- scores and alerts

_SCORED = f", scored AS (SELECT *, {scoring.DRIVING} AS driving_raw FROM trips)"


@query("driving_score", TRIP(f"{_SCORED} SELECT id, user_id, {rounded('driving_raw', 2)} AS driving_score, {scoring.BEHAVIOUR} AS behaviour FROM scored", "trips"))
def driving_score(spark, sf_dir):
    return scoring.driving_score(V.trips(spark, sf_dir))


@query("heuristic_label", TRIP(f"SELECT id, {scoring.HEURISTIC} AS label FROM trips", "trips"))
def heuristic_label(spark, sf_dir):
    return scoring.heuristic_label(V.trips(spark, sf_dir))


@query("alerts", TRIP(f"{_ALERTS} SELECT * FROM alerts", "trips"))
def alerts(spark, sf_dir):
    return _alerts(spark, sf_dir)


_STATE = "CASE WHEN coalesce(n, 0) = 0 THEN 'optimal' WHEN critical THEN 'critical' WHEN warning THEN 'attention' ELSE 'minor' END"
_WORST = ", worst AS (SELECT trip_id, count(*) AS n, bool_or(severity = 'critical') AS critical, bool_or(severity = 'warning') AS warning, string_agg(alert_type, ',' ORDER BY ord) AS alerts FROM (SELECT id AS trip_id, code AS alert_type, severity, ord FROM (" + rules_sql(scoring.ALERTS, "trips", "id", "user_id", "trip_date") + ") r) a GROUP BY trip_id)"


@query("health_rollup", TRIP(f"{_WORST} SELECT id, coalesce(n, 0) AS n_alerts, {_STATE} AS health FROM trips t LEFT JOIN worst w ON t.id = w.trip_id", "trips"))
def health_rollup(spark, sf_dir):
    trips = V.trips(spark, sf_dir)
    return scoring.health(trips, scoring.alerts(trips))


_ADVICE = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scoring.ADVICE.items()) + f" ELSE '{scoring.ADVICE['Unknown']}' END"


@query("behaviour_advice", TRIP(f"{_SCORED}, labelled AS (SELECT id, score, {scoring.BEHAVIOUR} AS behaviour FROM scored) SELECT id, {_ADVICE('score')} AS score_advice, {_ADVICE('behaviour')} AS behaviour_advice FROM labelled", "trips"))
def behaviour_advice(spark, sf_dir):
    return scoring.behaviour_advice(V.trips(spark, sf_dir))


_TREE = saved_model.default()
_REPORT = (
    f"{_SCORED}{_WORST}, report AS (SELECT id, user_id, score, {rounded('driving_raw', 2)} AS driving_score, {scoring.BEHAVIOUR} AS behaviour, coalesce(n, 0) AS n_alerts, coalesce(alerts, '') AS alerts, {_STATE} AS health, len({_MISSING}) AS n_missing,"
    f" {_TREE.class_sql()} AS c, {_TREE.confidence_sql()} AS p FROM scored t LEFT JOIN worst w ON t.id = w.trip_id)"
    ", judged AS (SELECT * EXCLUDE (c, p), CASE WHEN n_missing = 0 THEN c ELSE 'Unknown' END AS model_class, CASE WHEN n_missing = 0 THEN p ELSE 0e0 END AS confidence FROM report)"
    f" SELECT *, CASE WHEN n_missing = 0 THEN concat(health, '; ', {_ADVICE('model_class')}) ELSE 'insufficient data' END AS advice FROM judged"
)


@query("trip_report", TRIP(_REPORT, "trips"))
def trip_report(spark, sf_dir):
    return scoring.trip_report(V.trips(spark, sf_dir))


_SHARES = ", ".join(f"{rounded(f'avg(CASE WHEN score = {label!r} THEN 1e0 ELSE 0e0 END)')} AS {name}" for name, label, _ in scoring.SHARES)
_FLAG = "CASE " + " ".join(f"WHEN {name} >= {limit} THEN '{name}'" for name, _, limit in scoring.SHARES) + " ELSE 'none' END"


@query("class_share", TRIP(f"SELECT *, {_FLAG} AS flag FROM (SELECT user_id, {_SHARES} FROM trips GROUP BY user_id) s", "trips"))
def class_share(spark, sf_dir):
    return scoring.class_share(V.trips(spark, sf_dir))


# --- anomalies

_TRAILING = ", hist AS (SELECT *, " + ", ".join(f"{sql} OVER w AS {n}" for n, sql in history.MEANS.items()) + " FROM trips WINDOW w AS (PARTITION BY user_id ORDER BY trip_date, id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"
_SERVED = (
    f"{_RANKED}, kept AS (SELECT *, max(rank) OVER (PARTITION BY user_id) AS n FROM ranked WHERE rank <= 20), old AS (SELECT user_id, "
    + ", ".join(f"{sql} AS {n}" for n, sql in history.MEANS.items())
    + " FROM kept WHERE rank > n - 10 GROUP BY user_id), hist AS (SELECT t.*, h_speed, h_rpm, h_kmpl FROM trips t LEFT JOIN old USING (user_id))"
)
_FOUND = lambda rules: f"SELECT id, user_id, ord, code, severity, value, {rounded('baseline')} AS baseline FROM ({rules_sql(rules, 'hist', 'id', 'user_id')}) r"


def _anomalies(rules, mode="trailing"):
    def run(spark, sf_dir):
        return anomaly.found(V.trips(spark, sf_dir), rules, mode).withColumn("baseline", F.expr(rounded("baseline")))

    return run


for _name, _rules in (("speed", anomaly.SPEED), ("rpm", anomaly.RPM), ("brake", anomaly.BRAKE), ("fuel", anomaly.FUEL)):
    query(f"anomaly_{_name}", TRIP(f"{_TRAILING} {_FOUND(_rules)}", "trips"))(_anomalies(_rules))
query("anomaly_served", TRIP(f"{_SERVED} {_FOUND(anomaly.ALL)}", "trips"))(_anomalies(anomaly.ALL, "served"))

_SUMMARY = f"{_TRAILING}, found AS ({_FOUND(anomaly.ALL)}), per AS (SELECT id, count(*) AS total, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'high') AS high, list(code ORDER BY ord) FILTER (WHERE severity = 'high') AS highs, list(code ORDER BY ord) FILTER (WHERE severity = 'medium') AS mediums FROM found GROUP BY id), a AS (SELECT t.id, t.user_id, coalesce(total, 0) AS total, coalesce(low, 0) AS low, coalesce(medium, 0) AS medium, coalesce(high, 0) AS high, highs, mediums FROM trips t LEFT JOIN per USING (id))"


@query("anomaly_risk", TRIP(f"{_SUMMARY} SELECT id, user_id, total, least(100, 10 * (low + 3 * medium + 5 * high)) AS risk FROM a", "trips"))
def anomaly_risk(spark, sf_dir):
    return anomaly.summary(V.trips(spark, sf_dir)).select("id", "user_id", "total", "risk")


@query("anomaly_breakdown", TRIP(f"{_SUMMARY} SELECT id, total, low, medium, high FROM a", "trips"))
def anomaly_breakdown(spark, sf_dir):
    return anomaly.summary(V.trips(spark, sf_dir)).select("id", "total", "low", "medium", "high")


@query("anomaly_advice", TRIP(f"{_SUMMARY} SELECT id, array_to_string((CASE WHEN high > 0 THEN ['act'] || highs[1:2] ELSE CAST([] AS VARCHAR[]) END || CASE WHEN medium > 0 THEN ['watch'] || mediums[1:2] ELSE CAST([] AS VARCHAR[]) END || CASE WHEN total > 3 THEN ['assess'] ELSE CAST([] AS VARCHAR[]) END)[1:6], ',') AS advice FROM a", "trips"))
def anomaly_advice(spark, sf_dir):
    return anomaly.summary(V.trips(spark, sf_dir)).select("id", "advice")


# --- moods

_MOOD = f", mood AS (SELECT *, {sentiment.SCORE} AS mood_score FROM trips)"


@query("sentiment_score", TRIP(f"{_MOOD} SELECT id, user_id, mood_score, CASE WHEN mood_score >= 80 THEN 'positive' WHEN mood_score >= 60 THEN 'neutral' ELSE 'negative' END AS sentiment, CASE WHEN mood_score >= 80 THEN 'relaxed' WHEN mood_score >= 60 THEN 'focused' ELSE 'stressed' END AS emotion, {sentiment.CONFIDENCE} AS confidence FROM mood", "trips"))
def sentiment_score(spark, sf_dir):
    return sentiment.moods(V.trips(spark, sf_dir))


@query("sentiment_insights", TRIP(f"SELECT id, ord, code, value FROM ({rules_sql(sentiment.INSIGHTS, 'trips', 'id')}) r", "trips"))
def sentiment_insights(spark, sf_dir):
    return sentiment.insights(V.trips(spark, sf_dir))


@query("sentiment_tags", TRIP(f"{_MOOD} SELECT id, string_agg(code, ',' ORDER BY ord) AS tags FROM ({rules_sql(sentiment.TAGS, 'mood', 'id')}) r GROUP BY id", "trips"))
def sentiment_tags(spark, sf_dir):
    return sentiment.tags(V.trips(spark, sf_dir))


@query("sentiment_trend", TRIP(f"{_MOOD}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY trip_date DESC, id DESC) AS rank FROM mood), g AS (SELECT user_id, count(*) AS n_trips, avg(CASE WHEN rank <= 3 THEN mood_score END) AS new, avg(CASE WHEN rank > 3 THEN mood_score END) AS old FROM r WHERE rank <= 10 GROUP BY user_id) SELECT user_id, n_trips, CASE WHEN n_trips <= 3 THEN 'insufficient' WHEN new - old > 5 THEN 'improving' WHEN new - old < -5 THEN 'declining' ELSE 'stable' END AS trend, {rounded('new - old', 2)} AS change FROM g", "trips"))
def sentiment_trend(spark, sf_dir):
    return sentiment.trend(V.trips(spark, sf_dir))


# --- wear

_PAST = ", ".join((sql.replace("CASE WHEN", f"CASE WHEN rank > n - {depth} AND", 1) if "CASE" in sql else sql) + f" AS {name}" for name, (depth, sql) in maintenance.HISTORY.items())
_WEAR = f"{_RANKED}, kept AS (SELECT *, max(rank) OVER (PARTITION BY user_id) AS n FROM ranked WHERE rank <= {maintenance.LIMIT}), past AS (SELECT user_id, {_PAST} FROM kept GROUP BY user_id), wear AS (SELECT k.*, p.* EXCLUDE (user_id), 24 AS age_months FROM kept k JOIN past p USING (user_id) WHERE rank = 1)"


def _component_sql(name):
    risk, wear, urgency, cost = maintenance.COMPONENTS[name]
    by = lambda what: maintenance.by_risk(name, what)
    return f"SELECT user_id, '{name}' AS component, {risk} AS risk, {rounded(wear, 2)} AS wear, {by(lambda r: urgency[r])} AS urgency, {by(lambda r: cost[r][0])} AS cost_low, {by(lambda r: cost[r][1])} AS cost_high FROM wear"


for _name in maintenance.COMPONENTS:
    query(f"maint_{_name}", TRIP(f"{_WEAR} {_component_sql(_name)}", "trips"))(lambda spark, sf_dir, name=_name: maintenance.component(V.trips(spark, sf_dir), name))

_FORECAST = f"{_WEAR}, forecast AS (" + " UNION ALL ".join(f"SELECT *, {k} AS ord FROM ({_component_sql(n)}) c{k}" for k, n in enumerate(maintenance.COMPONENTS, 1)) + ")"


@query("maint_ranked", TRIP(f"{_FORECAST} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY urgency DESC, ord) AS place, component, risk, wear, urgency, cost_low, cost_high FROM forecast", "trips"))
def maint_ranked(spark, sf_dir):
    return maintenance.forecast(V.trips(spark, sf_dir))


@query("maint_costs", TRIP(f"{_FORECAST} SELECT user_id, CAST(sum(cost_low) AS BIGINT) AS total_low, CAST(sum(cost_high) AS BIGINT) AS total_high, CAST(sum(CASE WHEN risk = 'high' THEN cost_high ELSE 0 END) AS BIGINT) AS urgent_cost, count(*) FILTER (WHERE risk = 'high') AS n_urgent FROM forecast GROUP BY user_id", "trips"))
def maint_costs(spark, sf_dir):
    return maintenance.costs(V.trips(spark, sf_dir))


@query("next_service", TRIP(f"{_FORECAST} SELECT user_id, CASE WHEN bool_or(risk = 'high') THEN 500 WHEN bool_or(risk = 'medium') THEN 2000 ELSE 5000 END AS next_service_km FROM forecast GROUP BY user_id", "trips"))
def next_service(spark, sf_dir):
    return maintenance.next_service(V.trips(spark, sf_dir))


# --- recommendations

_CONTEXT = ", ctx AS (SELECT t.*, coalesce(weather, 'clear') AS weather, coalesce(traffic, 'normal') AS traffic, coalesce(time_of_day, 'day') AS time_of_day FROM trips t JOIN fuel_requests f ON t.id = f.request_id)"
_GIVEN = lambda rules: f"SELECT id, ord, code, severity AS category, score AS priority, floor(value + 5e-1) / 1e0 AS savings, text AS difficulty, note AS relevance FROM ({rules_sql(rules, 'ctx', 'id')}) r"


def _context(spark, sf_dir):
    return recommend.with_context(V.trips(spark, sf_dir), V.fuel_requests(spark, sf_dir))


for _name, _rules in (("fuel", recommend.FUEL), ("safety", recommend.SAFETY), ("performance", recommend.PERFORMANCE), ("maintenance", recommend.MAINTENANCE)):
    query(f"recs_{_name}", TRIP(f"{_CONTEXT} {_GIVEN(_rules)}", "trips", "fuel_requests"))(lambda spark, sf_dir, rules=_rules: recommend.given(_context(spark, sf_dir), rules))

_TOP = f"{_CONTEXT}, top AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY priority DESC, ord) AS place, code, category, priority, count(*) OVER (PARTITION BY id) AS generated FROM ({_GIVEN(recommend.ALL)}) g)"


@query("recs_top8", TRIP(f"{_TOP} SELECT * FROM top WHERE place <= 8", "trips", "fuel_requests"))
def recs_top8(spark, sf_dir):
    return recommend.top(_context(spark, sf_dir))


@query("rec_categories", TRIP(f"{_TOP} SELECT id, category, count(*) AS n FROM top WHERE place <= 8 GROUP BY id, category", "trips", "fuel_requests"))
def rec_categories(spark, sf_dir):
    return recommend.categories(_context(spark, sf_dir))


_PROFILE = ["user_id", "CASE WHEN user_id % 2 = 0 THEN 'expert' END AS experience", "CASE WHEN user_id % 3 = 0 THEN 'save' END AS goals", "CASE WHEN user_id % 5 < 3 THEN 'car' END AS vehicle_type", "CASE WHEN count(*) > 30 THEN count(*) END AS history"]
_PROFILES = f", profiles AS (SELECT {', '.join(_PROFILE)}, CASE WHEN user_id % 2 = 0 THEN 12e0 END AS efficiency, CASE WHEN user_id % 7 = 0 THEN 'calm' END AS style, CASE WHEN user_id % 4 = 0 THEN 2 END AS engine_size, CASE WHEN user_id % 3 = 1 THEN 5 END AS age FROM trips GROUP BY user_id)"


def profiles(spark, sf_dir):
    """What is known of each user, thinned out by rule."""
    own = V.trips(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return own.selectExpr(*(p.replace("count(*)", "n") for p in _PROFILE), "CASE WHEN user_id % 2 = 0 THEN 12e0 END AS efficiency", "CASE WHEN user_id % 7 = 0 THEN 'calm' END AS style", "CASE WHEN user_id % 4 = 0 THEN 2 END AS engine_size", "CASE WHEN user_id % 3 = 1 THEN 5 END AS age")


_known = lambda columns: " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in columns)


@query("personalisation", TRIP(f"{_PROFILES}, k AS (SELECT user_id, {_known(['experience', 'goals', 'vehicle_type', 'history'])} AS known FROM profiles) SELECT user_id, CASE WHEN known >= 3 THEN 'high' WHEN known >= 2 THEN 'medium' ELSE 'low' END AS level FROM k", "trips"))
def personalisation(spark, sf_dir):
    return recommend.personalisation(profiles(spark, sf_dir))


_TIPS = ", ".join(f"('{k}', '{of}', {o}, '{t}')" for k, of, o, t in recommend.TIPS)


@query("context_tips", TRIP(f", tips(kind, \"of\", ord, tip) AS (VALUES {_TIPS}), m AS (SELECT request_id, ord, tip, row_number() OVER (PARTITION BY request_id ORDER BY ord) AS place FROM fuel_requests f JOIN tips t ON (kind = 'weather' AND \"of\" = weather) OR (kind = 'traffic' AND \"of\" = traffic) OR (kind = 'time_of_day' AND \"of\" = time_of_day)) SELECT request_id, string_agg(tip, ',' ORDER BY ord) AS tips FROM m WHERE place <= 5 GROUP BY request_id", "trips", "fuel_requests"))
def context_tips(spark, sf_dir):
    return recommend.tips(V.fuel_requests(spark, sf_dir))
