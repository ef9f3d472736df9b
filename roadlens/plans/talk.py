"""Queries about messages and about the trips that users ask for."""

from __future__ import annotations

from ..functions.numbers import ratio, rounded
from ..operators import messages as M
from ..sources import views as V
from .registry import query

_has = lambda words: "(" + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in words) + ")"
_found = lambda words: "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in words) + "], lambda x: x IS NOT NULL)"
_all = lambda pattern: f"regexp_extract_all(text, '{pattern}', 1)"
_list = lambda items: "CAST([" + ", ".join(f"'{i}'" for i in items) + "] AS VARCHAR[])"
_first = lambda cases, default: "CASE " + " ".join(f"WHEN {test} THEN {out}" for test, out in cases) + f" ELSE {default} END"

_SHARES = ", ".join(f"{_has(w)} / {len(w)}e0 AS i_{n}" for n, w in M.INTENTS.items())
_BEST = f"greatest({', '.join(f'i_{n}' for n in M.INTENTS)})"
_STEPS = (
    f", a1 AS (SELECT *, {_SHARES}, {_has(M.POSITIVE)} AS positive, {_has(M.NEGATIVE)} AS negative, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS n_words, "
    + ", ".join(f"{_all(p)} AS e_{n}" for n, p in M.ENTITIES.items())
    + f", {_found(M.KEYWORDS)} || {_all(M.NUMBER)} AS keywords FROM messages)"
    + f", a2 AS (SELECT *, {_BEST} AS best, CASE WHEN positive > negative THEN 'positive' WHEN negative > positive THEN 'negative' ELSE 'neutral' END AS mood, abs(positive - negative) / CAST(greatest(n_words, 1) AS DOUBLE) AS mood_confidence, "
    + " + ".join(f"CASE WHEN len(e_{n}) > 0 THEN 1 ELSE 0 END" for n in M.ENTITIES)
    + " AS n_entities FROM a1)"
    + f", a AS (SELECT *, {_first([(f'best > 0 AND i_{n} = best', repr(n)) for n in M.INTENTS], repr('unknown'))} AS intent, (best + mood_confidence + least(1e0, n_entities / 5e0) + least(1e0, len(keywords) / 10e0)) / 4 AS confidence FROM a2)"
)
TALK = lambda sql: V.with_views(f"{_STEPS} {sql}", "messages")
PLAIN = lambda sql: V.with_views(sql, "messages")


def _on(f):
    return lambda spark, sf_dir: f(V.messages(spark, sf_dir))


query("msg_clean", PLAIN(r"SELECT conv_id, turn, regexp_replace(regexp_replace(trim(text), '\s+', ' ', 'g'), '[^\pL\pN_\s.,!?-]', '', 'g') AS cleaned FROM messages"))(_on(M.clean))
query("msg_intent", TALK(f"SELECT conv_id, turn, intent, {rounded('best')} AS confidence, array_to_string(list_filter([{', '.join(f'CASE WHEN i_{n} > 0 THEN {n!r} END' for n in M.INTENTS)}], lambda x: x IS NOT NULL), ',') AS all_intents FROM a"))(_on(M.intents))
query("msg_sentiment", TALK(f"SELECT conv_id, turn, mood AS sentiment, {rounded('mood_confidence')} AS confidence FROM a"))(_on(M.sentiments))
query("msg_entities", TALK(" UNION ALL ".join(f"SELECT conv_id, turn, '{n}' AS entity, array_to_string(e_{n}, '|') AS found, len(e_{n}) AS n FROM a WHERE len(e_{n}) > 0" for n in M.ENTITIES)))(_on(M.entities))
query("msg_keywords", TALK("SELECT conv_id, turn, array_to_string(keywords, ',') AS keywords, len(keywords) AS n FROM a"))(_on(M.keywords))
query("msg_confidence", TALK(f"SELECT conv_id, turn, {rounded('confidence')} AS confidence FROM a"))(_on(M.confidences))

_TONE = "CASE mood WHEN 'negative' THEN 'empathetic' WHEN 'positive' THEN 'enthusiastic' ELSE 'neutral' END"
_DETAIL = "CASE WHEN intent = 'question' THEN 'high' WHEN intent = 'request' THEN 'medium' WHEN mood = 'negative' THEN 'high' ELSE 'medium' END"
_FOLLOW = "array_to_string(list_filter([CASE WHEN list_contains(keywords, 'fuel') THEN 'fuel_tips' END, CASE WHEN list_contains(keywords, 'maintenance') THEN 'maintenance_schedule' END], lambda x: x IS NOT NULL), ',')"
query("msg_strategy", TALK(f"SELECT conv_id, turn, {_TONE} AS tone, {_DETAIL} AS detail, n_entities > 0 AS personal, {_FOLLOW} AS follow_up FROM a"))(_on(M.strategies))

_TOPIC = _first([(f"regexp_matches(text, '{p}')", f"'{n}'") for n, p in M.TOPICS.items()], "'none'")
query("msg_topic", PLAIN(f"SELECT conv_id, turn, {_TOPIC} AS topic FROM messages"))(_on(M.topics))
_SPEED = f"TRY_CAST({_all(M.ENTITIES['speed'])}[1] AS DOUBLE)"
query("msg_speed_band", PLAIN(f"SELECT conv_id, turn, speed, CASE WHEN speed > 100 THEN 'fast' WHEN speed > 80 THEN 'highway' WHEN speed > 50 THEN 'ideal' ELSE 'city' END AS band FROM (SELECT *, {_SPEED} AS speed FROM messages) m WHERE speed IS NOT NULL"))(_on(M.speed_bands))
_SEEN = " UNION ALL ".join(f"SELECT conv_id, turn, {k} AS ord, '{n}' AS topic FROM messages WHERE role = 'user' AND regexp_matches(text, '{p}')" for k, (n, p) in enumerate(M.TOPICS.items()))
query("conv_summary", PLAIN(f", seen AS ({_SEEN}), f AS (SELECT conv_id, topic, min(turn * 100 + ord) AS place FROM seen GROUP BY conv_id, topic), t AS (SELECT conv_id, string_agg(topic, ',' ORDER BY place) AS topics FROM f GROUP BY conv_id), n AS (SELECT conv_id, count(*) AS n_messages FROM messages WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, coalesce(topics, '') AS topics, n_messages FROM n LEFT JOIN t USING (conv_id)"))(_on(M.summaries))

_OWN = " || ".join(
    [f"CASE WHEN len(e_{e}) > 0 THEN {_list(i)} ELSE {_list([])} END" for e, i in M.ENTITY_SUGGESTIONS.items()]
    + [f"CASE WHEN list_contains(keywords, '{k}') THEN {_list(i)} ELSE {_list([])} END" for k, i in M.KEYWORD_SUGGESTIONS.items()]
    + [f"CASE WHEN mood = '{m}' THEN {_list(i)} ELSE {_list([])} END" for m, i in M.MOOD_SUGGESTIONS.items()]
)
_GROUP = _first([(f"{_has(w)} > 0", _list(i)) for w, i in M.SUGGESTIONS.values()], _list(M.NO_GROUP))
query("msg_suggest", TALK(f", o AS (SELECT *, {_OWN} AS own FROM a) SELECT conv_id, turn, array_to_string((CASE WHEN len(own) > 0 THEN own ELSE {_GROUP} END)[1:3], ',') AS suggestions FROM o"))(_on(M.suggestions))
_PLAIN = _first([(f"{_has(w)} > 0", f"'{n}'") for n, w in M.FALLBACK.items()], "'statement'")
query("msg_intent_choice", TALK(f"SELECT conv_id, turn, CASE WHEN best > 6e-1 THEN intent ELSE {_PLAIN} END AS choice FROM a"))(_on(M.intent_choice))
_WORD = _first([(f"{_has(w)} > 0", f"'{n}'") for n, w in M.HANDLERS.items()] + [(f"{_has(['how'])} > 0 AND {_has(['improve', 'better'])} > 0", "'improvement'")], "'none'")
_HANDLER = f"CASE WHEN len({_all(M.ENTITIES['speed'])}) > 0 THEN 'speed' WHEN len({_all(M.ENTITIES['fuel'])}) > 0 THEN 'fuel' WHEN {_TOPIC} <> 'none' THEN {_TOPIC} ELSE {_WORD} END"
query("msg_route", PLAIN(f"SELECT conv_id, turn, {_HANDLER} AS handler FROM messages"))(_on(M.routed))
query(
    "msg_reply",
    TALK(
        f", s AS (SELECT *, {_TONE} AS tone, {_FOLLOW} AS follow_up FROM a) SELECT conv_id, turn, concat_ws(';', CASE WHEN tone = 'empathetic' THEN 'sorry' END, {_HANDLER}, 'speed=' || e_speed[1], 'fuel=' || e_fuel[1], CASE WHEN tone = 'enthusiastic' THEN 'cheer' END, CASE WHEN follow_up <> '' THEN 'ask=' || string_split(follow_up, ',')[1] END) AS reply FROM s"
    ),
)(_on(M.replies))

# --- the trips asked for

_RECENT = (
    ", ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY trip_date DESC, id DESC) AS rank FROM trips)"
    ", recent AS (SELECT user_id, count(*) AS n_trips, sum(distance_km) AS distance, sum(fuel_consumed) AS fuel, avg(avg_speed_kmph) AS speed, avg(max_rpm) AS rpm, CAST(sum(brake_events) AS BIGINT) AS brakes,"
    " arg_min(avg_speed_kmph, rank) AS new_speed, arg_max(avg_speed_kmph, rank) AS old_speed, arg_min(fuel_consumed, rank) AS new_fuel, arg_max(fuel_consumed, rank) AS old_fuel, arg_min(max_rpm, rank) AS new_rpm, arg_max(max_rpm, rank) AS old_rpm,"
    f" coalesce(min(CASE WHEN NOT {M.STEADY} THEN rank END) - 1, count(*)) AS streak FROM ranked WHERE rank <= 10 GROUP BY user_id)"
)
RECENT = lambda sql, *more: V.with_views(f"{_RECENT} {sql}", "trips", *more)


def _of(f):
    return lambda spark, sf_dir: f(V.trips(spark, sf_dir))


_ADVICE = "concat_ws(',', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in M.ANALYSIS.items()) + ")"
query("trip_analysis", RECENT(f"SELECT user_id, n_trips, {rounded('distance', 1)} AS distance, {rounded('speed', 1)} AS mean_speed, {rounded('fuel / n_trips', 1)} AS mean_fuel, {rounded('rpm', 0)} AS mean_rpm, brakes, {_ADVICE} AS advice FROM recent"))(_of(M.trip_analysis))
query("score10", RECENT(f"SELECT user_id, score, CASE WHEN score >= 9 THEN 'excellent' WHEN score >= 7 THEN 'good' WHEN score >= 5 THEN 'average' ELSE 'poor' END AS band FROM (SELECT user_id, greatest(1, least(10, {M.SCORE10})) AS score FROM recent) s"))(_of(M.score10))
query("summary", RECENT(f"SELECT user_id, n_trips, {rounded('distance', 1)} AS distance, {rounded('fuel', 1)} AS fuel, {rounded('raw', 1)} AS km_per_l, CASE WHEN n_trips >= 5 THEN 'consistent' WHEN raw > 10 THEN 'efficient' ELSE 'steady_speeds' END AS verdict FROM (SELECT *, {ratio('distance', 'fuel', '0e0')} AS raw FROM recent) r"))(_of(M.summary))
query("streak", RECENT("SELECT user_id, streak, CASE WHEN streak >= 5 THEN 'amazing' WHEN streak >= 3 THEN 'good' WHEN streak >= 1 THEN 'started' ELSE 'none' END AS band FROM recent"))(_of(M.streaks))
query("compare_ends", RECENT(f"SELECT *, CASE WHEN speed_change > 5 THEN 'faster' WHEN speed_change < -5 THEN 'slower' ELSE 'steady' END AS verdict FROM (SELECT user_id, {rounded('new_speed - old_speed', 1)} AS speed_change, {rounded('new_fuel - old_fuel', 2)} AS fuel_change, new_rpm - old_rpm AS rpm_change FROM recent WHERE n_trips >= 2) e"))(_of(M.ends_compared))
_FLAGS = ", ".join(f"{sql} AS {n}" for n, sql in M.FLAGS.items())
query("advice_flags", RECENT(f"SELECT r.user_id, {_FLAGS}, {rounded(ratio('distance', 'fuel', '0e0'), 1)} AS km_per_l, vehicle_number FROM recent r LEFT JOIN users u ON r.user_id = u.id", "users"))(lambda spark, sf_dir: M.advice_flags(V.trips(spark, sf_dir), V.users(spark, sf_dir)))
