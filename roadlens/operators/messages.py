"""Rule-based analysis of what users write, and of the trips they ask about."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import ratio, rounded
from .trips import latest

# Word lists and patterns of the rules.
INTENTS = {
    "question": ["what", "how", "why", "when", "where", "which", "who", "is", "are", "can", "could", "should", "would"],
    "request": ["please", "help", "show", "tell", "give", "provide", "explain"],
    "complaint": ["problem", "issue", "wrong", "bad", "terrible", "awful", "broken", "not working"],
    "praise": ["good", "great", "excellent", "amazing", "perfect", "love", "like", "awesome"],
    "comparison": ["vs", "versus", "compare", "better", "worse", "difference", "between"],
    "improvement": ["improve", "better", "optimize", "enhance", "increase", "reduce", "save"],
}
FALLBACK = {
    "question": ["what", "how", "why", "when", "where", "which", "who"],
    "request": ["can you", "could you", "please", "help me", "show me"],
    "comparison": ["vs", "versus", "compare", "better", "worse", "difference"],
    "improvement": ["improve", "better", "optimize", "enhance", "increase"],
}
POSITIVE = ["good", "great", "excellent", "love", "like", "amazing", "perfect", "awesome", "thanks"]
NEGATIVE = ["bad", "terrible", "awful", "hate", "problem", "issue", "wrong", "broken", "frustrated"]
ENTITIES = {
    "speed": r"(?i)\b(\d+(?:\.\d+)?)\s*(?:km/h|kmh|mph|kph)\b",
    "distance": r"(?i)\b(\d+(?:\.\d+)?)\s*(?:km|miles|mi)\b",
    "fuel": r"(?i)\b(\d+(?:\.\d+)?)\s*(?:l|liters?|gallons?|gal)\b",
    "rpm": r"(?i)\b(\d+)\s*(?:rpm|revolutions?)\b",
    "time": r"(?i)\b(\d{1,2}:\d{2}|\d+\s*(?:hours?|hrs?|minutes?|mins?))\b",
    "vehicle_part": r"(?i)\b(engine|brake|tire|battery|oil|fuel|transmission|clutch)\b",
    "location": r"(?i)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b",
}
KEYWORDS = [
    "fuel", "gas", "efficiency", "mileage", "consumption", "speed", "rpm", "brake", "engine", "maintenance", "service", "oil", "tire", "battery", "transmission",
    "safety", "accident", "crash", "route", "navigation", "traffic", "cost", "save", "money", "performance", "driving", "trip", "distance",
]
NUMBER = r"\b(\d+(?:\.\d+)?)\b"
TOPICS = {
    "greeting": r"(?i)\b(hi|hello|hey|good morning|good afternoon|good evening|greetings)\b",
    "driving_tips": r"(?i)\b(driving tips|drive better|improve driving|safe driving|how to drive|driving advice)\b",
    "fuel_efficiency": r"(?i)\b(fuel|efficiency|mpg|gas|consumption|save fuel|mileage|economy|eco.?driving)\b",
    "maintenance": r"(?i)\b(maintenance|service|oil change|tire|brake|check|repair|schedule|servicing)\b",
    "trip_data": r"(?i)\b(trip|data|distance|speed|rpm|analysis|analyze|performance|stats|metrics)\b",
    "safety": r"(?i)\b(safety|safe|accident|crash|seatbelt|emergency|hazard)\b",
    "weather": r"(?i)\b(weather|rain|snow|fog|storm|winter|summer|conditions)\b",
    "route": r"(?i)\b(route|navigation|directions|path|way|road)\b",
    "cost": r"(?i)\b(cost|money|expensive|cheap|budget|price|save)\b",
}
HANDLERS = {
    "performance": ["score", "performance", "rating"],
    "alerts": ["alert", "warning", "problem"],
    "thanks": ["thank", "thanks"],
    "capabilities": ["help", "what can you do"],
    "rpm": ["rpm", "revolutions"],
    "acceleration": ["acceleration", "accelerate"],
    "vehicle": ["vehicle", "car", "my car"],
    "comparison": ["compare", "comparison", "vs"],
    "summary": ["week", "weekly", "summary"],
    "streak": ["streak", "consistent", "progress"],
}
#: group: words and the suggestions they lead to.
SUGGESTIONS = {
    "fuel": (["fuel", "efficiency", "gas"], ["current_efficiency", "reduce_costs", "eco_tips"]),
    "trip": (["trip", "analyze", "performance"], ["compare_trips", "driving_score", "weekly_summary"]),
    "maintenance": (["maintenance", "service", "repair"], ["next_service", "maintenance_alerts", "maintenance_schedule"]),
    "safety": (["safety", "tips", "advice"], ["weather_tips", "highway_advice", "emergency_advice"]),
}
NO_GROUP = ["analyze_patterns", "how_to_improve", "cost_savings"]
ENTITY_SUGGESTIONS = {"speed": ["optimize_speed", "ideal_speed"], "fuel": ["fuel_savings", "compare_efficiency"]}
KEYWORD_SUGGESTIONS = {"maintenance": ["create_schedule", "vehicle_health"], "safety": ["emergency_tips", "weather_safety"]}
MOOD_SUGGESTIONS = {"negative": ["solve_issue"], "positive": ["advanced_tips"]}


def holds(word: str) -> Column:
    """Is the word in the text, in whatever case?"""
    return F.contains(F.lower("text"), F.lit(word))


def contained(words: list[str]) -> Column:
    """Those of the words that the text holds, in order."""
    return F.array_compact(F.array(*(F.when(holds(w), F.lit(w)) for w in words)))


def count(words: list[str]) -> Column:
    """How many of the words the text holds: a sum of comparisons in generated code, no lambda over an array."""
    return reduce(Column.__add__, (holds(w).cast("int") for w in words))


def any_of(words: list[str]) -> Column:
    return reduce(Column.__or__, map(holds, words))


def strings(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def clean(df: DataFrame) -> DataFrame:
    """White space to one space; letters, digits and .,!?-_ stay."""
    return df.select("conv_id", "turn", F.regexp_replace(F.regexp_replace(F.trim("text"), r"\s+", " "), r"(?U)[^\w\s.,!?-]", "").alias("cleaned"))


def found(name: str) -> Column:
    """All that the pattern of an entity finds."""
    return F.regexp_extract_all("text", F.lit(ENTITIES[name]), F.lit(1))


def analysed(df: DataFrame) -> DataFrame:
    """All that the rules find in a message, as columns; no row leaves its partition.

    What searches the text is computed once, in a select of its own; the others only
    refer to it.
    """
    texts = df.withColumn("text", F.coalesce("text", F.lit("")))
    df = texts.withColumns(
        {f"n_{name}": count(words) for name, words in INTENTS.items()}
        | {f"e_{name}": found(name) for name in ENTITIES}
        | {"positive": count(POSITIVE), "negative": count(NEGATIVE), "n_words": F.size(F.array_remove(F.split(F.trim("text"), r"\s+"), ""))}
        | {"keywords": F.concat(contained(KEYWORDS), F.regexp_extract_all("text", F.lit(NUMBER), F.lit(1)))}
    )
    shares = {name: F.col(f"n_{name}") / float(len(words)) for name, words in INTENTS.items()}
    df = df.withColumns({"intent_confidence": F.greatest(*shares.values()), "n_entities": reduce(Column.__add__, ((F.size(f"e_{name}") > 0).cast("int") for name in ENTITIES))})
    best = F.col("intent_confidence")
    df = df.withColumn("intent", F.when(best > 0, F.coalesce(*(F.when(share == best, F.lit(name)) for name, share in shares.items()))).otherwise("unknown"))
    df = df.withColumn("mood", F.when(F.col("positive") > F.col("negative"), "positive").when(F.col("negative") > F.col("positive"), "negative").otherwise("neutral"))
    df = df.withColumn("mood_confidence", F.abs(F.col("positive") - F.col("negative")) / F.greatest("n_words", F.lit(1)))
    parts = [best, F.col("mood_confidence"), F.least(F.lit(1.0), F.col("n_entities") / 5), F.least(F.lit(1.0), F.size("keywords") / 10)]
    return df.withColumn("confidence", sum(parts[1:], parts[0]) / 4)


def intents(df: DataFrame) -> DataFrame:
    every = F.concat_ws(",", *(F.when(F.col(f"n_{name}") > 0, F.lit(name)) for name in INTENTS))
    return analysed(df).select("conv_id", "turn", "intent", F.expr(rounded("intent_confidence")).alias("confidence"), every.alias("all_intents"))


def sentiments(df: DataFrame) -> DataFrame:
    return analysed(df).select("conv_id", "turn", F.col("mood").alias("sentiment"), F.expr(rounded("mood_confidence")).alias("confidence"))


def entities(df: DataFrame) -> DataFrame:
    """A row for each kind of entity in a message, with all that was found."""
    kinds = F.array(*(F.struct(F.lit(name).alias("entity"), F.col(f"e_{name}").alias("found")) for name in ENTITIES))
    rows = analysed(df).select("conv_id", "turn", F.inline(kinds)).filter(F.size("found") > 0)
    return rows.select("conv_id", "turn", "entity", F.array_join("found", "|").alias("found"), F.size("found").cast("long").alias("n"))


def keywords(df: DataFrame) -> DataFrame:
    return analysed(df).select("conv_id", "turn", F.array_join("keywords", ",").alias("keywords"), F.size("keywords").cast("long").alias("n"))


def confidences(df: DataFrame) -> DataFrame:
    return analysed(df).select("conv_id", "turn", F.expr(rounded("confidence")).alias("confidence"))


def strategies(df: DataFrame) -> DataFrame:
    return _strategy(analysed(df)).select("conv_id", "turn", "tone", "detail", "personal", "follow_up")


def _strategy(df: DataFrame) -> DataFrame:
    tone = F.when(F.col("mood") == "negative", "empathetic").when(F.col("mood") == "positive", "enthusiastic").otherwise("neutral")
    detail = F.when(F.col("intent") == "question", "high").when(F.col("intent") == "request", "medium").when(F.col("mood") == "negative", "high").otherwise("medium")
    follow = F.concat_ws(",", F.when(F.array_contains("keywords", "fuel"), "fuel_tips"), F.when(F.array_contains("keywords", "maintenance"), "maintenance_schedule"))
    return df.withColumns({"tone": tone, "detail": detail, "personal": F.col("n_entities") > 0, "follow_up": follow})


def topic() -> Column:
    return F.coalesce(*(F.when(F.col("text").rlike(p), F.lit(name)) for name, p in TOPICS.items()), F.lit("none"))


def topics(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", topic().alias("topic"))


def speed_bands(df: DataFrame) -> DataFrame:
    """Advice for the first speed that a message names."""
    first = F.get(found("speed"), 0).try_cast("double")
    band = F.when(F.col("speed") > 100, "fast").when(F.col("speed") > 80, "highway").when(F.col("speed") > 50, "ideal").otherwise("city")
    return df.withColumn("speed", first).filter("speed IS NOT NULL").select("conv_id", "turn", "speed", band.alias("band"))


def summaries(df: DataFrame) -> DataFrame:
    """Topics of a conversation in the order they came up, and how many messages the user sent."""
    own = df.filter("role = 'user'")
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("ord"), F.lit(name).alias("topic"))) for k, (name, p) in enumerate(TOPICS.items()))))
    seen = own.select("conv_id", "turn", F.inline(found)).groupBy("conv_id", "topic").agg(F.min(F.struct("turn", "ord")).alias("first"))
    listed = seen.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "topic"))).alias("t"))
    n = own.groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    return n.join(listed, "conv_id", "left").select("conv_id", F.coalesce(F.array_join(F.transform("t", lambda x: x["topic"]), ","), F.lit("")).alias("topics"), "n_messages")


def suggestions(df: DataFrame, n: int = 3) -> DataFrame:
    rich = analysed(df)
    has = lambda name: F.size(f"e_{name}") > 0
    part = lambda test, items: F.when(test, strings(items)).otherwise(strings([]))
    own = F.concat(
        *(part(has(e), items) for e, items in ENTITY_SUGGESTIONS.items()),
        *(part(F.array_contains("keywords", k), items) for k, items in KEYWORD_SUGGESTIONS.items()),
        *(part(F.col("mood") == m, items) for m, items in MOOD_SUGGESTIONS.items()),
    )
    group = F.coalesce(*(F.when(any_of(words), strings(items)) for words, items in SUGGESTIONS.values()), strings(NO_GROUP))
    return rich.select("conv_id", "turn", F.array_join(F.slice(F.when(F.size(own) > 0, own).otherwise(group), 1, n), ",").alias("suggestions"))


def intent_choice(df: DataFrame, least: float = 0.6) -> DataFrame:
    plain = F.coalesce(*(F.when(any_of(words), F.lit(name)) for name, words in FALLBACK.items()), F.lit("statement"))
    return analysed(df).select("conv_id", "turn", F.when(F.col("intent_confidence") > least, F.col("intent")).otherwise(plain).alias("choice"))


def handler() -> Column:
    """Which part answers: a named speed or amount of fuel, else the topic, else a group of words."""
    has = lambda name: F.size(found(name)) > 0
    word = F.coalesce(*(F.when(any_of(words), F.lit(name)) for name, words in HANDLERS.items()), F.when(any_of(["how"]) & any_of(["improve", "better"]), "improvement"), F.lit("none"))
    return F.when(has("speed"), "speed").when(has("fuel"), "fuel").when(topic() != "none", topic()).otherwise(word)


def routed(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.coalesce("text", F.lit(""))).select("conv_id", "turn", handler().alias("handler"))


def replies(df: DataFrame) -> DataFrame:
    """The parts of a reply in order: opening, handler, remarks on what was named, closing, first follow-up."""
    rich = _strategy(analysed(df))
    first = lambda name: F.get(f"e_{name}", F.lit(0))
    parts = F.concat_ws(
        ";",
        F.when(F.col("tone") == "empathetic", "sorry"),
        handler(),
        F.concat(F.lit("speed="), first("speed")),
        F.concat(F.lit("fuel="), first("fuel")),
        F.when(F.col("tone") == "enthusiastic", "cheer"),
        F.when(F.col("follow_up") != "", F.concat(F.lit("ask="), F.element_at(F.split("follow_up", ","), 1))),
    )
    return rich.select("conv_id", "turn", parts.alias("reply"))


def _recent(trips: DataFrame, n: int = 10) -> DataFrame:
    return latest(trips, n).groupBy("user_id").agg(
        F.count("*").alias("n_trips"),
        F.sum("distance_km").alias("distance"),
        F.sum("fuel_consumed").alias("fuel"),
        F.avg("avg_speed_kmph").alias("speed"),
        F.avg("max_rpm").alias("rpm"),
        F.sum("brake_events").alias("brakes"),
        F.min_by("avg_speed_kmph", "rank").alias("new_speed"),
        F.max_by("avg_speed_kmph", "rank").alias("old_speed"),
        F.min_by("fuel_consumed", "rank").alias("new_fuel"),
        F.max_by("fuel_consumed", "rank").alias("old_fuel"),
        F.min_by("max_rpm", "rank").alias("new_rpm"),
        F.max_by("max_rpm", "rank").alias("old_rpm"),
        F.coalesce(F.min(F.when(~F.expr(STEADY), F.col("rank"))) - 1, F.count("*")).alias("streak"),
    )


STEADY = "(avg_speed_kmph >= 40 AND avg_speed_kmph <= 80 AND max_rpm <= 3000 AND brake_events <= 8)"
ANALYSIS = {"slow_down": "speed > 80", "city_speed": "speed < 40", "lower_rpm": "rpm > 3000", "brake_less": "brakes > n_trips * 10", "smooth": "brakes <= n_trips * 10"}
SCORE10 = (
    "(10 - (CASE WHEN speed > 90 THEN 2 WHEN speed > 80 THEN 1 ELSE 0 END) - (CASE WHEN rpm > 4000 THEN 2 WHEN rpm > 3000 THEN 1 ELSE 0 END)"
    " - (CASE WHEN brakes > 15 * n_trips THEN 2 WHEN brakes > 10 * n_trips THEN 1 ELSE 0 END))"
)
FLAGS = {
    "fuel_speed": "CASE WHEN speed > 85 THEN 'slow_down' WHEN speed < 40 THEN 'city' ELSE 'none' END",
    "fuel_rpm": "CASE WHEN rpm > 3500 THEN 'shift_early' ELSE 'none' END",
    "driving_brakes": "CASE WHEN brakes > 12 * n_trips THEN 'smooth' ELSE 'none' END",
    "driving_speed": "CASE WHEN speed > 80 THEN 'slow_down' ELSE 'none' END",
    "performance_speed": "CASE WHEN speed > 90 THEN 'slow_down' WHEN speed < 30 THEN 'city' ELSE 'efficient' END",
    "performance_rpm": "CASE WHEN rpm > 3500 THEN 'shift_early' ELSE 'good' END",
    "rpm": "CASE WHEN rpm > 4000 THEN 'high' WHEN rpm < 2500 THEN 'excellent' ELSE 'good' END",
}


def trip_analysis(trips: DataFrame) -> DataFrame:
    advice = F.concat_ws(",", *(F.when(F.expr(test), F.lit(name)) for name, test in ANALYSIS.items()))
    return _recent(trips).select("user_id", "n_trips", F.expr(rounded("distance", 1)).alias("distance"), F.expr(rounded("speed", 1)).alias("mean_speed"), F.expr(rounded("fuel / n_trips", 1)).alias("mean_fuel"), F.expr(rounded("rpm", 0)).alias("mean_rpm"), "brakes", advice.alias("advice"))


def score10(trips: DataFrame) -> DataFrame:
    band = F.when(F.col("score") >= 9, "excellent").when(F.col("score") >= 7, "good").when(F.col("score") >= 5, "average").otherwise("poor")
    return _recent(trips).withColumn("score", F.expr(f"greatest(1, least(10, {SCORE10}))")).select("user_id", "score", band.alias("band"))


def summary(trips: DataFrame) -> DataFrame:
    out = _recent(trips).withColumn("raw", F.expr(ratio("distance", "fuel", "0e0")))
    verdict = F.when(F.col("n_trips") >= 5, "consistent").when(F.col("raw") > 10, "efficient").otherwise("steady_speeds")
    return out.select("user_id", "n_trips", F.expr(rounded("distance", 1)).alias("distance"), F.expr(rounded("fuel", 1)).alias("fuel"), F.expr(rounded("raw", 1)).alias("km_per_l"), verdict.alias("verdict"))


def streaks(trips: DataFrame) -> DataFrame:
    band = F.when(F.col("streak") >= 5, "amazing").when(F.col("streak") >= 3, "good").when(F.col("streak") >= 1, "started").otherwise("none")
    return _recent(trips).select("user_id", "streak", band.alias("band"))


def ends_compared(trips: DataFrame) -> DataFrame:
    """The newest of the last trips against the oldest, for users with two or more."""
    verdict = F.when(F.col("speed_change") > 5, "faster").when(F.col("speed_change") < -5, "slower").otherwise("steady")
    out = _recent(trips).filter("n_trips >= 2").select("user_id", F.expr(rounded("new_speed - old_speed", 1)).alias("speed_change"), F.expr(rounded("new_fuel - old_fuel", 2)).alias("fuel_change"), (F.col("new_rpm") - F.col("old_rpm")).alias("rpm_change"))
    return out.withColumn("verdict", verdict)


def advice_flags(trips: DataFrame, users: DataFrame) -> DataFrame:
    own = _recent(trips).select("user_id", *(F.expr(sql).alias(name) for name, sql in FLAGS.items()), F.expr(rounded(ratio("distance", "fuel", "0e0"), 1)).alias("km_per_l"))
    return own.join(users.select(F.col("id").alias("user_id"), "vehicle_number"), "user_id", "left")
