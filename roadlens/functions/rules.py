"""Rules as data: each says when it fires and what it then reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    when: str  # SQL condition; NULL does not fire
    value: str = "CAST(NULL AS DOUBLE)"
    baseline: str = "CAST(NULL AS DOUBLE)"
    score: int = 0
    text: str = ""
    note: str = "''"  # SQL expression for a second text


def fired(rules: list[Rule]) -> Column:
    """Array of the rules that fire on a row, in order."""
    one = lambda k, r: F.when(
        F.expr(r.when),
        F.struct(F.lit(k).alias("ord"), F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.expr(r.value).cast("double").alias("value"), F.expr(r.baseline).cast("double").alias("baseline"), F.lit(r.score).alias("score"), F.lit(r.text).alias("text"), F.expr(r.note).alias("note")),
    )
    return F.array_compact(F.array(*(one(k, r) for k, r in enumerate(rules, 1))))


def exploded(df: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """A row for each rule that fires, with the row's keys."""
    return df.select(*keys, F.inline(fired(rules)))


def rules_sql(rules: list[Rule], source: str, *keys: str) -> str:
    """What `exploded` returns, in plain SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return " UNION ALL ".join(
        f"SELECT {', '.join(keys)}, {k} AS ord, {quoted(r.code)} AS code, {quoted(r.severity)} AS severity, CAST({r.value} AS DOUBLE) AS value, CAST({r.baseline} AS DOUBLE) AS baseline, {r.score} AS score, {quoted(r.text)} AS text, {r.note} AS note FROM {source} WHERE {r.when}"
        for k, r in enumerate(rules, 1)
    )
