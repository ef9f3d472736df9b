"""What each of five filters takes away, alone and behind the others, in any order.

A document's failures are a mask of five bits. Its survival word has 32 bits, one for
each subset of the filters: bit S is set if the document passes every filter of S. How
many documents survive a subset is then the number of words with that bit, a positional
popcount. It is taken by carry-save addition: three words of one weight become a word of
that weight (the bits' sums) and one of twice the weight (their carries), until a word
of each weight is left. Everything the report says follows from the survivors of the
subsets, for each part and label.
"""

from __future__ import annotations

import json
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import cut

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: What is counted of each subset: all documents, those of good quality, toxic ones.
LABELS = ("all", "good", "toxic")
FEW_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SIGNS = 200, 50, 3, r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows that share a text or an id are dealt to so many tasks.
SALTS = 16


def survival(failures: int) -> int:
    """The word of a document that fails the filters whose bits are set."""
    return sum(1 << subset for subset in range(SUBSETS) if not subset & failures)


WORDS = [survival(failures) for failures in range(SUBSETS)]


def popcounts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit, by carry-save addition."""
    counts, weight, plane = np.zeros(SUBSETS, np.int64), 0, words.astype(np.uint32)
    while len(plane):
        carries = []
        while len(plane) > 2:
            third = len(plane) // 3
            a, b, c = plane[:third], plane[third : 2 * third], plane[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            plane = np.concatenate([half ^ c, plane[3 * third :]])
        if len(plane) == 2:
            carries.append(plane[:1] & plane[1:])
            plane = plane[:1] ^ plane[1:]
        counts += ((plane[0] >> np.arange(SUBSETS, dtype=np.uint32)) & 1).astype(np.int64) << weight
        plane = np.concatenate(carries) if carries else plane[:0]
        weight += 1
    return counts


def _own_failures(text: Column) -> Column:
    """Bits of the filters that a document fails by its own text (A to D)."""
    words = F.array_remove(F.split(text, SPACE), "")
    fails = [
        F.size(words) < FEW_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > UPPER_PERCENT * F.length(text),
        text.rlike(SIGNS),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def _salted(some: DataFrame) -> DataFrame:
    """A row for each salt, never broadcast: Spark would judge the size before the rows are repeated, and hold all of them in the driver."""
    return some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, failures (bits), word (survival word), good, toxic of each row of docs (doc_id, lang, text).

    Null text is empty, null lang is the part ''. Labels (doc_id, quality, toxic) that
    are missing or null are neither good nor toxic; of several for an id, one that says 1
    counts. A row with null doc_id has no labels and is no copy of another, nor another of
    it. Rows equal in id and text are no copies of each other. Other columns are ignored;
    without rows there is no result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = cut(rows.select("doc_id", "part", _own_failures(F.col("text")).alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")))
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")).filter("good or toxic")
    # the checkpoint keeps the rows' numbers, so the deal is the same in a second try
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    rows = rows.join(_salted(first), ["digest", "salt"], "left").join(_salted(known), ["doc_id", "salt"], "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    rows = rows.select("doc_id", "part", (F.col("own") + copy).alias("failures"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    return rows.withColumn("word", F.get(F.array(*(F.lit(w).cast("long") for w in WORDS)), F.col("failures")))


def survivors(rows: DataFrame) -> DataFrame:
    """part, n (for each of LABELS the survivors of the 32 subsets, one after the other) of `judged` rows."""

    def count(batches):
        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            which, word = parts.indices.to_numpy(zero_copy_only=False), batch.column("word").to_numpy(zero_copy_only=False)
            good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))
            order = np.argsort(which, kind="stable")
            n = []
            for at in np.split(order, np.flatnonzero(np.diff(which[order])) + 1) if len(order) else []:
                n.append(np.concatenate([popcounts(word[at]), popcounts(word[at[good[at]]]), popcounts(word[at[toxic[at]]])]).tolist())
            found = [parts.dictionary[int(k)].as_py() for k in np.unique(which)]
            yield pa.record_batch({"part": pa.array(found, pa.string()), "n": pa.array(n, pa.list_(pa.int64()))})

    some = rows.select("part", "word", "good", "toxic").mapInArrow(count, "part string, n array<long>")
    every = range(SUBSETS * len(LABELS))
    return some.groupBy("part").agg(*(F.sum(F.col("n")[k]).alias(f"n{k}") for k in every)).select("part", F.array(*(f"n{k}" for k in every)).alias("n"))


def _steps() -> Column:
    """Every step of every order: the filter and the bits of those before it."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            rows.append({"filter_order": "".join(FILTERS[k] for k in order), "step": step + 1, "f": f, "before": before})
            before |= 1 << f
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, f: int, before: int>>")


def _shapley(n, f: int) -> Column:
    """Documents that filter f removes, summed over all orders: a subset before it stands for as many orders as its members and the others can be put in."""
    factorial = (1, 1, 2, 6, 24)
    subsets = [s for s in range(SUBSETS) if not s >> f & 1]
    return sum((factorial[s.bit_count()] * factorial[len(FILTERS) - 1 - s.bit_count()] * (n(s) - n(s | 1 << f)) for s in subsets[1:]), 24 * (n(0) - n(1 << f)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A row for each part and each step of the 120 orders; see `judged` for odd rows.
    """
    full = SUBSETS - 1
    shared = survivors(judged(docs, labels))
    value = lambda k: F.get("n", F.lit(k))
    every = range(len(FILTERS))
    shared = shared.select("part", "n", F.array(*(_shapley(value, f) for f in every)).alias("shapley"), F.array(*(value(full ^ 1 << f) - value(full) for f in every)).alias("only"))
    rows = shared.select("*", F.explode(_steps()).alias("s")).select("part", "n", "shapley", "only", "s.*")
    bit = F.get(F.array(*(F.lit(1 << f) for f in every)), F.col("f"))
    after = F.col("before").bitwiseOR(bit)
    alive = lambda label, subset: F.get("n", subset + SUBSETS * LABELS.index(label))
    lost = lambda label: alive(label, F.col("before")) - alive(label, after)
    fails = alive("all", F.lit(0)) - alive("all", bit)
    return rows.select(
        "part", "filter_order", "step", F.substring(F.lit(FILTERS), F.col("f") + 1, F.lit(1)).alias("filter"),
        alive("all", after).alias("kept"), lost("all").alias("removed"), (fails - lost("all")).alias("redundant"), F.get("only", F.col("f")).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", F.col("f")).alias("shapley"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
f AS (SELECT doc_id, part,
             CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 16 ELSE 0 END AS fails
      FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT [a.c, b.c, c.c, d.c, e.c] AS cs, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM k a, k b, k c, k d, k e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT array_to_string(cs, '') AS filter_order, step, cs[step] AS filter, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) x),
r AS (SELECT part, filter_order, step, filter,
             sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM g, s GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM r
"""
