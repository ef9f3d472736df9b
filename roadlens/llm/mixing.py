"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

The rates r of the documents are the closest to 1 in relative entropy, measured
over words, of all with the wanted words of each source:
min sum size * (r log r - r + 1) with sum size * r = target in each source. Its
dual is convex and separates by source, r = exp(l[source]); Newton steps on
sum size * exp(l) - l * target need one sum over the documents for each source,
which Spark gathers once, as a tilt is the same for all documents of a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import cut, free, row_key

WEIGHTS, MOST = (5, 2, 1), 3
#: Rows of a source that are rounded together; a large source has many such parts.
TOGETHER = 2000
NEWTON_STEPS = 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n, target of sources (source, source_size, n): one row each.

    Weights go round in order of the source, null last. Shares of all words by
    weight, cut at `most` times the source's size, what is over going to the rest
    by weight: the targets are least(most * size, weight * level). Sorted by
    size over weight, the level is the greatest of the levels that arise as one
    source after the other is taken as full.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", weight.cast("long")).withColumn("full", F.col("source_size") * most)
    order = W.orderBy((F.col("full") / F.col("weight")).asc(), F.col("source").asc_nulls_first())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("full").over(before), F.lit(0))
    open_ = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left.cast("double") / open_)
    level = F.max("level").over(W.partitionBy())
    return s.select("source", "source_size", "n", F.least(F.col("full").cast("double"), F.col("weight") * level).alias("target"))


def rate(size: str, target: str, most: int = MOST):
    """exp of the dual's solution for a source, by Newton steps from 0."""
    ratio = F.col(target) / F.col(size)
    dual = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), lambda l, _: l - 1 + ratio * F.exp(-l))
    return F.when(F.col(size) > 0, F.least(F.round(F.exp(dual), 12), F.lit(float(most)))).otherwise(F.lit(0.0))


def _part():
    """Which part of its source a row is rounded in: by a hash of its id and its size, so that rows without an id are dealt by size; ids may be any number."""
    digits = F.md5(F.concat_ws("_", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    return F.pmod(F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.ceil(F.col("n") / TOGETHER))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, key (hash of the row), source, size, source_size, target, rate, copies of docs (doc_id, text, source).

    size counts words, null text has 0. Rates are rounded to whole copies, in
    parts of a source in order of size, so that the fractions of neighbours add
    up, and one document of a part evens out the rest: copies never exceed `most`. Repeated rows count each; a null source is a
    source, a null doc_id is allowed. Without rows there is no result; without
    words all targets are 0. Other columns are ignored.
    """
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), row_key(F.col("text")).alias("key")))
    totals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, most)
    totals = totals.withColumn("rate", rate("source_size", "target", most)).withColumnRenamed("source", "_source")
    both = sized.join(totals, sized["source"].eqNullSafe(totals["_source"])).drop("_source")
    part = W.partitionBy("source", _part())
    k = F.row_number().over(part.orderBy(F.desc("size"), "doc_id", "key"))
    fraction = F.col("rate") - F.floor("rate")
    even = F.floor(fraction * k + 0.5) - F.floor(fraction * (k - 1) + 0.5)
    both = both.withColumn("extra", even)
    # one document of a part gets a copy more or less, the one that makes up best for what the part lacks
    lack = fraction * F.sum("size").over(part) - F.sum(F.col("size") * F.col("extra")).over(part)
    both = both.withColumn("lack", lack)
    off = F.when((F.col("lack") > 0) & (F.col("extra") == 0), F.abs(F.col("lack") - F.col("size"))).when((F.col("lack") < 0) & (F.col("extra") == 1), F.abs(F.col("lack") + F.col("size")))
    both = both.withColumn("off", off)
    best = (F.row_number().over(part.orderBy(F.col("off").asc_nulls_last(), "doc_id", "key")) == 1) & (F.col("off") < F.abs("lack"))
    extra = F.when(best, 1 - F.col("extra")).otherwise(F.col("extra"))
    return both.select("doc_id", "key", "source", "size", "source_size", "target", "rate", (F.floor("rate") + extra).alias("copies"))


def report(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs, all columns, that the mix takes, and _copies (a longer name if docs has that), how often: each row as `mixed` has it, whatever its id.

    Rows equal in id, source and text may take a copy more or less than others;
    they are numbered by a hash of all columns, and the first take the more.
    """
    same = ["doc_id", "source", "key"]
    few = F.min("copies")
    counts = mixed(docs, weights, most).groupBy(*same).agg(few.alias("_few"), (F.sum("copies") - few * F.count("*")).alias("_more")).filter("_few + _more > 0")
    id_, source, key, least, more, own, copies = free(docs, "_id", "_source", "_key", "_few", "_more", "_own", "_copies")
    counts = cut(counts.toDF(id_, source, key, least, more))
    rows = docs.withColumn(own, row_key(F.col("text")))
    both = lambda some: rows.join(some, rows["doc_id"].eqNullSafe(some[id_]) & rows["source"].eqNullSafe(some[source]) & (rows[own] == some[key]))
    several = counts.filter(F.col(more) > 0)
    out = both(counts.filter(F.col(more) == 0)).select(*(f"`{c}`" for c in docs.columns), F.col(least).alias(copies))
    if not several.isEmpty():
        number = F.row_number().over(W.partitionBy(id_, source, key).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns)))))
        again = both(several).select(*(f"`{c}`" for c in docs.columns), (F.col(least) + (number <= F.col(more)).cast("long")).alias(copies))
        out = out.unionByName(again.filter(F.col(copies) > 0))
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::BIGINT AS weight, source_size * 3 AS "full" FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum("full") OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY "full"::DOUBLE / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least("full"::DOUBLE, weight * max(level) OVER ()) AS target FROM v),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(round(target / source_size, 12), 3.0) ELSE 0.0 END AS rate FROM t),
k AS (SELECT d.doc_id, d.size, d.source, r.source_size, r.target, r.rate, r.rate - floor(r.rate) AS f, p.h % ceil(r.n / 2000.0)::BIGINT AS part,
             row_number() OVER (PARTITION BY d.source, p.h % ceil(r.n / 2000.0)::BIGINT ORDER BY d.size DESC, d.doc_id NULLS FIRST) AS k
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, LATERAL (SELECT ('0x' || md5(coalesce(d.doc_id::VARCHAR, '') || '_' || d.size::VARCHAR)[1:8])::BIGINT AS h) p),
e AS (SELECT *, (floor(f * k + 0.5) - floor(f * (k - 1) + 0.5))::BIGINT AS extra FROM k),
g AS (SELECT *, f * sum(size) OVER p - sum(size * extra) OVER p AS lack FROM e WINDOW p AS (PARTITION BY source, part)),
h AS (SELECT *, CASE WHEN lack > 0 AND extra = 0 THEN abs(lack - size) WHEN lack < 0 AND extra = 1 THEN abs(lack + size) END AS off FROM g),
i AS (SELECT *, row_number() OVER (PARTITION BY source, part ORDER BY off NULLS LAST, doc_id NULLS FIRST) = 1 AND coalesce(off < abs(lack), false) AS best FROM h)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN best THEN 1 - extra ELSE extra END) * size)::BIGINT AS taken FROM i
"""
