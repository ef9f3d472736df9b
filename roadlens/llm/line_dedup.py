"""Line dedup by winnowing over line hashes, in DataFrame functions alone.

A window is `window` consecutive lines that aren't blank; fewer lines that have
`long_words` words together are one too, so no passage of so many words is too short in
lines (without `runs`, only a single line). Of each window the
least line hash is its fingerprint, so equal windows share one. Windows whose
fingerprint comes once are done with; the rest are compared by the SHA-256 of their
lines, matches that touch or overlap extend to runs, and every run but the earliest is
deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import free, row_key

WINDOW, LONG_WORDS = 3, 50
#: Bytes of a SHA-256 that name a window, and a row beside its id.
NAME = 12
WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    """line (its number), h (hash), long of the lines that aren't blank."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    return F.filter(every, lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))


def repeated_lines(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS, runs: bool = True) -> DataFrame:
    """doc_id, key (names the row), lines (numbers of those to delete among those that aren't blank, from 0) of rows that have any."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.substring(row_key(F.col("text")), 1, NAME).alias("key")
    # a line is its SHA-256, so different lines can't be made to look alike; its short hash only finds candidates
    named = F.transform(_lines(F.coalesce("text", F.lit(""))), lambda s: F.struct(F.unhex(F.sha2(s["x"], 256)).alias("sha"), F.regexp_count(s["x"], F.lit(WORD)).alias("words")))
    lines = F.transform(named, lambda s: F.struct(s["sha"].alias("sha"), F.xxhash64(s["sha"]).alias("h"), s["words"].alias("words")))
    rows = docs.select("doc_id", key, lines.alias("lines"))
    least = lambda x: F.least(*x) if len(x) > 1 else x[0]

    def stretches(n: int, words: int = 0) -> Column:
        """All n consecutive lines that have so many words together."""
        part = lambda i: [F.get(F.col("lines"), i + k) for k in range(n)]
        at = F.sequence(F.lit(0), F.size("lines") - n)
        if words:
            at = F.filter(at, lambda i: sum((p["words"] for p in part(i)), F.lit(0)) >= words)
        found = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), least([p["h"] for p in part(i)]).alias("print"), F.substring(F.unhex(F.sha2(F.concat(*(p["sha"] for p in part(i))), 256)), 1, NAME).alias("whole")))
        return F.coalesce(F.when(F.size("lines") >= n, found), F.array().cast("array<struct<at: int, n: int, print: bigint, whole: binary>>"))

    short = range(1, window if runs else 2)
    windows = rows.select("doc_id", "key", F.inline(F.concat(stretches(window), *(stretches(n, long_words) for n in short))))
    common = windows.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print")
    windows = windows.join(common, "print", "left_semi")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "at")
    first = windows.groupBy("whole").agg(F.count("*").alias("times"), F.min(place).alias("first")).filter("times > 1").select("whole", "first")
    later = windows.join(first, "whole").filter(place > F.col("first"))
    return later.select("doc_id", "key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("line")).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def deduplicated(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS, runs: bool = True) -> DataFrame:
    """All columns of docs, text without the repeated lines, and _n_lines (not blank) and _n_removed.

    Deleted is every line in a window that also starts earlier: in a document
    with a smaller doc_id or before it in the same one. Blank lines stay and are
    not counted. Null text stays null. A null doc_id comes after all others, rows
    that share an id are taken in a fixed order, rows equal in id and text count
    as one document. Other columns are kept as they are.
    """
    id_, key, gone, own, numbers = free(docs, "_id", "_key", "_lines", "_own", "_numbers")
    found = repeated_lines(docs, window, long_words, runs).select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("lines").alias(gone))
    rows = docs.withColumn(own, F.substring(row_key(F.col("text")), 1, NAME))
    both = rows.join(found, rows["doc_id"].eqNullSafe(found[id_]) & (rows[own] == found[key]), "left")
    both = both.withColumn(numbers, F.transform(_lines(F.col("text")), lambda s: s["line"]))
    every = F.split("text", "\n")
    lost = F.transform(F.col(gone), lambda p: F.get(F.col(numbers), p))
    keep = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), lost)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(every, i)), "\n"))
    return both.select(
        *(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.coalesce(F.size(numbers), F.lit(0)).cast("long").alias("_n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("_n_removed"),
    )


def digest(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and a digest of the remaining text (of null text: of nothing)."""
    out = deduplicated(docs.select("doc_id", "text"), window, long_words)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def cleaned(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """`deduplicated` with the columns of docs; a document of which no word is left goes, one that had none stays."""
    inside = free(docs, "_n_lines", "_n_removed")
    out = deduplicated(docs, window, long_words).toDF(*docs.columns, *inside)
    n, removed = (F.col(c) for c in inside)
    return out.filter((removed == 0) | (removed < n)).drop(*inside)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM d),
n AS (SELECT r, line, x, row_number() OVER (PARTITION BY r ORDER BY line) AS pos, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
w AS (SELECT r, pos, line AS a, lead(line, 1) OVER s AS b, lead(line, 2) OVER s AS c, x || chr(10) || lead(x, 1) OVER s || chr(10) || lead(x, 2) OVER s AS whole FROM n WINDOW s AS (PARTITION BY r ORDER BY pos)
      UNION ALL SELECT r, pos, line, line, line, x FROM n WHERE words >= 50
      UNION ALL SELECT r, pos, line, b, b, whole FROM (SELECT r, pos, line, lead(line) OVER s AS b, x || chr(10) || lead(x) OVER s AS whole, words + lead(words) OVER s AS two FROM n WINDOW s AS (PARTITION BY r ORDER BY pos)) y WHERE two >= 50),
f AS (SELECT *, min((r, pos)) OVER (PARTITION BY whole) AS first FROM w WHERE whole IS NOT NULL),
gone AS (SELECT DISTINCT r, unnest([a, b, c]) AS line FROM f WHERE (r, pos) > first)
SELECT d.doc_id, coalesce(k.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed,
       sha256(coalesce(t.text, '')) AS kept_sha256
FROM d
LEFT JOIN (SELECT r, count(*) AS n FROM n GROUP BY r) k USING (r)
LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) g USING (r)
LEFT JOIN (SELECT r, string_agg(x, chr(10) ORDER BY line) AS text FROM l ANTI JOIN gone USING (r, line) GROUP BY r) t USING (r)
"""
