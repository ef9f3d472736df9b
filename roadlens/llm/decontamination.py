"""Benchmark decontamination by winnowing.

The fingerprints of a text are the least hashes of k-grams in its sliding windows:
texts that share a window share the fingerprint and where it stands in that. A Bloom
filter of bounded size over the benchmark's fingerprints is sent to every task;
document fingerprints that pass it are joined with the benchmark's, and each hit is
extended to both sides, word by word, as far as a window that holds it can reach. A
hit counts if it extends to a whole window. Words are compared by 64-bit hashes under
a key drawn for the job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _arrays as A
from ._arrays import U64
from .components import cut, row_key

WINDOW, GRAM = 10, 5
#: Bits of the filter for each fingerprint, and at most (16 MB): beyond that more passes, and the join decides.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Stand where a document and an item have no word.
NO_WORD, NO_ITEM_WORD = U64(1), U64(2)


def fingerprints(words: A.Words, window: int, key: int):
    """(word number, hash) of the fingerprints of rows of `window` words or more."""
    gram = min(GRAM, window)
    size = np.diff(words.offsets)
    for i, j in A.slices(words.offsets):
        a, b = int(words.offsets[i]), int(words.offsets[j])
        row = np.repeat(np.arange(i, j), size[i:j])
        h = A.grams(words.hash[a:b], gram, key) | U64(1)
        least = A.sliding_min(h, window - gram + 1)
        if not len(least):
            continue
        least[row[: len(least)] != row[window - 1 :]] = 0  # not a window
        reach = np.zeros(window - gram, U64)
        most = ~A.sliding_min(~np.concatenate([reach, least, reach]), window - gram + 1)
        at = np.flatnonzero(h == most)
        yield at + a, h[at]


def whole_stretches(words: A.Words, n: int, key: int):
    """(word number, hash) of all stretches of n words."""
    size = np.diff(words.offsets)
    for i, j in A.slices(words.offsets):
        a, b = int(words.offsets[i]), int(words.offsets[j])
        row = np.repeat(np.arange(i, j), size[i:j])
        h = A.grams(words.hash[a:b], n, key)
        at = np.flatnonzero(row[: len(h)] == row[n - 1 :]) if len(h) else np.zeros(0, np.int64)
        yield at + a, h[at]


def context(words: A.Words, row: np.ndarray, at: np.ndarray, before: int, size: int, none: U64) -> np.ndarray:
    """Hashes of `size` words from `before` words ahead of each place, none beyond the row."""
    where = at[:, None] + np.arange(-before, size - before)
    inside = (where >= words.offsets[row][:, None]) & (where < words.offsets[row + 1][:, None])
    return np.where(inside, words.hash[np.clip(where, 0, len(words.hash) - 1)], none)


def _packed(context: np.ndarray) -> pa.Array:
    width = 8 * context.shape[1]
    raw = np.ascontiguousarray(context).tobytes()
    return pa.array([raw[k * width : (k + 1) * width] for k in range(len(context))], pa.binary())


def _places(words: A.Words, window: int, short: list[int], key: int, none: U64):
    """row, word number, size (window, or words of a short item), hash and context of what is joined."""
    reach = window - min(GRAM, window)
    for n in (window, *short):
        found = fingerprints(words, window, key) if n == window else whole_stretches(words, n, key)
        for at, h in found:
            row = np.searchsorted(words.offsets, at, "right") - 1
            before, size = (reach, window + reach) if n == window else (0, n)
            yield row, at, n, h, lambda keep, row=row, at=at, before=before, size=size: _packed(context(words, row[keep], at[keep], before, size, none))


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return ((h >> U64(32)) & U64(bits - 1)).astype(np.int64), (A.mix(h) & U64(bits - 1)).astype(np.int64)


def _benchmark(bench: DataFrame, window: int, key: int) -> DataFrame:
    """item_id, size, hash, context of every fingerprint, and of items with fewer words, but not none, as a whole."""

    def run(batches):
        for batch in A.pieces(batches):
            words = A.Words(*A.utf8(batch.column("text")), key, A.ALNUM, lower=True)
            n = np.diff(words.offsets)
            for row, at, size, h, made in _places(words, window, sorted({int(x) for x in n if 0 < x < window}), key, NO_ITEM_WORD):
                keep = np.flatnonzero((size == window) | (n[row] == size))
                yield pa.record_batch({"item_id": batch.column("item_id").take(pa.array(row[keep])), "size": pa.array(np.full(len(keep), size), pa.int32()), "hash": pa.array(h[keep].view(np.int64)), "context": made(keep)})

    return bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id string, size int, hash long, context binary")


def _bloom(known: DataFrame) -> tuple[np.ndarray, int]:
    """The filter, packed, and its bits: a bounded number of 64-bit words comes to the driver."""
    count = known.select("hash").distinct().count()
    bits = min(MOST_BITS, 1 << max(12, (BITS_EACH * count - 1).bit_length()))

    def run(batches):
        for batch in batches:
            x, y = _bits(batch.column("hash").to_numpy().view(U64), bits)
            yield pa.record_batch({"bit": pa.array(np.unique(np.append(x, y)))})

    words = known.select("hash").mapInArrow(run, "bit long").groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("mask")).toPandas()
    out = np.zeros(bits >> 5, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).astype(np.uint32)
    return out, bits


def _extended(window: int):
    """Hits with the span of words that documents and items share around them; rows that are no hit, or don't extend to a whole window, go, documents' own rows stay."""
    gram = min(GRAM, window)
    reach = window - gram

    def run(batches):
        for batch in batches:
            size, place = batch.column("size").to_numpy(), batch.column("place").to_numpy()
            start, end = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            keep = size == 0
            met = batch.column("set").is_valid().to_numpy(zero_copy_only=False) & ~keep
            for n in np.unique(size[met]).tolist():
                at = np.flatnonzero(met & (size == n))
                own, other = (np.frombuffer(b"".join(batch.column(c).take(pa.array(at)).to_pylist()), U64).reshape(len(at), -1) for c in ("context", "theirs"))
                same = own == other
                if n < window:
                    left, right, ok = 0, n, same.all(1)
                else:
                    left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(1)
                    right = gram + np.cumprod(same[:, reach + gram :], axis=1).sum(1)
                    ok = same[:, reach : reach + gram].all(1) & (left + right >= window)
                start[at], end[at], keep[at] = place[at] - left, place[at] + right, ok
            out = batch.select(["doc_id", "key", "n_words", "set"]).append_column("start", pa.array(start)).append_column("end", pa.array(end))
            yield out.filter(pa.array(keep))

    return run


def matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Spans: doc_id, key (names the row), n_words, start, end (words), set (of items; null, and no span, in a document's own row). Sets: set, items."""
    spark, key = docs.sparkSession, A.job_key()
    known = cut(_benchmark(bench, window, key).distinct())
    short = sorted(r["size"] for r in known.filter(F.col("size") < window).select("size").distinct().collect())
    packed, bits = _bloom(known)
    bloom = spark.sparkContext.broadcast(packed.view(np.uint8))

    def run(batches):
        has = bloom.value
        test = lambda x: (has[x >> 3] >> (x & 7).astype(np.uint8)) & 1 > 0
        for batch in A.pieces(batches):
            words = A.Words(*A.utf8(batch.column("text")), key, A.ALNUM, lower=True)
            ids, keys = batch.column("doc_id"), batch.column("key")
            none = pa.nulls(len(ids), pa.binary())
            yield pa.record_batch({"doc_id": ids, "key": keys, "n_words": pa.array(np.diff(words.offsets)), "size": pa.array(np.zeros(len(ids), np.int32)), "hash": batch.column("spread"), "place": pa.array(np.zeros(len(ids), np.int64)), "context": none})
            for row, at, size, h, made in _places(words, window, short, key, NO_WORD):
                x, y = _bits(h, bits)
                keep = np.flatnonzero(test(x) & test(y))
                if len(keep):
                    r = row[keep]
                    yield pa.record_batch({"doc_id": ids.take(pa.array(r)), "key": keys.take(pa.array(r)), "n_words": pa.nulls(len(keep), pa.int64()), "size": pa.array(np.full(len(keep), size), pa.int32()), "hash": pa.array(h[keep].view(np.int64)), "place": pa.array(at[keep] - words.offsets[r]), "context": made(keep)})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", row_key(F.col("text"))).withColumn("spread", F.xxhash64("doc_id", "key"))
    # a row of size 0 stands for the document itself, the rest for fingerprints that may be met
    found = docs.mapInArrow(run, "doc_id long, key binary, n_words long, size int, hash long, place long, context binary")
    # equal contexts are one, with a set of items; equal sets have one name
    groups = known.groupBy("size", "hash", "context").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    groups = cut(groups.withColumn("set", F.xxhash64("items")))
    met = found.join(groups.select("size", "hash", F.col("context").alias("theirs"), "set"), ["size", "hash"], "left")
    spans = met.select("doc_id", "key", "n_words", "size", "place", "context", "theirs", "set").mapInArrow(_extended(window), "doc_id long, key binary, n_words long, set long, start long, end long")
    return spans, groups.select("set", "items").distinct()


def _by_row(spans: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id, key, n_words, copies, n_hit, items (sorted; null if none is named) of each different row."""
    # words that a span has beyond all before it; a document's own row has no words
    before = Window.partitionBy("doc_id", "key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    met = spans.groupBy("doc_id", "key", "start", "end", "set").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"))
    met = cut(met.withColumn("fresh", fresh))
    named = met.filter("set is not null").select("doc_id", "key", "set").distinct().join(sets, "set").select("doc_id", "key", F.explode("items").alias("item")).distinct()
    named = named.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = met.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.sum("copies").alias("copies"), F.sum("fresh").alias("n_hit"))
    named = named.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    return rows.join(named, rows["doc_id"].eqNullSafe(named["_id"]) & (rows["key"] == named["_key"]), "left").drop("_id", "_key")


def hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurring window), items (ids, sorted) of docs (doc_id, text) against bench (item_id, text).

    A window is `window` consecutive words of an item; an item with fewer words,
    but not none, is one window. Null or empty text has no words; nothing
    matches an empty benchmark. Rows that repeat give a row each; a null
    item_id is not reported, but its windows count. Other columns are ignored.
    """
    rows = _by_row(*matches(docs, bench, window))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", "n_hit", items.alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_")).drop("_")


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Counts and a digest of `hits`."""
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return hits(docs, bench, window).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, without those in which a window of the benchmark occurs: each by its own text, whatever its id."""
    spans, _ = matches(docs, bench, window)
    bad = spans.filter("set is not null").select(F.col("doc_id").alias("_bad"), F.col("key").alias("_key")).distinct()
    own = row_key(docs["text"])
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (own == bad["_key"]), "left_anti")
