"""Resampling documents towards a target's word statistics.

Runs of words fall into hashed buckets; a bucket's gain says how much commoner it is in
the target texts. A document weighs the mean gain of its runs, read from an array of all
gains; Gumbel noise from a hash of its id makes the highest scores a sample without
replacement. The score at the cut is found exactly by weighted median-of-medians: each
partition tells the median of the keys it has left and their number, the weighted median
of those is the next pivot, and what lies on its wrong side, at least a quarter of all,
is out. Only the winners are sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import cut, free

BUCKETS, LONGEST, SEED = 10_000, 2, 7
PERCENT, LEAST_WORDS = 25, 20
#: Keys left that are few enough to be sorted at once (16 bytes each).
FEW_KEYS = 10_000
#: Words whose runs are looked at together, and bytes of a text that are split together.
TOGETHER, SLICE = 1 << 19, 1 << 20
#: Distinct words that a task remembers, and the longest words, in bytes, whose checksums are shifted through tables.
REMEMBERED, TABLED = 1 << 19, 48
#: Bytes of words stay (A-Z as a-z), all others become blanks.
BLANKED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Words(dict):
    """Numbers of words, and what their checksums add to those of the words before them."""

    def __init__(self) -> None:
        super().__init__()
        self.alone: list[int] = []
        self.behind: list[int] = []
        self.sizes: list[int] = []
        self.known: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.known)
        self.known.append(word)
        self.alone.append(zlib.crc32(word))
        self.behind.append(zlib.crc32(b" " + word))
        self.sizes.append(len(word) + 1)
        return number


def shift_table(size: int) -> np.ndarray:
    """4 x 256 words: what a checksum's bytes become when `size` more bytes follow. CRC is linear over bits, so 32 of them give all."""
    zeros = bytes(size)
    bits = [zlib.crc32(zeros, 1 << k) ^ zlib.crc32(zeros) for k in range(32)]
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for k in range(8):
            out[byte, 1 << k : 2 << k] = out[byte, : 1 << k] ^ np.uint32(bits[8 * byte + k])
    return out


SHIFTS: np.ndarray | None = None


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The checksums as they enter those of texts longer by `size` (up to TABLED) bytes."""
    global SHIFTS
    if SHIFTS is None:
        SHIFTS = np.stack([shift_table(n) for n in range(TABLED + 1)])
    return SHIFTS[size, 0, crc & 255] ^ SHIFTS[size, 1, crc >> 8 & 255] ^ SHIFTS[size, 2, crc >> 16 & 255] ^ SHIFTS[size, 3, crc >> 24]


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    blanked, at = text.translate(BLANKED), 0
    while at < len(blanked):
        end = blanked.find(b" ", at + SLICE)
        end = len(blanked) if end < 0 else end
        yield blanked[at:end].split()
        at = end


def runs(texts: list[bytes | None], longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, bucket, is a single word) of all runs of 1 to `longest` words, as arrays of bounded size."""
    words, row, ids, old = Words(), [], [], []

    def found():
        where, word, seen = np.concatenate(row), np.concatenate(ids), np.concatenate(old)
        alone, behind, sizes = np.array(words.alone, np.uint32)[word], np.array(words.behind, np.uint32)[word], np.array(words.sizes)[word]
        crc = alone
        for n in range(1, longest + 1):
            if n > 1:  # the run one shorter, and the word behind it
                crc, last = crc[:-1], slice(n - 1, None)
                size, more = sizes[last], behind[last]
                small = np.minimum(size, TABLED)
                longer = shifted(crc, small) ^ more
                for k in np.flatnonzero(size > TABLED):
                    longer[k] = zlib.crc32(b" " + words.known[word[k + n - 1]], int(crc[k]))
                crc = longer
            stop = len(word) - n + 1
            whole = (where[:stop] == where[n - 1 :]) & ~seen[n - 1 :] if stop > 0 else np.zeros(0, bool)
            yield where[:stop][whole], (crc[whole] % buckets).astype(np.int64), np.full(int(whole.sum()), n == 1)

    n = 0
    for k, text in enumerate(texts):
        for some in _slices(text or b""):
            if not some:
                continue
            ids.append(np.fromiter(map(words.__getitem__, some), np.int64, len(some)))
            row.append(np.full(len(some), k))
            old.append(np.zeros(len(some), bool))
            n += len(some)
            if n >= TOGETHER:
                yield from found()
                keep = longest - 1  # runs go on behind the last words
                tail = [words.known[i] for i in np.concatenate(ids)[len(np.concatenate(ids)) - keep :]]
                where = np.concatenate(row)[n - keep :]
                if len(words) > REMEMBERED:
                    words = Words()
                ids, row, old, n = [np.array([words[w] for w in tail], np.int64)], [where], [np.ones(len(tail), bool)], len(tail)
    if ids:
        yield from found()


def counted(rows: DataFrame, name: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket and its number of runs in the column text of rows, as column `name`."""

    def count(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in runs(batch.column(0).to_pylist(), longest, buckets):
                n += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.record_batch({"bucket": at.astype(np.int32), "n": n[at]})

    some = rows.select(F.col("text").cast("string").cast("binary")).mapInArrow(count, "bucket int, n long")
    return some.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: floor(1000 ln) of its smoothed share of the target's runs over that of the documents'."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    both = counted(docs, "s", longest, buckets).join(counted(target, "t", longest, buckets), "bucket", "full")
    for r in both.collect():  # a row for each bucket at most
        s[r["bucket"]], t[r["bucket"]] = r["s"] or 0, r["t"] or 0
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(rows: DataFrame, text: str, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """The rows with n_words, n_features and weight in place of the column `text`, which is binary."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)
    kept = [c for c in rows.columns if c != text]

    def weigh(batches):
        for batch in batches:
            n_words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for where, bucket, single in runs(batch.column(text).to_pylist(), longest, len(shared.value)):
                n += np.bincount(where, minlength=len(n))
                n_words += np.bincount(where[single], minlength=len(n))
                total += np.bincount(where, shared.value[bucket], len(n)).astype(np.int64)  # whole numbers far below 2^53
            made = {"n_words": n_words, "n_features": n, "weight": np.where(n > 0, total // np.maximum(n, 1), 0)}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, made.values())], [*kept, *made])

    schema = rows.select(*kept).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    return rows.mapInArrow(weigh, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x) of the Gumbel noise x that a document's id draws; a null id counts as an empty one."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row of docs, written to the checkpoint folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    out = weighed(rows, "text", gains(docs, target, longest, buckets), longest)
    return cut(out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))


#: Keys are (score, id), the id of rows without one being the last.
LAST = (1 << 63) - 1
Key = tuple[int, int]


def _behind(key: Key) -> Column:
    """Is a row behind the key in the order of scores, falling, and ids?"""
    return (F.col("score") < key[0]) | ((F.col("score") == key[0]) & (F.col("id") > key[1]))


def _before(key: Key) -> Column:
    return (F.col("score") > key[0]) | ((F.col("score") == key[0]) & (F.col("id") < key[1]))


SIDES = "n_before long, before_score long, before_id long, n_equal long, n_behind long, behind_score long, behind_id long"


def _told(keys: DataFrame, pivot: Key | None):
    """For each partition: how many keys lie before the pivot, at it and behind it, and the medians of both sides."""

    def tell(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        table = pa.concat_tables(tables)
        score, id_ = table.column("score").to_numpy(), table.column("id").to_numpy()
        if pivot is None:
            before = np.zeros(len(score), bool)
            equal = before
        else:
            before = (score > pivot[0]) | ((score == pivot[0]) & (id_ < pivot[1]))
            equal = (score == pivot[0]) & (id_ == pivot[1])

        def median(side):
            s, i = score[side], id_[side]
            if not len(s):
                return [0, None, None]
            at = np.lexsort((i, -s))[(len(s) - 1) // 2]
            return [len(s), int(s[at]), int(i[at])]

        row = [*median(before), int(equal.sum()), *median(~before & ~equal)]
        names = [c.split()[0] for c in SIDES.split(", ")]
        yield pa.record_batch({c: pa.array([v], pa.int64()) for c, v in zip(names, row)})

    return keys.mapInArrow(tell, SIDES).collect()  # a row for each task


def _weighted_median(medians: list[tuple[int, Key]]) -> Key:
    """The first median, in order, that half of all keys belong to or lie before."""
    medians = sorted((m for m in medians if m[0]), key=lambda m: (-m[1][0], m[1][1]))
    half, total = sum(n for n, _ in medians) / 2, 0
    for n, key in medians:
        total += n
        if total >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int, few: int = FEW_KEYS) -> Key:
    """The k-th key of keys (score, id), from the highest score, ties by smaller id. Needs 1 <= k <= their number."""
    first = _told(keys, None)
    left = written = sum(r["n_behind"] for r in first)
    if not 1 <= k <= left:
        raise ValueError(f"{k} of {left} keys")
    medians = [(r["n_behind"], (r["behind_score"], r["behind_id"])) for r in first]
    while left > few:
        pivot = _weighted_median(medians)
        sides = _told(keys, pivot)
        before, equal = sum(r["n_before"] for r in sides), sum(r["n_equal"] for r in sides)
        if before < k <= before + equal:
            return pivot
        side = "before" if k <= before else "behind"
        keys = keys.filter(_before(pivot) if side == "before" else _behind(pivot))
        if side == "behind":
            k -= before + equal
        medians = [(r[f"n_{side}"], (r[f"{side}_score"], r[f"{side}_id"])) for r in sides]
        left = sum(n for n, _ in medians)
        if left * 4 <= written:  # later turns read what is left only
            keys, written = cut(keys), left
    return tuple(sorted(((r["score"], r["id"]) for r in keys.collect()), key=lambda x: (-x[0], x[1]))[k - 1])


def _keys(rows: DataFrame, least_words: int) -> DataFrame:
    return rows.filter(F.col("n_words") >= least_words).select("score", F.coalesce("doc_id", F.lit(LAST)).alias("id"))


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs (doc_id, text) against target (text).

    rank runs from 1 over the drawn rows: of the N with `least_words` words or more, the
    floor(percent N / 100) highest scores, ties to the smaller doc_id, a null one last.
    Rows equal in score and id rank by n_features, then in any order; the draw ends
    inside them if it must. Null text has no words, weighs 0 and is never drawn. Other
    columns are ignored; without rows there is no result.
    """
    rows = scored(docs, target, longest, buckets, seed)
    keys = _keys(rows, least_words)
    k = percent * keys.count() // 100
    plain = lambda some, rank: some.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
    if not k:
        return plain(rows, F.lit(None))
    last = cutoff(keys, k)
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(LAST))).withColumn("number", F.monotonically_increasing_id())
    wins = (F.col("n_words") >= least_words) & ~_behind(last)
    order = [F.desc("score"), F.asc("id"), F.asc("n_features"), F.asc("number")]
    winners = cut(rows.filter(wins).repartitionByRange(*order).sortWithinPartitions(*order))
    # a row's rank: those in ranges before its own, and its place there
    place = F.monotonically_increasing_id()
    winners = winners.withColumns({"range": F.shiftright(place, 33).cast("int"), "place": place.bitwiseAND(F.lit((1 << 33) - 1))})
    ahead, offsets = 0, []
    for r in winners.groupBy("range").count().orderBy("range").collect():  # a row for each range
        offsets.append((r["range"], ahead))
        ahead += r["count"]
    table = winners.sparkSession.createDataFrame(offsets, "range int, ahead long")
    winners = winners.join(F.broadcast(table), "range")
    rank = F.col("ahead") + F.col("place") + 1
    return plain(winners, F.when(rank <= k, rank)).unionByName(plain(rows.filter(~wins), F.lit(None)))


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn rows of docs, all columns; rows that repeat the last one's id and score all stay."""
    gain = gains(docs, target, longest, buckets)
    id_, text, *made = free(docs, "_id", "_text", "_n_words", "_n_features", "_weight")
    rows = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), text: F.col("text").cast("string").cast("binary")})
    clash = {c: f"{c}__" for c in ("n_words", "n_features", "weight", "score", "id") if c in docs.columns}
    rows = weighed(rows.withColumnsRenamed(clash), text, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("id", F.col(id_))
    keys = cut(rows.filter(F.col("n_words") >= least_words).select("score", "id"))
    k = percent * keys.count() // 100
    if not k:
        return docs.limit(0)
    kept = rows.filter((F.col("n_words") >= least_words) & ~_behind(cutoff(keys, k)))
    return kept.drop("n_words", "n_features", "weight", "score", "id", id_).withColumnsRenamed({b: a for a, b in clash.items()}).select(*(f"`{c}`" for c in docs.columns))
