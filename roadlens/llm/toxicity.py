"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary rows, one on the
windows of toxic rows that separate them, those around beginnings of words that
toxic rows share and ordinary rows hardly have (without such, all their windows). Every window of a text is compressed
with the ordinary dictionary and with both; what the toxic one saves is the
window's gain. The largest gains of a text, calibrated on labelled rows that the
dictionaries haven't seen, are its score. Of several sizes of the toxic dictionary
the one that fits those rows best is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _arrays as A
from ._arrays import U64

#: The classifier learns from at most this many labelled rows of each kind, those with the least hash of their id, of texts of at most this many bytes.
TOXIC_ROWS, ORDINARY_ROWS, ROW_BYTES = 2000, 5000, 1 << 15
#: Bytes of a window, and how many it shares with the next one.
WINDOW, OVERLAP = 128, 16
#: The ordinary dictionary is trained on at most this many windows, evenly taken from its rows.
ORDINARY_WINDOWS = 60_000
DICTIONARY_BYTES, LEVEL = 110_000, 9
#: Sizes of the toxic dictionary to choose from; bytes of its samples before and after the beginning of a word.
TOXIC_BYTES, AROUND = (1024, 2048, 4096), (4, 14)
#: A beginning of a word separates if this share of toxic rows has it, and a fiftieth of that share of ordinary rows at most.
LEAST_SHARE, LEAST_ROWS, CONTRAST = 0.03, 3, 50
LIMIT = 0.7
#: Ordinary texts of so many bytes are searched for beginnings at once.
SLICE_BYTES = 1 << 19


def plain(text: str) -> bytes:
    return f" {' '.join(text.lower().split())} ".encode()


def windows(text: bytes) -> list[bytes]:
    step = WINDOW - OVERLAP
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - OVERLAP), step)]


def beginnings(texts: list[bytes]):
    """Yields (hash, row, hash with the word before, start) of the beginnings of words, one length of four to twelve bytes after the other."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    words = A.Words(data, at, KEY)
    row = np.repeat(np.arange(len(texts)), np.diff(words.offsets))
    size = words.end - words.start
    before = np.append(U64(0), words.hash[:-1])
    for n in range(4, 13):
        w = np.flatnonzero(size >= n)
        h = A.stretches(data, words.start[w], np.full(len(w), n), KEY)
        yield h, row[w], A.mix(h ^ before[w]), words.start[w]


#: Only a bounded sample is hashed, and reruns agree.
KEY = 20


def rows_with(kind: np.ndarray, row: np.ndarray, kinds: int) -> np.ndarray:
    """In how many rows each kind is."""
    rows = int(row.max()) + 1 if len(row) else 1
    return np.bincount(np.unique(kind.astype(np.int64) * rows + row) // rows, minlength=kinds)


def separating(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The surroundings of what toxic rows share and ordinary rows hardly have, in order."""
    found = []
    for h, row, context, start in beginnings(toxic):
        kinds, kind = np.unique(h, return_inverse=True)
        # copies of one text count once: only different words before it make a beginning frequent
        varied = np.bincount(kind[np.unique(context, return_index=True)[1]], minlength=len(kinds))
        shared = rows_with(kind, row, len(kinds))
        some = np.minimum(shared, varied) >= max(LEAST_ROWS, LEAST_SHARE * len(toxic))
        found.append((kinds[some], shared[some], h[some[kind]], start[some[kind]]))
    able, shared, h, start = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(able):
        return []
    order = np.argsort(able)
    able, shared, usual = able[order], shared[order], np.zeros(len(able), np.int64)
    for i, j in A.slices(np.append(0, np.cumsum([len(t) for t in ordinary])).astype(np.int64), SLICE_BYTES):
        for x, r, _, _ in beginnings(ordinary[i:j]):
            at = np.minimum(np.searchsorted(able, x), len(able) - 1)
            hit = able[at] == x
            usual += rows_with(at[hit], r[hit], len(able))
    able = able[usual / max(1, len(ordinary)) * CONTRAST <= shared / len(toxic)]
    data, (before, after) = b"".join(toxic), AROUND
    return [data[max(0, p - before) : p + after] for p in np.unique(start[np.isin(h, able)]).tolist()]


def trained(size: int, samples: list[bytes], **parameters) -> bytes:
    """A zstandard dictionary; of samples that are too few to train on, their text up to that size."""
    try:
        return zstandard.train_dictionary(size, samples, **parameters).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def compressors(self):
        make = lambda raw: zstandard.ZstdCompressor(
            compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0),
            dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        )
        # what both have stands at the same distance from the text
        return make(bytes(len(self.toxic)) + self.ordinary), make(self.toxic + self.ordinary)

    @staticmethod
    def features(text: bytes, pair) -> list[float]:
        gain = np.array([len(pair[0].compress(w)) - len(pair[1].compress(w)) for w in windows(text)], float)
        top = np.sort(np.maximum(gain, 0))[::-1]
        return [1.0, top[0], top[1] if len(top) > 1 else 0.0, np.log(len(top))]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))

    def calibrated(self, rows: list[tuple[bytes, float]]) -> float:
        """Sets the weights by logistic regression and returns the mean loss."""
        pair = self.compressors()
        x, y = np.array([self.features(t, pair) for t, _ in rows]), np.array([y for _, y in rows])
        ridge = np.diag([1e-3, 0.05, 0.05, 0.05])
        for _ in range(30):
            p = self.score(x)
            self.weights += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ self.weights)
        p = np.clip(self.score(x), 1e-9, 1 - 1e-9)
        return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def fitted(toxic: list[str], ordinary: list[str]) -> Model:
    """A model of labelled texts: two thirds of them for the dictionaries, one for the calibration."""
    toxic, ordinary = [plain(t) for t in toxic], [plain(t) for t in ordinary]
    part = lambda x, own: [t for i, t in enumerate(x) if (i % 3 == 0) == own]
    known = part(ordinary, False)
    step = max(1, -(-sum(len(windows(t)) for t in known) // ORDINARY_WINDOWS))
    usual = trained(DICTIONARY_BYTES, list(islice((w for t in known for w in windows(t)), 0, None, step)))
    near = separating(part(toxic, False), part(ordinary, False)) or [w for t in part(toxic, False) for w in windows(t)]
    rows = [(t, y) for x, y in ((toxic, 1.0), (ordinary, 0.0)) for t in part(x, True)]
    if not rows or not near:  # nothing is known to be toxic: all texts get the same low score
        return Model(usual, b"", np.array([-3.0, 0, 0, 0]))
    models = [Model(usual, trained(n, near, k=16, d=6), np.zeros(4)) for n in TOXIC_BYTES]
    losses = [m.calibrated(rows) for m in models]
    return models[int(np.argmin(losses))]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """_id, _toxic, _text of the labelled documents that aren't held out, a bounded number of them."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.col("toxic").cast("int")).alias("_toxic"), F.max(F.col("toxic").cast("int")).alias("_most"))
    known = known.filter("_toxic = _most").drop("_most").filter(~held_out(F.col("_id")))  # who is labelled both ways teaches nothing
    order = F.xxhash64("_id")
    picked = known.filter("_toxic = 1").orderBy(order, "_id").limit(TOXIC_ROWS).unionAll(known.filter("_toxic = 0").orderBy(order, "_id").limit(ORDINARY_ROWS))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).join(F.broadcast(picked), "_id").filter(F.octet_length("_text") <= ROW_BYTES)
    # many rows may share a labelled id: so many rows are taken, not ids
    place = F.row_number().over(W.partitionBy("_toxic").orderBy(order, "_id", F.xxhash64("_text"), "_text"))
    texts = texts.withColumn("_place", place).filter(F.col("_place") <= ORDINARY_ROWS).filter((F.col("_toxic") == 0) | (F.col("_place") <= TOXIC_ROWS))
    return texts.drop("_place")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the sample, trained in the driver; `learned` spares the driver's memory."""
    rows = sample(docs, labels).orderBy("_id", "_text").select("_toxic", "_text").collect()
    return fitted([r["_text"] for r in rows if r["_toxic"] == 1], [r["_text"] for r in rows if r["_toxic"] == 0])


def _train(batches):
    texts: tuple[list[str], list[str]] = ([], [])
    for batch in batches:
        for toxic, text in zip(batch.column("_toxic").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            texts[toxic == 0].append(text)
    A.give_back()
    m = fitted(*texts)
    A.give_back()
    yield pa.record_batch({"ordinary": pa.array([m.ordinary], pa.binary()), "toxic": pa.array([m.toxic], pa.binary()), "weights": pa.array([m.weights.tolist()])})


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the sample, trained in one task: only the dictionaries and weights come to the driver."""
    rows = sample(docs, labels).repartition(1).sortWithinPartitions("_id", "_text")
    found = rows.select("_toxic", "_text").mapInArrow(_train, "ordinary binary, toxic binary, weights array<double>").collect()
    return Model(bytes(found[0]["ordinary"]), bytes(found[0]["toxic"]), np.array(found[0]["weights"])) if found else fitted([], [])


def score(docs: DataFrame, labels: DataFrame) -> Callable[[Column], Column]:
    """The score of a column of texts by a model of the labelled rows of docs: only the texts go to Python, only scores come back."""
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair = model.value.compressors()
        for texts in batches:
            A.give_back()  # the batch before, or an earlier task's
            x = np.array([model.value.features(plain(t.as_py() or ""), pair) for t in texts]).reshape(-1, 4)
            yield pa.array(model.value.score(x))
        A.give_back()

    made = F.arrow_udf(run, "double")
    return lambda text: made(text.cast("string"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text), by a model of labels (doc_id, toxic).

    Null or empty text is scored as an empty one. Labels that are null or contradict
    each other teach nothing. A row with null doc_id is not
    held out. Without toxic and ordinary labels all scores are low. Repeated rows
    give a row each; other columns are never looked at.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(docs, labels)(F.col("text")).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that aren't predicted to be toxic: each by its own text, whatever its id."""
    return docs.filter(score(docs, labels)(docs["text"]) < LIMIT)
