"""Which windows of L tokens also start earlier in a corpus: the part that suffix arrays and suffix trees share.

Every window has a seed, the least hash among its k-grams, so equal windows
have equal seeds. A run is a stretch of neighbouring windows with one seed; runs of
one text are of one kind.

1. Each chunk of documents sends its seeds, once each, in packed blocks, to the
   seeds' buckets, which answer which of them other chunks have too.
2. Chunks send the text of a run of each kind, the earliest, if its seed is in
   other chunks or in several kinds of runs.
3. A bucket puts runs of equal text together, compared as they are and not by a
   hash alone; among the different ones of a seed, a resolver (a suffix sort, a
   suffix tree) finds the equal windows. A seed with very many kinds is split by a
   longer prefix, the whole window.
4. Chunks mark the covered tokens of their rows.

What a frequent passage costs is a record for each chunk, not for each row.
Chunks are hashes of id and text, so they can be formed again if an executor goes,
and rows that share an id are spread. Hashes are keyed by a number drawn for the job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._arrays import U64

CHUNK_BYTES = 8 << 20
#: A seed with more kinds of runs than this is dealt out by whole windows.
WIDE = 1024


@dataclass(frozen=True)
class Spec:
    words: bool  # tokens are words; else bytes
    length: int
    seed: int
    within: bool  # an earlier start in the same document counts too
    key: int


class Tokens:
    """The tokens of rows: bytes, or words by their hashes; `at` are the rows' token numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, spec: Spec):
        if spec.words:
            self.words = A.Words(data, offsets, spec.key)
            self.tokens, self.at = self.words.hash, self.words.offsets
        else:
            self.tokens, self.at = data, offsets


def same_text(tokens: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches at a and b have equal tokens, one by one."""
    out = np.ones(len(a), bool)
    ends = np.append(0, np.cumsum(size))
    for i, j in A.slices(ends):
        n = size[i:j]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = tokens[np.repeat(a[i:j], n) + within] != tokens[np.repeat(b[i:j], n) + within]
        out[i:j] = ~np.logical_or.reduceat(np.append(differ, False), np.minimum(np.cumsum(n) - n, len(differ)))
    return out


def kinds(tokens: np.ndarray, start: np.ndarray, size: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """The first stretch of each kind, and the kind of each stretch: those with equal tokens. Sizes are above 0."""
    h = A.stretches(tokens, start, size, key)
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    model = first[kind]
    odd = np.flatnonzero((size != size[model]) | (np.arange(len(size)) != model))
    odd = odd[(size[odd] != size[model[odd]]) | ~same_text(tokens, start[odd], start[model[odd]], np.minimum(size[odd], size[model[odd]]))]
    kind = kind.copy()  # hashes that collide: each such stretch is taken as a kind of its own, which is safe
    kind[odd] = len(first) + np.arange(len(odd))
    return np.append(first, odd), kind


class Chunk(Tokens):
    def __init__(self, table: pa.Table, spec: Spec):
        # rows that share an id are put in a fixed order, by a hash of their text
        table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")])
        self.ids, self.tie = A.ids(table["doc_id"]), table["tie"].to_numpy()
        self.null = table["doc_id"].is_null().to_numpy(zero_copy_only=False) if len(table) else np.zeros(0, bool)
        self.data, self.offsets = A.utf8(table["text"])
        super().__init__(self.data, self.offsets, spec)
        self.spec = spec
        self._runs()

    def _runs(self) -> None:
        """start: token; count: of windows; seed: hash; row. periodic: a window comes twice inside the run."""
        L, k, key = self.spec.length, self.spec.seed, self.spec.key
        found: list[tuple] = []
        sizes = np.diff(self.at)
        for i, j in A.slices(self.at):
            if j == i + 1:  # a long row in pieces: a run cut in two stays right, as its seed then has several kinds
                pieces = [(a, min(a + A.SLICE, self.at[j])) for a in range(int(self.at[i]), max(int(self.at[j]) - L + 1, int(self.at[i])), A.SLICE - L + 1)]
            else:
                pieces = [(self.at[i], self.at[j])]
            for a, b in pieces:
                if b - a < L:
                    continue
                own_tokens = self.tokens[a:b]
                least = A.sliding_min(A.grams(own_tokens, k, key), L - k + 1)
                row = np.repeat(np.arange(i, j), sizes[i:j]) if j > i + 1 else np.full(b - a, i)
                at = np.flatnonzero(row[: len(least)] == row[L - 1 :])
                if not len(at):
                    continue
                seed, own = least[at], row[at]
                new = np.ones(len(at), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (own[1:] != own[:-1])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(at)))
                start = at[first]
                periodic = np.zeros(len(first), bool)
                if self.spec.within:
                    group = np.cumsum(new) - 1
                    full = A.grams(own_tokens, L, key)[at] ^ A.mix(group.astype(U64) + U64(1))
                    order = np.argsort(full)
                    same = full[order][1:] == full[order][:-1]
                    periodic[group[order[1:][same]]] = True
                found.append((start + a, count, seed[first], own[first], periodic))
        types = (np.int64, np.int64, U64, np.int64, bool)
        self.start, self.count, self.seed, self.row, self.periodic = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, kind) for n, kind in enumerate(types))
        # the first run of each kind in this chunk; rows are in order
        self.first, self.kind = kinds(self.tokens, self.start, self.count + L - 1, key)
        # seeds, and the seed of each kind
        self.seeds, self.seed_of, self.variety = np.unique(self.seed[self.first], return_inverse=True, return_counts=True)

    def told(self, table: pa.Table, part: int) -> pa.Table:
        return table.filter(pa.compute.equal(table["part"], part))

    def sent(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Kinds that others must be compared with, and those among them whose seed has very many."""
        shared, wide = np.zeros(len(self.seeds), bool), self.variety > WIDE
        for part, mark in ((0, shared), (1, wide)):
            seed, _ = A.unpack(self.told(answers, part)["value"], U64)
            mark[np.searchsorted(self.seeds, seed)] = True
        some = (shared | wide | (self.variety > 1))[self.seed_of] | self.periodic[self.first]
        return np.flatnonzero(some), wide[self.seed_of]

    def covered(self, answers: pa.Table) -> np.ndarray:
        """Which tokens lie in a window that also starts earlier."""
        model = self.first[self.kind]
        later = np.arange(len(self.kind)) != model if self.spec.within else self.ids[self.row] > self.ids[self.row[model]]
        earlier = np.zeros(len(self.first), bool)
        earlier[A.unpack(self.told(answers, 2)["value"], np.uint32)[0]] = True
        whole = earlier[self.kind] | later
        edge = np.zeros(len(self.tokens) + 1, np.int32)
        s = self.start[whole]
        np.add.at(edge, s, 1)
        np.add.at(edge, s + self.count[whole] + self.spec.length - 1, -1)
        single = self.told(answers, 3)
        kind, _ = A.unpack(single["value"], np.uint32)
        offset, _ = A.unpack(single["offset"], np.uint32)
        if len(kind):
            order = np.argsort(kind, kind="stable")
            kind, offset = kind[order], offset[order]
            left = np.flatnonzero(~whole)
            lo, hi = np.searchsorted(kind, self.kind[left]), np.searchsorted(kind, self.kind[left], "right")
            which, at = A.gather(offset, lo, hi - lo)
            p = np.repeat(self.start[left], hi - lo) + which
            np.add.at(edge, p, 1)
            np.add.at(edge, p + self.spec.length, -1)
        return np.cumsum(edge[:-1], out=edge[:-1]) > 0


def squeeze(text: np.ndarray) -> bytes:
    """Texts of runs are most of what is shuffled, and Spark's own compression is a light one."""
    return zstandard.ZstdCompressor(level=1).compress(text.tobytes())


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


#: seeds of a chunk; answers: 0 seeds of other chunks too, 1 seeds with many kinds, 2 kinds that come earlier, 3 windows of kinds that do; contexts: runs of a kind, by column.
SEEDS = "bucket int, chunk int, seed binary, kinds binary"
ANSWERS = "chunk int, part int, value binary, offset binary"
CONTEXTS = "bucket int, chunk int, kind binary, seed binary, doc binary, tie binary, start binary, base binary, size binary, bytes binary, text binary"
_SEEDS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("seed", pa.binary()), ("kinds", pa.binary())])
_ANSWERS = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("value", pa.binary()), ("offset", pa.binary())])
_CONTEXTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), *((c, pa.binary()) for c in ("kind", "seed", "doc", "tie", "start", "base", "size", "bytes", "text"))])


def _bucket(seed: np.ndarray, buckets: int) -> np.ndarray:
    return (seed % U64(buckets)).astype(np.int32)


def _send_seeds(spec: Spec, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        number, c = table["chunk"][0].as_py(), Chunk(table, spec)
        parts = A.split_by(_bucket(c.seeds, buckets), c.seeds, np.minimum(c.variety, WIDE + 1).astype(np.uint16))
        return _table([{"bucket": b, "chunk": number, "seed": seed.tobytes(), "kinds": many.tobytes()} for b, (seed, many) in parts], _SEEDS)

    return run


def _answer(table: pa.Table) -> pa.Table:
    seed, n = A.unpack(table["seed"], U64)
    many, _ = A.unpack(table["kinds"], np.uint16)
    chunk = np.repeat(table["chunk"].to_numpy(), n)
    _, at, count = np.unique(seed, return_inverse=True, return_counts=True)
    wide = np.bincount(at, weights=many)[at] > WIDE if len(at) else np.zeros(0, bool)
    out = []
    for part, some in ((0, count[at] > 1), (1, wide)):
        out += [{"chunk": c, "part": part, "value": s.tobytes(), "offset": None} for c, (s,) in A.split_by(chunk[some], seed[some])]
    return _table(out, _ANSWERS)


def _send_contexts(spec: Spec, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _table([], _CONTEXTS)
        number, c = table["chunk"][0].as_py(), Chunk(table, spec)
        kind, wide = c.sent(answers)
        whole, split = kind[~wide[kind]], kind[wide[kind]]
        r = c.first[whole]
        seed, start, base, size = c.seed[r], c.start[r], np.zeros(len(r), np.int64), c.count[r] + spec.length - 1
        if len(split):
            count = c.count[c.first[split]]
            base2 = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start2 = np.repeat(c.start[c.first[split]], count) + base2
            size2 = np.full(len(start2), spec.length)
            whole, r = np.append(whole, np.repeat(split, count)), np.append(r, np.repeat(c.first[split], count))
            seed, start, base, size = np.append(seed, A.stretches(c.tokens, start2, size2, spec.key)), np.append(start, start2), np.append(base, base2), np.append(size, size2)
        row, odd = c.row[r], c.periodic[r] & (size > spec.length)
        place = start - c.at[row]
        begin, end = (c.words.start[start], c.words.end[start + size - 1]) if spec.words and len(start) else (start, start + size)
        rows = []
        for b, (i,) in A.split_by(_bucket(seed, buckets), np.arange(len(seed))):
            text, _ = A.gather(c.data, begin[i], (end - begin)[i])
            rows.append(
                {"bucket": b, "chunk": number, "kind": A.pack(whole[i], np.uint32), "seed": seed[i].tobytes(), "doc": c.ids[row[i]].tobytes(), "tie": c.tie[row[i]].tobytes() if spec.within else b""}
                | {"start": A.pack(place[i], np.int64) if spec.within else b"", "base": A.pack(base[i], np.uint32), "size": A.pack(np.where(odd[i], -size[i], size[i]), np.int32), "bytes": A.pack((end - begin)[i], np.uint32), "text": squeeze(text)}
            )
        return _table(rows, _CONTEXTS)

    return run


@dataclass
class Windows:
    """Windows to compare: token number where each starts, and its place in order: documents that count as earlier have a smaller `doc`, within one the smaller `place` is earlier."""

    tokens: np.ndarray
    start: np.ndarray
    doc: np.ndarray
    place: np.ndarray


def compared(tokens: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.ndarray, doc: np.ndarray, place: np.ndarray, spec: Spec, later: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Of runs, those windows that aren't the earliest of their kind: number of the run, place in it.

    Only windows of one seed can be equal, so runs are compared some seeds at a time,
    on a copy of their own tokens: what a comparison needs is many times its tokens.
    """
    order = np.argsort(seed, kind="stable")
    first = np.flatnonzero(np.append(True, seed[order][1:] != seed[order][:-1])[: len(order)])
    first, ends = np.append(first, len(order)), np.append(0, np.cumsum(size[order]))
    runs, offsets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in A.slices(ends[first]):
        r = order[first[i] : first[j]]
        text, at = A.gather(tokens, start[r], size[r])
        count = size[r] - spec.length + 1
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        own = np.repeat(r, count)
        hit = later(Windows(text, np.repeat(at[:-1], count) + within, doc[own], place[own] + within), spec)
        runs.append(own[hit])
        offsets.append(within[hit])
    return np.concatenate(runs), np.concatenate(offsets)


def _resolve(spec: Spec, later: Callable[[Windows, Spec], np.ndarray]):
    def run(table: pa.Table) -> pa.Table:
        size, n = A.unpack(table["size"], np.int32)
        (kind, _), (base, _), (length, _) = (A.unpack(table[c], np.uint32) for c in ("kind", "base", "bytes"))
        (seed, _), (doc, _), (tie, _), (place, _) = A.unpack(table["seed"], U64), A.unpack(table["doc"], np.int64), A.unpack(table["tie"], np.int64), A.unpack(table["start"], np.int64)
        place = place if spec.within else np.zeros(len(doc), np.int64)
        data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for x in table["text"].to_pylist()), np.uint8)
        chunk = np.repeat(table["chunk"].to_numpy(), n)
        periodic, size = size < 0, np.abs(size).astype(np.int64)
        t = Tokens(data, np.append(0, np.cumsum(length.astype(np.int64))), spec)
        # in order, so that the first run of a kind is the earliest
        order = np.lexsort((place, tie, doc) if spec.within else (doc,))
        if spec.within:  # one number for document and tie
            new = np.append(True, (doc[order][1:] != doc[order][:-1]) | (tie[order][1:] != tie[order][:-1]))
            doc = doc.copy()
            doc[order] = np.cumsum(new[: len(order)])
        first, own = kinds(t.tokens, t.at[:-1][order], size[order], spec.key)
        model = np.empty(len(order), np.int64)
        model[order] = order[first[own]]
        copy = (model != np.arange(len(order))) & (spec.within | (doc > doc[model]))
        # runs that no other is equal to are compared window by window, if there are several of a seed
        distinct = order[first]
        _, of, several = np.unique(seed[distinct], return_inverse=True, return_counts=True)
        distinct = distinct[(several[of] > 1) | periodic[distinct]]
        run_of, within = compared(t.tokens, t.at[distinct], size[distinct], seed[distinct], doc[distinct], place[distinct], spec, later)
        run_of = distinct[run_of]
        # what holds for a run holds for those equal to it
        by_run = np.argsort(run_of, kind="stable")
        run_of, within = run_of[by_run], within[by_run]
        rest = np.flatnonzero(~copy)
        lo, hi = np.searchsorted(run_of, model[rest]), np.searchsorted(run_of, model[rest], "right")
        offset, _ = A.gather(within, lo, hi - lo)
        rest = np.repeat(rest, hi - lo)
        # a single window is told as such: its kind may have been split
        single, whole = np.flatnonzero(copy & (size == spec.length)), np.flatnonzero(copy & (size > spec.length))
        rest, offset = np.append(rest, single), np.append(offset, np.zeros(len(single), np.int64)) + base[np.append(rest, single)]
        out = [{"chunk": c, "part": 2, "value": k.tobytes(), "offset": None} for c, (k,) in A.split_by(chunk[whole], kind[whole])]
        out += [{"chunk": c, "part": 3, "value": k.tobytes(), "offset": A.pack(o, np.uint32)} for c, (k, o) in A.split_by(chunk[rest], kind[rest], offset)]
        return _table(out, _ANSWERS)

    return run


def cover(docs: DataFrame, spec: Spec, later: Callable, finish: Callable[[Chunk, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """finish(chunk, covered tokens) of every chunk of docs (doc_id, text). later(windows, spec): which windows aren't the earliest of their kind."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // CHUNK_BYTES))
    tie = F.xxhash64("text")
    docs = docs.withColumn("tie", tie).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks)).cast("int"))
    seeds = docs.groupBy("chunk").applyInArrow(_send_seeds(spec, chunks), SEEDS)
    answers = seeds.groupBy("bucket").applyInArrow(_answer, ANSWERS)
    contexts = docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_send_contexts(spec, chunks), CONTEXTS)
    told = contexts.groupBy("bucket").applyInArrow(_resolve(spec, later), ANSWERS)

    def last(table: pa.Table, told: pa.Table) -> pa.Table:
        c = Chunk(table, spec)
        return finish(c, c.covered(told))

    return docs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(last, schema)
