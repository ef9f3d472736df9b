"""Substring dedup by suffix sorting.

A suffix sort whose comparisons are logarithmic: polynomial prefix hashes and a
binary search give the length that two suffixes have in common, the byte after
it decides. Equal neighbours are verified byte by byte, as are the runs of windows
that are taken together before the sort, so a collision of hashes never removes
anything.

`_repeats` brings together the texts of the windows that can be equal; the sort runs
within each bucket on those, each different text once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _arrays as A
from ._repeats import Chunk, Spec, Windows, cover

LENGTH, SEED = 50, 18
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class SuffixOrder:
    """Compares suffixes of `text`, cut after `length` bytes, through prefix hashes."""

    def __init__(self, text: np.ndarray, length: int, base: int):
        self.text, self.length, self.hash = text, length, A.PrefixHash(text, base)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b share, by binary search; most compared ones share all."""
        n = np.full(len(a), self.length)
        left = np.flatnonzero(~self.hash.same(a, b, self.length))
        a, b = a[left], b[left]
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.length - 1)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.hash.same(a, b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        n[left] = lo
        return n

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """a < b, or a <= b if ties."""
        n = self.common(a, b)
        last = len(self.text) - 1
        less = self.text[np.minimum(a + n, last)] < self.text[np.minimum(b + n, last)]
        return np.where(n == self.length, ties, less)

    def sort(self, at: np.ndarray) -> np.ndarray:
        """Mergesort of the suffixes, all merges of a level at once; a first deal by eight bytes keeps the merges short."""
        if len(at) < 2:
            return at
        head = self.text[np.minimum(at[:, None] + np.arange(8), len(self.text) - 1)].copy().view(">u8")[:, 0]
        order = np.argsort(head, kind="stable")
        at, head = at[order], head[order]
        new = np.append(True, head[1:] != head[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        width = 1
        while (size > width).any():
            begin, size = begin[size > width], size[size > width]
            here = np.repeat(begin, size) + (within := np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            group, most = np.repeat(begin, size), np.repeat(size, size)
            run = within // width
            left = run % 2 == 0
            other = np.minimum((run ^ 1) * width, most)
            lo, hi = group + other, group + np.minimum(other + width, most)
            floor = lo.copy()
            own = at[here]
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                x, y = at[mid], own[open_]
                # equal suffixes of the left run stay before those of the right
                go = np.where(left[open_], self.before(x, y, False), self.before(x, y, True))
                lo[open_[go]], hi[open_[~go]] = mid[go] + 1, mid[~go]
            at[group + (run // 2) * 2 * width + within % width + (lo - floor)] = own
            width *= 2
        return at


def later_windows(w: Windows, spec: Spec) -> np.ndarray:
    """Windows whose bytes also stand in a document with a smaller id."""
    hit = np.zeros(len(w.start), bool)
    if not len(w.start):
        return hit
    full = np.empty(len(w.start), np.uint64)
    for i in range(0, len(full), A.SLICE):
        part = w.start[i : i + A.SLICE]
        full[i : i + A.SLICE] = A.stretches(w.tokens, part, np.full(len(part), spec.length), spec.key)
    _, kind, count = np.unique(full, return_inverse=True, return_counts=True)
    able = np.flatnonzero(count[kind] > 1)  # a window without an equal hash has no equal
    if not len(able):
        return hit
    order = SuffixOrder(w.tokens, spec.length, spec.key)
    by_start = able[np.argsort(w.start[able])]
    at = order.sort(w.start[by_start].copy())
    which = by_start[np.searchsorted(w.start[by_start], at)]
    equal = order.common(at[1:], at[:-1]) == spec.length
    i = np.flatnonzero(equal)
    for a in range(0, len(i), 1 << 18):  # collisions: the bytes themselves
        j, step = i[a : a + (1 << 18)], np.arange(spec.length)
        equal[j] = (w.tokens[at[j + 1][:, None] + step] == w.tokens[at[j][:, None] + step]).all(1)
    group = np.cumsum(np.append(True, ~equal)) - 1
    least = np.full(group[-1] + 1, A.LAST_ID)
    np.minimum.at(least, group, w.doc[which])
    hit[which] = w.doc[which] > least[group]
    return hit


def _digest(c: Chunk, covered: np.ndarray) -> pa.Table:
    n = np.diff(c.offsets)

    def of(marks: np.ndarray) -> np.ndarray:
        total = np.zeros(len(marks) + 1, np.int32)
        np.cumsum(marks, out=total[1:])
        return np.diff(total[c.offsets]).astype(np.int64)

    begins = covered.copy()
    begins[1:] &= ~covered[:-1]
    edge = c.offsets[:-1][n > 0]
    begins[edge] = covered[edge]
    removed, spans = of(covered), of(begins)
    kept = [A.sha256(c.data[a:b][~covered[a:b]].tobytes()) for a, b in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True)]
    return pa.table({"doc_id": pa.array(c.ids, mask=c.null), "n_bytes": n, "n_removed": removed, "n_spans": spans, "kept_sha256": pa.array(kept, pa.string())})


def _spans(c: Chunk, covered: np.ndarray) -> pa.Table:
    out = []
    for k, (a, b) in enumerate(zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True)):
        own = np.concatenate([[False], covered[a:b], [False]])
        edge = np.flatnonzero(own[1:] != own[:-1])
        text = c.data[a:b][~covered[a:b]].tobytes()
        out.append({"doc_id": None if c.null[k] else int(c.ids[k]), "kept": text, "spans": [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]})
    return pa.Table.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (remaining bytes), spans (removed byte ranges) of docs (doc_id, text).

    A byte goes if a `length`-byte string over it also starts in a document
    with a smaller doc_id. Null or empty text: nothing kept, no spans. Rows with
    equal doc_id are not earlier than each other; a null doc_id comes after all
    others. Other columns are ignored; an empty table gives none.
    """
    return cover(docs, Spec(False, length, min(SEED, length), False, A.job_key()), later_windows, _spans, "doc_id long, kept binary, spans array<struct<start: long, end: long>>")


def removal_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Counts and a digest of `removed_spans`, without carrying texts."""
    return cover(docs, Spec(False, length, min(SEED, length), False, A.job_key()), later_windows, _digest, SCHEMA)
