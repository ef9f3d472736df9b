"""Vectorised helpers on Arrow buffers: tokens, keyed hashes, polynomial hashes, windows."""

from __future__ import annotations

import ctypes
import hashlib
import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)
#: Modulus of the polynomial hashes, a prime: no text is built that collides whatever the base.
PRIME = U64((1 << 61) - 1)
#: Stretches of more steps than this are hashed by a library function, one by one.
MOST_STEPS = 32
#: Tokens handled at once, so that scratch arrays stay within a few dozen MB.
SLICE = 1 << 19
#: Stands for a missing doc_id: it comes after every real one.
LAST_ID = np.iinfo(np.int64).max

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words as items of a benchmark have them: digits, letters, all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Only glibc has it.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def job_key() -> int:
    """A number that no one knows beforehand: hashes under it can't be made to collide by choice of texts."""
    return secrets.randbits(63) | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(29))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def grams(values: np.ndarray, k: int, key: int) -> np.ndarray:
    """Hash of every k neighbours among bytes or 64-bit tokens."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    start = mix(np.array([key ^ k], U64))[0]
    if values.dtype == np.uint8:
        at = _eights(values)
        if k < 8:
            return mix((at[:n] & U64((1 << 8 * k) - 1)) ^ start)
        h = mix(at[:n] ^ start)
        for shift in (*range(8, k - 7, 8), *([k - 8] if k % 8 else [])):
            h = mix(h ^ at[shift : shift + n])
        return h
    h, width = mix(values ^ start), 1
    while 2 * width <= k:
        h = mix(h[:-width] * ODD ^ h[width:])
        width *= 2
    return mix(h[:n] * ODD ^ h[k - width : k - width + n]) if width < k else h


def stretches(values: np.ndarray, start: np.ndarray, size: np.ndarray, key: int) -> np.ndarray:
    """Hash of each stretch of bytes or 64-bit tokens, step by step; its size is part of it."""
    wide = values.dtype == np.uint8
    steps = -(-size // 8) if wide else size
    h = mix(size.astype(U64) * ODD ^ U64(key))
    at = _eights(values) if wide else values
    live, step = np.flatnonzero((steps > 0) & (steps <= MOST_STEPS)), 0
    while len(live):
        load = at[start[live] + step * (8 if wide else 1)]
        if wide:
            left = np.minimum(size[live] - 8 * step, 8).astype(U64)
            load = load & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * left))
        h[live] = mix(h[live] ^ load)
        step += 1
        live = live[steps[live] > step]
    for k in np.flatnonzero(steps > MOST_STEPS).tolist():
        raw = values[start[k] : start[k] + size[k]].tobytes()
        h[k] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return h


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, both below it."""
    low = U64((1 << 32) - 1)
    ah, al, bh, bl = a >> U64(32), a & low, b >> U64(32), b & low
    middle, last = ah * bl + al * bh, al * bl
    s = ah * bh * U64(8) + (middle >> U64(29)) + ((middle & U64((1 << 29) - 1)) << U64(32)) + (last >> U64(61)) + (last & PRIME)
    return _reduced(s)


def _reduced(s: np.ndarray) -> np.ndarray:
    s = (s & PRIME) + (s >> U64(61))
    return np.where(s >= PRIME, s - PRIME, s)


class PrefixHash:
    """Polynomial prefix hashes of an array modulo a prime, to a base drawn for the job: whether two stretches are equal in O(1)."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.power = np.ones(n + 1, U64)
        done, factor = 1, base % int(PRIME)
        while done <= n:  # powers double in number, each the ones before times base ** done
            more = min(done, n + 1 - done)
            for i in range(0, more, SLICE):
                part = self.power[i : min(i + SLICE, more)]
                self.power[done + i : done + i + len(part)] = times(part, np.full(len(part), factor, U64))
            done, factor = done * 2, factor * factor % int(PRIME)
        self.sums = np.zeros(n + 1, U64)
        for i in range(0, n, SLICE):  # in slices, as a product takes a dozen arrays of its size
            j = min(n, i + SLICE)
            term = times(_reduced(values[i:j].astype(U64) + U64(1)), self.power[i:j])
            high, low = np.cumsum(term >> U64(32), dtype=U64), np.cumsum(term & U64((1 << 32) - 1), dtype=U64)
            high = _reduced((high >> U64(29)) + ((high & U64((1 << 29) - 1)) << U64(32)))
            self.sums[i + 1 : j + 1] = _reduced(high + _reduced(low) + self.sums[i])

    def same(self, a: np.ndarray, b: np.ndarray, size) -> np.ndarray:
        """Whether the stretches of `size` at a and b have equal hashes."""
        out = np.zeros(len(a), bool)
        size = np.broadcast_to(size, len(a))
        for i in range(0, len(a), SLICE):
            x, y, n = np.minimum(a[i : i + SLICE], b[i : i + SLICE]), np.maximum(a[i : i + SLICE], b[i : i + SLICE]), size[i : i + SLICE]
            of = lambda z, n=n: _reduced(self.sums[z + n] + PRIME - self.sums[z])
            out[i : i + SLICE] = times(of(x), self.power[y - x]) == of(y)
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    if len(x) < width:
        return x[:0]
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches, column: str = "text", most: int = 4 << 20):
    """Record batches cut so that their texts hold about `most` bytes; a longer text stands alone."""
    give_back()  # an earlier task's
    for batch in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for i, j in slices(np.append(0, np.cumsum(size.astype(np.int64))), most):
            yield batch.slice(i, j - i)


def give_back():
    """Returns to the system what this process has freed but keeps: Python workers are reused, and what idle ones keep counts as well."""
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)


def ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of integer ids; null comes last."""
    return np.asarray(column.cast(pa.int64()).fill_null(int(LAST_ID)).to_numpy(zero_copy_only=False), np.int64)


def slices(offsets: np.ndarray, most: int = SLICE):
    """Row ranges of about `most` units; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


class Words:
    """Words of all rows: start, end (bytes), hash; `offsets` are word numbers of the rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, key: int, inside: np.ndarray | None = None, lower: bool = False):
        inside = ~SPACE if inside is None else inside
        starts, ends, hashes, counts = [], [], [], []
        for i, j in slices(offsets):
            a, b = offsets[i], offsets[j]
            part = data[a:b]
            if not len(part):
                counts.append(np.zeros(j - i, np.int64))
                continue
            word = np.zeros(len(part) + 1, bool)
            word[:-1] = inside[part]
            first = word[:-1].copy()
            first[1:] &= ~word[:-2]
            edge = offsets[i:j] - a
            edge = edge[edge < len(part)]
            first[edge] = word[edge]
            last = word[:-1] & ~word[1:]
            stop = offsets[i + 1 : j + 1] - a - 1
            stop = stop[stop >= 0]
            last[stop] = word[stop]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            counts.append(np.diff(np.searchsorted(s, offsets[i : j + 1] - a)))
            starts.append(s + a)
            ends.append(e + a)
            hashes.append(stretches(LOWER[part] if lower else part, s, e - s, key))
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.start, self.end, self.hash = join(starts, np.int64), join(ends, np.int64), join(hashes, U64)
        self.offsets = np.concatenate([[0], np.cumsum(join(counts, np.int64))]).astype(np.int64)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of data laid end to end, and where each begins in that."""
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    where = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    return data[where], at


def joined_words(data: np.ndarray, words: Words, keep: np.ndarray, a: int, b: int) -> bytes:
    """Kept words among numbers a to b, one space between."""
    w = np.flatnonzero(keep[a:b]) + a
    if not len(w):
        return b""
    size = words.end[w] - words.start[w] + 1
    where = np.arange(size.sum()) + np.repeat(words.start[w] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    out = data[np.minimum(where, len(data) - 1)]
    out[np.cumsum(size) - 1] = 0x20
    return out[:-1].tobytes()


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def pack(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def unpack(column: pa.ChunkedArray | pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and how many each row has."""
    parts = [np.frombuffer(x or b"", kind) for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(x) for x in parts], np.int64)


def split_by(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, columns' values) for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    kinds, first = np.unique(bucket[order], return_index=True)
    for b, at in zip(kinds.tolist(), np.split(order, first[1:]), strict=True) if len(kinds) else ():
        yield b, [c[at] for c in columns]
