"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes are dealt out by a prefix of variable length: the seed k-gram of
`_repeats`, and for a seed with too many suffixes the whole window. Each group
builds its subtree from the root down, a word at a time; branches with one
suffix left are leaves and are dropped. Nodes that still branch `length` words
deep are the repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _arrays as A
from ._repeats import Chunk, Spec, Windows, cover

LENGTH, SEED = 20, 8
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def deep_nodes(tokens: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes below an internal node of depth `length`: their numbers, and the node of each."""
    left, node = np.arange(len(start)), np.zeros(len(start), np.int64)
    for depth in range(length):
        word = tokens[start[left] + depth]
        order = np.lexsort((word, node))
        left, node, word = left[order], node[order], word[order]
        new = np.ones(len(left), bool)
        new[1:] = (node[1:] != node[:-1]) | (word[1:] != word[:-1])
        child = np.cumsum(new) - 1
        branch = np.bincount(child)[child] > 1 if len(child) else new
        left, node = left[branch], child[branch]
        if not len(left):
            break
    return left, node


def later_windows(w: Windows, spec: Spec) -> np.ndarray:
    """Windows whose words also start earlier."""
    hit = np.zeros(len(w.start), bool)
    left, node = deep_nodes(w.tokens, w.start, spec.length)
    order = np.lexsort((w.place[left], w.doc[left], node))
    left, node = left[order], node[order]
    later = np.zeros(len(left), bool)
    later[1:] = node[1:] == node[:-1]
    hit[left[later]] = True
    return hit


def _digest(c: Chunk, covered: np.ndarray) -> pa.Table:
    total, keep = np.append(0, np.cumsum(covered)), ~covered
    a, b = c.at[:-1], c.at[1:]
    kept = [A.sha256(A.joined_words(c.data, c.words, keep, i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    return pa.table({"doc_id": pa.array(c.ids, mask=c.null), "n_words": b - a, "n_removed": total[b] - total[a], "kept_sha256": pa.array(kept, pa.string())})


def _texts(c: Chunk, covered: np.ndarray) -> pa.Table:
    total, keep = np.append(0, np.cumsum(covered)), ~covered
    a, b = c.at[:-1], c.at[1:]
    kept = [A.joined_words(c.data, c.words, keep, i, j).decode() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    return pa.table({"doc_id": pa.array(c.ids, mask=c.null), "text": pa.array(kept, pa.string()), "n_removed": total[b] - total[a]})


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text (kept words, one space between), n_removed of docs (doc_id, text).

    A word goes if a window of `length` words over it also starts earlier: in a
    document with a smaller doc_id, or before it in the same one. Null or empty
    text has no words. Rows that share a doc_id are taken in order of a
    hash of their text; a null doc_id comes after all others. Other columns are ignored; an
    empty table gives none.
    """
    return cover(docs, Spec(True, length, min(SEED, length), True, A.job_key()), later_windows, _texts, "doc_id long, text string, n_removed long")


def removal_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Counts and a digest of `deduplicated`, without carrying texts."""
    return cover(docs, Spec(True, length, min(SEED, length), True, A.job_key()), later_windows, _digest, SCHEMA)
