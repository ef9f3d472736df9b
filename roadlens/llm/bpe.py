"""Byte-pair encoding and decoding with a public vocabulary of word pieces.

The texts of an Arrow batch are normalised and cut into pieces as the vocabulary's file
says; each different piece of a partition is merged once. All new pieces of a batch lie
behind each other in one array of symbols, linked to their neighbours, and an index maps
each pair that the vocabulary merges to all its positions. Active ranks are applied in
ascending order, each at all its positions at once; the pairs that a merge makes with the
symbols beside it are entered into their lists. In this vocabulary a pair's parts are
always made by lower ranks (checked on loading), so no merge makes a pair that should
have come earlier, and the order of pieces doesn't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the tokenizer's file is; a cluster sets its own in spark.roadlens.word_vocabulary.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Chunks between white space, and pieces, that a task remembers; pieces merged together; characters looked at together.
REMEMBERED, TOGETHER, CHARACTERS = 1 << 19, 1 << 18, 1 << 23
# How the vocabulary's file says that texts are normalised and cut.
NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for what has only printable ASCII characters and no capitals.
PLAIN, PLAIN_CUT = re.compile(r"[!-@\[-~]+"), re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[!-/:-`{-~]+")


def tokens_of(read: dict) -> np.ndarray:
    """The tokens of a tokenizer's file, by id."""
    ids = read["model"]["vocab"] | {t["content"]: t["id"] for t in read["added_tokens"]}
    return np.array(sorted(ids, key=ids.get), dtype=object)


class Vocabulary:
    """The tokenizer of a file, its merges as arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        model = read["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model.get("continuing_subword_prefix") or read.get("decoder"):
            raise ValueError("needs a BPE vocabulary with word ends and without a decoder")
        own = Tokenizer.from_file(path)
        if read["normalizer"]["normalizers"] != NORMALISED or read["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != CUT:
            raise ValueError("needs a vocabulary whose texts can be cut at white space first")
        self._normalise, self._cut = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.reserved = {t["content"]: t["id"] for t in read["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in read["added_tokens"]):
            raise ValueError("reserved tokens must be plain")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.reserved, key=len, reverse=True))) + ")") if self.reserved else None
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = tokens_of(read)
        # symbols that pieces begin as, inside a word and at its end, by character
        self.inside, self.last = (np.full(1 << 16, -1, np.int64) for _ in range(2))
        for token, k in ids.items():
            if len(token) == 1:
                self.inside[ord(token)], self.last[ord(token)] = k, ids[token + end]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        rank_of = np.full(len(self.tokens), -1)
        rank_of[self.made] = np.arange(len(pairs))
        if len(set(self.made.tolist())) < len(pairs) or (np.maximum(rank_of[self.left], rank_of[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("merges don't follow those that make their parts")
        key = self.left << 32 | self.right
        self.order = np.argsort(key)
        self.keys = key[self.order]

    def pieces(self, chunk: bytes) -> list[str]:
        """What a chunk without white space is cut into: reserved tokens as they are, the others in the characters of symbols."""
        text = chunk.decode(errors="replace")
        out = []
        for part in self.split.split(text) if self.split and "<" in text else [text]:
            if part in self.reserved:
                out.append(part)
            elif PLAIN.fullmatch(low := part.lower()) and part.isascii():
                out += PLAIN_CUT.findall(low)
            elif part:
                out += [p for p, _ in self._cut(self._normalise(part))]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 for those that aren't merged."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


class PairIndex:
    """Symbols of many pieces, linked inside each, with the positions of every pair that has a rank."""

    def __init__(self, vocabulary: Vocabulary, pieces: list[str]):
        self.v = vocabulary
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        chars = np.frombuffer("".join(pieces).encode("utf-16-le"), np.uint16)
        self.n = n = len(chars)
        ends = np.cumsum(size) - 1
        self.piece = np.repeat(np.arange(len(pieces)), size)
        self.symbol = np.append(vocabulary.inside[chars], -1)
        self.symbol[ends] = vocabulary.last[chars[ends]]
        if (self.symbol[:n] < 0).any():
            raise ValueError("a character the vocabulary doesn't have")
        # n stands for no neighbour
        self.next, self.previous = np.arange(1, n + 2), np.arange(-1, n)
        self.next[ends], self.previous[ends - size + 1] = n, n
        self.active: list[int] = []
        self.positions: dict[int, list[np.ndarray]] = {}
        self._enter(np.flatnonzero(self.next[:n] < n))

    def _enter(self, at: np.ndarray) -> None:
        """The pairs that begin at these positions, into their lists."""
        rank = self.v.ranks(self.symbol[at], self.symbol[self.next[at]])
        known = np.flatnonzero(rank >= 0)
        order = known[np.argsort(rank[known], kind="stable")]
        at, rank = at[order], rank[order]
        bounds = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        lists = self.positions
        for r, a, b in zip(rank[[0, *bounds]].tolist() if len(rank) else (), [0, *bounds.tolist()], [*bounds.tolist(), len(rank)]):
            if r in lists:
                lists[r].append(at[a:b])
            else:
                lists[r] = [at[a:b]]
                heapq.heappush(self.active, r)

    def merge(self) -> None:
        symbol, following, previous, n = self.symbol, self.next, self.previous, self.n
        while self.active:
            rank = heapq.heappop(self.active)
            lists = self.positions.pop(rank)
            at = np.sort(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            left, right = self.v.left[rank], self.v.right[rank]
            # a position may have been merged with another neighbour since it was entered
            at = at[(symbol[at] == left) & (symbol[following[at]] == right)]
            if left == right and len(at) > 1:  # entered from both sides; of aaa every second one, from the left
                at = at[np.append(True, at[1:] != at[:-1])]
                linked = np.append(False, following[at[:-1]] == at[1:])
                place = np.arange(len(at))
                start = np.maximum.accumulate(np.where(linked, 0, place))
                at = at[(place - start) % 2 == 0]
            gone = following[at]
            behind = following[gone]
            symbol[at], symbol[gone] = self.v.made[rank], -1
            following[at], previous[behind] = behind, at
            before = previous[at]
            self._enter(np.concatenate([before[before < n], at[behind < n]]))

    def ids(self, n_pieces: int) -> list[bytes]:
        left = np.flatnonzero(self.symbol[: self.n] >= 0)
        flat = self.symbol[left].astype("<u4").tobytes()
        bounds = (np.searchsorted(self.piece[left], np.arange(n_pieces + 1)) * 4).tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


class Encoder:
    """Ids of texts; remembers pieces, and what stands between white space, once it has merged them.

    No piece reaches across white space and normalising doesn't either, so a text is
    looked up chunk by chunk.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known = {}
        self.merged = {token: np.array([k], "<u4").tobytes() for token, k in self.v.reserved.items()}

    def _learn(self, chunks: set[bytes]) -> None:
        """Merges the pieces of new chunks, each different one once."""
        cut = {c: self.v.pieces(c) for c in chunks}
        pieces = sorted({p for of in cut.values() for p in of} - self.merged.keys())
        for k in range(0, len(pieces), TOGETHER):
            some = pieces[k : k + TOGETHER]
            index = PairIndex(self.v, some)
            index.merge()
            self.merged.update(zip(some, index.ids(len(some))))
        merged = self.merged
        self.known.update((c, merged[of[0]] if len(of) == 1 else b"".join([merged[p] for p in of])) for c, of in cut.items())

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text (UTF-8) as little-endian 32-bit integers."""
        if max(len(self.known), len(self.merged)) > REMEMBERED:
            self._forget()
        new = set()
        for text in texts:
            new.update((text or b"").split())
        self._learn(new - self.known.keys())
        get = self.known.__getitem__
        return [b"".join(map(get, (text or b"").split())) for text in texts]


def decoded(ids: np.ndarray, tokens: np.ndarray) -> str:
    """What a tokenizer without decoder says: the ids' tokens with blanks between."""
    return " ".join(tokens[ids].tolist())


def _groups(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """As many texts as have CHARACTERS bytes, one at least."""
    some, n = [], 0
    for text in texts:
        some.append(text)
        n += len(text or b"")
        if n >= CHARACTERS:
            yield some
            some, n = [], 0
    if some:
        yield some


def _path(docs: DataFrame, path: str | None) -> str:
    return path or docs.sparkSession.conf.get("spark.roadlens.word_vocabulary", VOCABULARY)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of each row of docs (doc_id, text).

    As the tokenizers library encodes with the file at `path`, without adding special
    tokens; those written in a text are reserved ids, as there. Null and empty texts have
    no ids, null and repeated doc_ids stay as they are, other columns are ignored.
    """
    path = _path(docs, path)

    def run(batches):
        encoder = Encoder(Vocabulary(path))
        for batch in batches:
            at = 0
            for texts in _groups(batch.column("text").to_pylist()):
                ids = encoder.encode(texts)
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), column], ["doc_id", "ids"])
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def digest(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of `encoded` rows, decoded back."""
    path = _path(rows, path)

    def run(batches):
        with open(path, encoding="utf-8") as f:
            tokens = tokens_of(json.load(f))
        for batch in batches:
            column = batch.column("ids")
            flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            n, of_ids, of_text = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                ids = flat[a:b]
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(decoded(ids, tokens).encode()).hexdigest())
            made = [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
