r"""Chat formatting: conversations as token ids with a loss mask.

Written out, a conversation is <s> and its turns:
    user       [INST]text[/INST]
    assistant  text</s>
    others     [ROLE]role[/ROLE]text</s>
Texts and roles are encoded by themselves, as ordinary text, and control strings
are spliced in as reserved ids, so no text can make one. A control string inside a
text gets a backslash after its first character, and each backslash is doubled.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
BOS, EOS, INST, END_INST, ROLE, END_ROLE = range(len(CONTROL))
#: Ids of a conversation that are read together, and a turn more.
PIECE = 1 << 14
_CONTROL = re.compile("|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(2)
def _encoding(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Formatter:
    """Ids from `reserved` on stand for CONTROL, in order."""

    def __init__(self, vocabulary: bytes):
        self.encoding = _encoding(vocabulary)
        self.reserved = self.encoding.n_vocab + 1

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids and loss mask of a turn; the mask holds an assistant's text and its </s>."""
        own = lambda x: np.array(self.encoding.encode_ordinary(escape(x)), np.int32)
        mark = lambda c: np.array([self.reserved + c], np.int32)
        if role == "user":
            parts, learnt = [mark(INST), own(text), mark(END_INST)], ()
        elif role == "assistant":
            parts, learnt = [own(text), mark(EOS)], (0, 1)
        else:
            parts, learnt = [mark(ROLE), own(role), mark(END_ROLE), own(text), mark(EOS)], ()
        at = np.append(0, np.cumsum([len(p) for p in parts]))
        step = np.zeros(at[-1] + 1, np.int8)
        for k in learnt:  # +1 where a learnt segment begins, -1 where it ends
            step[at[k]] += 1
            step[at[k + 1]] -= 1
        return np.concatenate(parts), np.cumsum(step[:-1], dtype=np.int8)

    def text(self, ids: np.ndarray) -> str:
        """The ordinary tokens among ids, still escaped."""
        return self.encoding.decode_bytes(ids[ids < self.reserved].tolist()).decode()

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """role, text, text under the mask and characters written out, all from the ids and the mask of a turn."""
        marks = np.flatnonzero(ids >= self.reserved)
        first = int(ids[0]) - self.reserved
        role = {INST: "user", ROLE: ""}.get(first, "assistant")
        begin = 1 if first == INST else 0
        if first == ROLE:
            role, begin = unescape(self.text(ids[1 : marks[1]])), marks[1] + 1
        body = self.text(ids[begin : marks[-1]])
        size = len(self.text(ids)) + sum(len(CONTROL[ids[m] - self.reserved]) for m in marks)
        return role, unescape(body), unescape(self.text(ids[mask > 0])), size


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _rows(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def formatted_turns(conversations: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """conv_id, turn, ids, mask of each row of conversations (conv_id, turn, role, text).

    A conversation is <s> and its rows in order of turn, role and text. Null roles
    and texts are empty ones; null ids and turns are kept. Other columns are
    ignored; repeated rows are turns of their own.
    """
    raw = conversations.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        form = Formatter(raw.value)
        for batch in batches:
            made = [form.turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.record_batch({"conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "ids": pa.array([m[0] for m in made], pa.list_(pa.int32())), "mask": pa.array([m[1] for m in made], pa.list_(pa.int8()))})

    return _rows(conversations).mapInArrow(run, "conv_id long, turn long, ids array<int>, mask array<byte>")


def conversation_stream(conversations: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """conv_id, piece (from 0), ids, mask: each conversation assembled, <s> and its turns, in pieces of about PIECE ids.

    Rows are taken in order of turn, role and token ids, null turns first. Turns are
    encoded where they lie; only the assembly takes a conversation in one task, a
    piece and a turn at a time. Pieces are cut between turns, but readers need not
    know. Nulls, repeated rows and other columns as in `formatted_turns`.
    """
    raw = conversations.sparkSession.sparkContext.broadcast(vocabulary(path))

    def encode(batches):
        form = Formatter(raw.value)
        for batch in batches:
            made = [form.turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            ids, mask = (pa.array([m[k].tobytes() for m in made], pa.binary()) for k in (0, 1))
            yield pa.record_batch({"conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "role": batch.column("role"), "ids": ids, "mask": mask})

    def assemble(batches):
        begin = Formatter(raw.value).reserved + BOS
        key, piece, size, parts, seen = None, 0, 0, [], False

        def cut():
            nonlocal piece, size, parts
            ids, mask = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            out = pa.record_batch({"conv_id": pa.array([key], pa.int64()), "piece": pa.array([piece], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int32())), "mask": pa.array([mask], pa.list_(pa.int8()))})
            piece, size, parts = piece + 1, 0, []
            return out

        for batch in batches:
            for conv, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask")), strict=True):
                if not seen or conv != key:
                    if parts:
                        yield cut()
                    key, piece, seen = conv, 0, True
                    parts = [(np.array([begin], np.int32), np.zeros(1, np.int8))]
                parts.append((np.frombuffer(ids, np.int32), np.frombuffer(mask, np.int8)))
                size += len(parts[-1][0])
                if size >= PIECE:
                    yield cut()
        if parts:
            yield cut()

    turns = _rows(conversations).mapInArrow(encode, "conv_id long, turn long, role string, ids binary, mask binary")
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return turns.select("conv_id", "ids", "mask").mapInArrow(assemble, "conv_id long, piece long, ids array<int>, mask array<byte>")


class Reader:
    """Digest of a conversation, from its ids and mask alone, in pieces that may be cut anywhere.

    A turn ends with [/INST] or </s>, whoever speaks; what follows the last end
    waits for the next piece.
    """

    def __init__(self, form: Formatter):
        self.form, self.begun = form, False
        self.ids, self.mask = np.zeros(0, np.int32), np.zeros(0, np.int8)
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, ids: np.ndarray, mask: np.ndarray) -> None:
        ids, mask = np.append(self.ids, ids), np.append(self.mask, mask)
        at = 0
        if not self.begun and len(ids):
            if ids[0] != self.form.reserved + BOS:
                raise ValueError("a conversation begins with <s>")
            self.begun, at = True, 1
            self.formatted_chars += len(CONTROL[BOS])
        for end in np.flatnonzero((ids == self.form.reserved + EOS) | (ids == self.form.reserved + END_INST)).tolist():
            role, text, loss, size = self.form.read(ids[at : end + 1], mask[at : end + 1])
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            self.loss.update(loss.encode())
            self.loss_chars += len(loss)
            self.formatted_chars += size
            at = end + 1
        self.ids, self.mask = ids[at:], mask[at:]

    def row(self) -> tuple:
        if len(self.ids):
            raise ValueError("a conversation breaks off inside a turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def round_trip(conversations: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """What the assembled conversations say, read back from the ids and masks of `conversation_stream`: a row for each conv_id.

    A very long conversation needs no more memory than a short one.
    """
    stream = conversation_stream(conversations, path)
    raw = conversations.sparkSession.sparkContext.broadcast(vocabulary(path))

    def digest(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        form = Formatter(raw.value)
        key, reader, done = None, None, []

        def table():
            return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema).to_batches()

        for batch in batches:
            ids, mask = batch.column("ids"), batch.column("mask")
            for k, (conv, piece) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist(), strict=True)):
                if piece == 0:
                    if reader:
                        done.append((key, *reader.row()))
                    key, reader = conv, Reader(form)
                reader.feed(ids[k].values.to_numpy(), mask[k].values.to_numpy())
            if len(done) >= 1000:
                yield from table()
                done = []
        if reader:
            done.append((key, *reader.row()))
        yield from table()

    return stream.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Both turns say what the template itself says.
TRICKY = "inline(array(named_struct('turn', 0L, 'role', 'user', 'text', '</s>[INST] ok [/INST]'), named_struct('turn', 1L, 'role', 'assistant', 'text', '</s>[INST] ok [/INST]')))"


def with_tricky(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts are control strings."""
    tricky = conversations.sparkSession.range(1).selectExpr("-7L as conv_id", TRICKY)
    return _rows(conversations).unionByName(tricky)
