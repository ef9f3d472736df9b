"""Suffix sort and suffix trees against brute force."""

import brute
import numpy as np
import pyarrow as pa
import pytest

from roadlens.llm import _repeats, suffix_array, suffix_tree


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bytes(documents, corpus):
    assert rows(suffix_array.removal_digest(documents)) == sorted(brute.byte_repeats(corpus, 50), key=str)


def test_words(documents, corpus):
    assert rows(suffix_tree.removal_digest(documents)) == sorted(brute.word_repeats(corpus, 20), key=str)


def test_seeds_with_many_runs_are_split(documents, corpus, monkeypatch):
    monkeypatch.setattr(_repeats, "WIDE", 1)
    assert rows(suffix_array.removal_digest(documents)) == sorted(brute.byte_repeats(corpus, 50), key=str)
    assert rows(suffix_tree.removal_digest(documents)) == sorted(brute.word_repeats(corpus, 20), key=str)


def test_null_id_comes_last(spark):
    text = "the quick brown fox jumps over the lazy dog and then it goes on and on until the end of this line of words"
    docs = [(None, text), (5, text)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(suffix_array.removal_digest(df)) == sorted(brute.byte_repeats(docs, 50), key=str)
    assert rows(suffix_tree.removal_digest(df)) == sorted(brute.word_repeats(docs, 20), key=str)


def test_texts_and_spans(documents, corpus):
    kept = {r["doc_id"]: r for r in suffix_array.removed_spans(documents).collect()}
    for doc_id, n, removed, spans, digest in brute.byte_repeats(corpus, 50):
        assert brute.sha(bytes(kept[doc_id]["kept"])) == digest and len(kept[doc_id]["spans"]) == spans
        assert sum(s["end"] - s["start"] for s in kept[doc_id]["spans"]) == removed
    texts = {r["doc_id"]: r["text"] for r in suffix_tree.deduplicated(documents).collect()}
    assert all(brute.sha(texts[d]) == digest for d, _, _, digest in brute.word_repeats(corpus, 20))


def test_empty_table(empty):
    assert suffix_array.removal_digest(empty).count() == suffix_tree.removal_digest(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 64, 200])
def test_suffix_sort(n):
    text = np.random.default_rng(n).integers(97, 99, n + 12).astype(np.uint8)
    at = suffix_array.SuffixOrder(text, 12, 12345).sort(np.arange(n))
    whole = [text[a : a + 12].tobytes() for a in at]
    assert whole == sorted(whole) and sorted(at.tolist()) == list(range(n))


def test_long_rows_in_pieces(spark, monkeypatch):
    from roadlens.llm import _arrays

    monkeypatch.setattr(_arrays, "SLICE", 256)
    rng = np.random.default_rng(3)
    text = " ".join(f"w{i}" for i in rng.integers(0, 50, 400))
    docs = [(1, text), (2, text[500:]), (3, text[:700] + "x" + text[700:])]
    from roadlens.llm._repeats import Chunk, Spec

    import pyarrow as pa

    c = Chunk(pa.table({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs], "tie": [1, 2, 3]}), Spec(False, 50, 18, False, 1))
    assert c.count.sum() == sum(len(t) - 49 for _, t in docs)


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_built_to_collide(spark):
    """Words that collide under any polynomial hash modulo a power of two, and whole windows of them."""
    one, other = thue_morse(2048)
    rng = np.random.default_rng(1)
    text = [f"w{i}" for i in rng.integers(0, 500, 40)]
    docs = [(1, " ".join([*text[:10], one, *text[10:30]])), (2, " ".join([*text[:10], other, *text[10:30]])), (3, " ".join([*text[:10], one, *text[10:]]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(suffix_tree.removal_digest(df)) == sorted(brute.word_repeats(docs, 20), key=str)
    assert rows(suffix_array.removal_digest(df)) == sorted(brute.byte_repeats(docs, 50), key=str)


def test_hashes_that_collide(documents, corpus, monkeypatch):
    """Runs of different text under one hash are told apart by their text."""
    from roadlens.llm import _arrays

    whole = _arrays.stretches
    tokens = np.uint64
    monkeypatch.setattr(_repeats.A, "stretches", lambda v, s, n, k: whole(v, s, n, k) % tokens(3) if v.dtype == np.uint8 and len(s) and n.min() >= 50 else whole(v, s, n, k))
    text = np.frombuffer(b"".join(t.encode() for _, t in corpus if t), np.uint8)
    start = np.arange(0, len(text) - 80, 7)
    first, kind = _repeats.kinds(text, start, np.full(len(start), 60), 5)
    said = [text[s : s + 60].tobytes() for s in start]
    assert all(said[i] == said[first[k]] for i, k in enumerate(kind))


def test_long_texts(spark):
    rng = np.random.default_rng(4)
    text = " ".join(f"w{i}" for i in rng.integers(0, 3000, 60_000))
    docs = [(1, text), (2, "other start " + text[1000:200_000]), (3, "a " * 5000), (4, "a " * 6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(suffix_array.removal_digest(df)) == sorted(brute.byte_repeats(docs, 50), key=str)
    assert rows(suffix_tree.removal_digest(df)) == sorted(brute.word_repeats(docs, 20), key=str)


def test_rows_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(1, text), (1, text[20:] + " x"), (None, text), (None, text + " y"), (2, text)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(suffix_array.removal_digest(df)) == sorted(brute.byte_repeats(docs, 50), key=str)
    out = suffix_tree.removal_digest(df).collect()
    # whichever of the two rows of id 1 comes first keeps the 40 words that both have
    assert len(out) == 5 and sum(r["n_words"] - r["n_removed"] for r in out) == 62 and [r["n_removed"] for r in out if r["doc_id"] == 2] == [60]


@pytest.mark.parametrize("module, spec", [(suffix_array, _repeats.Spec(False, 50, 18, False, 5)), (suffix_tree, _repeats.Spec(True, 20, 6, True, 5))])
def test_runs_are_compared_some_seeds_at_a_time(monkeypatch, module, spec):
    from roadlens.llm import _arrays

    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(60)]
    docs = [(i, f"{i} {base[i % 60]} {i}" if i < 60 else f"{base[i % 60][:200]} {i} {base[i % 60][200:]}") for i in range(180)]
    seen = []

    def later(w, spec):
        seen.append(len(w.tokens))
        return module.later_windows(w, spec)

    def found():
        chunks = [pa.table({"doc_id": [d for d, _ in part], "text": [t for _, t in part], "tie": pa.array([d for d, _ in part], pa.int64()), "chunk": pa.array([k] * len(part), pa.int32())}) for k, part in enumerate((docs[::2], docs[1::2]))]
        seeds = pa.concat_tables([_repeats._send_seeds(spec, 1)(c) for c in chunks])
        answers = _repeats._answer(seeds)
        own = lambda t, k: t.filter(pa.compute.equal(t["chunk"], k))
        runs = pa.concat_tables([_repeats._send_contexts(spec, 1)(c, own(answers, k)) for k, c in enumerate(chunks)])
        told = _repeats._resolve(spec, later)(runs)
        return [_repeats.Chunk(c, spec).covered(own(told, k)).tolist() for k, c in enumerate(chunks)]

    want, whole = found(), max(seen)
    assert any(map(any, want))
    seen.clear()
    monkeypatch.setattr(_arrays.slices, "__defaults__", (500,))
    assert found() == want and len(seen) > 3 and max(seen) < whole / 3


def test_texts_of_runs_are_sent_compressed():
    text = ("some words that any page has, " * 40).encode()
    docs = pa.table({"doc_id": [1, 2], "text": [text.decode(), "x" + text.decode()], "tie": [1, 2], "chunk": pa.array([0, 0], pa.int32())})
    spec = _repeats.Spec(False, 50, 18, False, 5)
    answers = _repeats._answer(_repeats._send_seeds(spec, 1)(docs))
    sent = _repeats._send_contexts(spec, 1)(docs, answers)
    size = np.frombuffer(b"".join(sent["bytes"].to_pylist()), np.uint32).sum()
    assert 0 < sum(map(len, sent["text"].to_pylist())) < size and set(sent["start"].to_pylist()) == {b""}
