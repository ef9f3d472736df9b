"""Resampling, byte pairs and the filter audit against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.llm import bpe, filter_audit, importance

# --- 11: importance resampling

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = ITEM.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def resampled(docs, target, percent=25):
    own = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    rows = []
    for (doc_id, _), (n_words, f) in zip(docs, own):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = fit[: percent * len(fit) // 100]
    ranks = {id(r): k + 1 for k, r in enumerate(drawn)}
    return sorted(([r[0], r[2], r[3], r[4], ranks.get(id(r))] for r in rows), key=repr)


@pytest.mark.parametrize("few", [1, 10_000])
def test_resample(spark, documents, corpus, few, monkeypatch):
    monkeypatch.setattr(importance.cutoff, "__defaults__", (few,))
    target = ["W1 w2 w3 w4", "a bb ccc", None, "", "ä-ä w1 w2"]
    got = importance.ranked(documents.repartition(5), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted((list(r) for r in got.collect()), key=repr) == resampled(corpus, target)


def test_resample_odd_rows(spark, documents, empty):
    target = spark.createDataFrame([("a b c",)], "text string")
    assert importance.ranked(empty, target).count() == 0 and importance.drawn(empty, target).count() == 0
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(None, text)] * 5 + [(7, text)] * 6 + [(8, "x " * 19)] + [(-9, None)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, score int, id int")
    got = importance.ranked(docs, target).collect()
    assert len(got) == 13 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2]  # 25% of 11
    assert len({r["doc_id"] for r in got if r["rank"]}) == 1  # repeated rows share all but the rank
    out = importance.drawn(docs, target)
    assert out.columns == docs.columns and out.count() in (5, 6) and out.select("score", "id").distinct().collect() == [(1, 2)]
    many = importance.drawn(documents, target, percent=50)
    best = {r["doc_id"] for r in importance.ranked(documents, target, percent=50).filter("rank is not null").collect()}
    assert many.columns == documents.columns and {r["doc_id"] for r in many.collect()} == best


def test_cutoff_is_exact(spark):
    rng = random.Random(1)
    for n, spread in ((1, 1), (500, 3), (700, 10**6)):
        rows = [(rng.randrange(spread), rng.randrange(50)) for _ in range(n)]
        keys = spark.createDataFrame(rows, "score long, id long").repartition(6)
        ordered = sorted(rows, key=lambda r: (-r[0], r[1]))
        for k in {1, n, (n + 1) // 2, max(1, n // 3)}:
            assert importance.cutoff(keys, k, few=1) == ordered[k - 1]


def test_runs_of_long_texts(monkeypatch):
    rng = random.Random(2)
    text = " ".join("z" * rng.choice([1, 2, 47, 48, 49, 200]) + str(rng.randrange(30)) for _ in range(500)) + "\néTİ end"
    monkeypatch.setattr(importance, "TOGETHER", 50)
    monkeypatch.setattr(importance, "SLICE", 300)
    found = [list(zip(*(x.tolist() for x in part))) for part in importance.runs([b"", text.encode(), None, text.encode()])]
    for k in (1, 3):
        got = Counter(bucket for part in found for row, bucket, _ in part if row == k)
        assert got == Counter(features(text)[1])


# --- 12: byte pairs


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.VOCABULARY)


def fuzz():
    rng = random.Random(3)
    parts = list("aaabbcdefthing ing  \n\t\r\x0b\x0c'sllve0123456789.,!?#İΣςßé̈ñ漢字\U0001f600\u0085  　\x1c\x00\x7f")
    parts += ["<|startoftext|>", "<|endoftext|>", " <|endoftext|>", "<|ENDOFTEXT|>", "'re", "'LL", "aaaa", "hahaha", "!!!!!!", "The", "ͅ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(3000)]


def test_bpe_encodes_as_the_library(tokenizer, corpus):
    texts = [*fuzz(), *(t or "" for _, t in corpus), "a" * 5000, "ab" * 3000 + " " + "é" * 999]
    got = bpe.Encoder(bpe.Vocabulary(bpe.VOCABULARY)).encode([t.encode() for t in texts])
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def test_bpe_forgets_and_groups(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "TOGETHER", 7)
    encoder, texts = bpe.Encoder(bpe.Vocabulary(bpe.VOCABULARY)), fuzz()[:300]
    for k in range(0, 300, 30):
        got = encoder.encode([t.encode() for t in texts[k : k + 30]])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[k : k + 30]]


def test_bpe_query(spark, documents, corpus, empty, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "CHARACTERS", 2000)
    extra = spark.createDataFrame([(None, t, "x") for t in fuzz()[:50]] + [(1, "again", "x")] * 2, "doc_id long, text string, ids string")
    both = documents.select("doc_id", "text", F.lit("y").alias("ids")).union(extra)
    got = sorted((tuple(r) for r in bpe.digest(bpe.encoded(both)).collect()), key=repr)
    want = []
    for doc_id, text in [*corpus, *((None, t) for t in fuzz()[:50]), (1, "again"), (1, "again")]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digest(bpe.encoded(empty)).count() == 0


# --- 13: filter audit

PARTS = ["en", "de", None, ""]


def audit_rows(corpus):
    rng = random.Random(5)
    texts = [t for _, t in corpus] + ["A B C $ " + "x " * 30, "x $", "ä İ " * 120, " ".join(map(str, range(250))), " ".join(map(str, range(250))) + " #", "QWERTZ " * 300]
    docs = [(i, t, rng.choice(PARTS)) for i, t in enumerate(texts)] + [(1000 + i, rng.choice(texts), rng.choice(PARTS)) for i in range(150)]
    docs += [(None, t, "en") for t in texts[:5]] + [(3, texts[3], "en")] * 2 + [(2000 + i, "hot copy", "de") for i in range(300)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 2400, 2)] + [(4, 1, 1), (None, 1, 1)]
    return docs, labels


def audited(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    judged = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(c for c, f in zip("ABCDE", [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i]) if f)
        judged.append((lang or "", fails, i in good, i in toxic))
    rows = []
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                shapley[f] += len(gone)
                rows.append([part, "".join(order), step + 1, f, len(left), len(gone), sum(f in j[1] for j in own) - len(gone), sum(j[1] == f for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone)])
        for r in rows:
            if r[0] == part:
                r.append(shapley[r[3]])
    return sorted(map(tuple, rows))


def test_audit(spark, corpus, documents, empty):
    docs, labels = audit_rows(corpus)
    names = "part filter_order step filter kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    frame = spark.createDataFrame([(*d, 1, "x", 2, 3) for d in docs], "doc_id long, text string, lang string, n int, digest string, salt int, good int").repartition(7)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame, known)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == audited(docs, labels)
    con = duckdb.connect()
    import pyarrow as pa

    con.register("documents", pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": [d[1] for d in docs], "lang": [d[2] for d in docs]}))
    con.register("labels", pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": [x[1] for x in labels], "toxic": [x[2] for x in labels]}))
    assert sorted(con.sql(f"SELECT {', '.join(names)} FROM ({filter_audit.ORACLE_SQL})").fetchall()) == audited(docs, labels)
    assert filter_audit.audit(empty, known).count() == 0
    assert filter_audit.audit(frame, known.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_repeated_rows_are_not_broadcast(spark, documents):
    """Rows that are repeated for every salt stay out of the driver, however few they were before."""
    known = documents.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    rows = filter_audit.judged(documents, known)
    rows.collect()
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()


def test_positional_popcounts():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 7, 1000):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint64)
        assert filter_audit.popcounts(words).tolist() == [int((words >> np.uint64(k) & np.uint64(1)).sum()) for k in range(32)]
