"""Rows that share an id, have none, collide under a public hash, or whose columns clash."""

import ctypes
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadlens.llm import _arrays as A
from roadlens.llm import decontamination, line_dedup, mixing, ngram_join, toxicity

#: Pairs of lines that are equal under Spark's xxhash64.
PAIRS = [("iK2ZWeqhFWCEPyYn", "pHv9JYIFg3t<M<iA")]


def test_pairs_collide(spark):
    for a, b in PAIRS:
        assert spark.range(1).select(F.xxhash64(F.lit(a)) == F.xxhash64(F.lit(b))).first()[0] and a != b


def test_colliding_lines_stay(spark):
    (a, b), *_ = PAIRS
    docs = spark.createDataFrame([(1, "\n".join([a] * 3)), (2, "\n".join([b] * 3))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in line_dedup.digest(docs).collect()) == [(1, 0), (2, 0)]


def test_rows_without_id_keep_apart(spark):
    (a, b), *_ = PAIRS
    docs = spark.createDataFrame([(None, a, 1), (None, b, 2), (None, None, 3), (None, "", 4)], "doc_id long, text string, n int")
    bench = spark.createDataFrame([("i", a)], "item_id string, text string")
    assert sorted((r["n_words"], r["contaminated"]) for r in decontamination.report(docs, bench).collect()) == [(0, False), (0, False), (1, True), (3, False)]
    assert sorted(r["n"] for r in decontamination.clean(docs, bench).collect()) == [2, 3, 4]
    assert sorted(r["n"] for r in ngram_join.one_of_each(docs).collect()) == [1, 2, 3, 4]


ENDS = [2**63 - 1, -(2**63), 2**62 + 1, -(2**62) - 5, 0, None, None]


@pytest.mark.parametrize("together", [2000, 3])
def test_mix_of_any_ids(spark, together, monkeypatch):
    monkeypatch.setattr(mixing, "TOGETHER", together)
    rows = [(i, f"w{k} x y z"[: 2 + 2 * (k % 4)], "abc"[k % 3]) for k, i in enumerate(ENDS * 4)]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, source string, _copies string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    got = mixing.report(docs).collect()
    want = con.sql(mixing.ORACLE_SQL).fetchall()
    assert len(got) == len(want) == len(rows)
    if together == 2000:
        assert {(r["source_size"], round(r["target"], 9)) for r in got} == {(w[2], round(w[3], 9)) for w in want}
        ids = [r for r in got if r["doc_id"] in ENDS[:1]]
        assert sorted((r["size"], r["taken"]) for r in ids) == sorted((w[1], w[4]) for w in want if w[0] == ENDS[0])
    out = mixing.taken(docs)
    assert out.columns == ["doc_id", "text", "source", "_copies", "_copies_"] and {r["_copies"] for r in out.collect()} == {"kept"}


def test_accepted_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "hello there", "mine"), (None, None, "yours")], "doc_id long, text string, _text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    out = toxicity.accepted(docs, labels)
    assert out.columns == docs.columns and {r["_text"] for r in out.collect()} == {"mine", "yours"}


def test_two_lines_of_fifty_words_are_a_passage(spark):
    a, b, short = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 26), ("b", 26), ("s", 10)))
    rows = [(1, f"x\n{a}\n{b}\ny"), (2, f"{a}\n\n{b}\nz"), (3, f"{a}\nq\n{b}"), (4, f"v\n{a}\n{short}"), (5, f"w\n{a}\n{short}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    got = sorted(tuple(r) for r in line_dedup.digest(docs).collect())
    assert [r[2] for r in got] == [0, 2, 0, 0, 0]
    assert got == sorted(con.sql(line_dedup.ORACLE_SQL).fetchall())


def test_few_labels_that_separate(spark):
    rows = [(i, f"you idiot x{i}", 1) for i in range(40)] + [(100 + i, f"nice day y{i}", 0) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, labels).collect()}
    assert [got[r[0]] for r in rows] == [r[2] for r in rows]


def test_rows_of_one_labelled_id_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ORDINARY_ROWS", 30)
    monkeypatch.setattr(toxicity, "TOXIC_ROWS", 10)
    taken = []
    monkeypatch.setattr(toxicity, "fitted", lambda toxic, ordinary: taken.append((len(toxic), len(ordinary))))
    docs = spark.createDataFrame([((0, 1)[k % 2], f"text {k}") for k in range(2000)], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    assert taken == [(10, 30)]


def test_model_is_trained_in_a_task(spark, monkeypatch):
    rows = [(i, f"you idiot x{i}", 1) for i in range(40)] + [(100 + i, f"nice day y{i}", 0) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    want = toxicity.fit(docs, labels)

    def refused(*_):
        raise MemoryError("the driver trains")

    monkeypatch.setattr(toxicity, "fitted", refused)
    got = toxicity.learned(docs, labels)
    assert (got.ordinary, got.toxic, got.weights.tolist()) == (want.ordinary, want.toxic, want.weights.tolist())
    assert toxicity.accepted(docs, labels).count() == 40 and toxicity.scored(docs, labels).count() == 80


def test_only_texts_go_to_python(spark):
    rows = [(i, f"you idiot x{i}", 1) for i in range(40)] + [(100 + i, f"nice day y{i}", 0) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("age", F.expr("make_interval(0, 1, 0, 2)"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = toxicity.accepted(docs, labels)  # Arrow can't carry such intervals
    assert out.schema == docs.schema and {r["text"] for r in out.select("text", F.col("age").cast("string")).collect()} == {r[1] for r in rows if not r[2]}
    for df in (out, toxicity.scored(docs, labels)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="not glibc")
def test_a_reused_worker_gives_memory_back():
    held = lambda: int(Path("/proc/self/statm").read_text().split()[1]) >> 8
    blocks = [np.ones(12_000) for _ in range(1000)]
    full, last = held(), blocks[-1]
    del blocks
    assert not list(A.pieces([])) and full - held() > 60 and last.sum() == 12_000
