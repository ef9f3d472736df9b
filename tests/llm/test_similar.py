"""Decontamination, the n-gram join, components and embeddings against brute force."""

import random

import brute
import numpy as np
import pytest

from roadlens.llm import components, decontamination, embedding_dedup, ngram_join


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def items(corpus):
    texts = [t for _, t in corpus if t and len(t.split()) > 30][:6]
    return [(k, " ".join(t.split()[5:25]).upper()) for k, t in enumerate(texts)] + [(10, "ccc a"), (11, None), (12, ""), (13, "nowhere to be found"), (14, "ccc a"), (None, "bb bb a")]


def test_leaks(spark, documents, corpus, items):
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, hash string")
    got = rows(decontamination.report(documents, bench))
    assert got == sorted(brute.leaks(corpus, items), key=str) and any(r[-1] for r in got)
    clean = {r["doc_id"] for r in decontamination.clean(documents, bench).collect()}
    assert clean == {r[0] for r in got if not r[-1]}


def test_no_benchmark(spark, documents, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontamination.report(documents, bench).collect())
    assert decontamination.report(empty, bench).count() == 0


def test_repeated_rows_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert rows(decontamination.report(docs, bench).select("doc_id", "n_words", "n_hit")) == [(1, 3, 1), (1, 3, 1), (None, 0, 0)]


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (1, 50)])
def test_groups(documents, corpus, k, percent):
    assert rows(ngram_join.groups(documents, k, percent)) == sorted(brute.jaccard_groups(corpus, k, percent), key=str)


def test_one_of_each(documents, corpus):
    kept = sorted(r["doc_id"] for r in ngram_join.one_of_each(documents).collect())
    assert kept == sorted(d for d, _, root in brute.jaccard_groups(corpus, 5, 80) if d == root)
    assert set(ngram_join.one_of_each(documents).columns) == set(documents.columns)


def test_odd_ids(spark, empty):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "A B C D"), (3, "A B C D"), (4, None)], "doc_id long, text string")
    assert rows(ngram_join.groups(docs)) == [(3, 1, 3), (3, 1, 3), (4, 0, 4), (None, 1, 3), (None, 1, 3)]
    assert rows(ngram_join.groups(empty)) == []


def test_clean_by_row(spark):
    docs = spark.createDataFrame([(None, "a b c", 1), (None, "d e", 2), (1, "a b c", 3), (1, "d e", 4), (1, "d e", 5)], "doc_id long, text string, hash long")
    bench = spark.createDataFrame([(1, "b")], "item_id long, text string")
    out = decontamination.clean(docs, bench)
    assert sorted(r["hash"] for r in out.collect()) == [2, 4, 5] and out.columns == docs.columns


def test_one_of_each_by_row(spark):
    base = [f"w{i}" for i in range(60)]
    near, other, third = " ".join(base), " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(60))
    docs = [(None, near), (None, other), (7, near), (7, third), (7, third), (None, "alone"), (None, "alone"), (None, None), (8, ""), (8, "")]
    out = ngram_join.one_of_each(spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, key string"))
    assert rows(out.select("doc_id", "text")) == sorted([(7, near), (7, third), (None, "alone"), (None, None), (8, ""), (8, "")], key=str)
    assert out.columns == ["doc_id", "text", "key"]


def test_pairs_are_divided(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_PAIRS", 1000)
    pairs = spark.range(300).toDF("a").crossJoin(spark.range(300).toDF("b")).filter("a < b or b = 299").selectExpr("a", "b", "5L as n").unionAll(spark.range(5000).selectExpr("id", "77L", "3L"))
    dealt = ngram_join._dealt(pairs)
    assert dealt.select("a", "b", "n").exceptAll(pairs).isEmpty() and dealt.count() == pairs.count()
    assert max(r["count"] for r in dealt.groupBy("p").count().collect()) <= 5000


@pytest.mark.parametrize("k, percent, levels", [(3, 90, 3), (5, 80, 1), (1, 50, 0)])
def test_groups_by_pivots(spark, monkeypatch, k, percent, levels):
    """Variants of few texts at all distances, so that long lists get pivots again and again."""
    monkeypatch.setattr(ngram_join, "SHORT", 2)
    monkeypatch.setattr(ngram_join, "LEVELS", levels)
    monkeypatch.setattr(ngram_join, "BLOCK_PAIRS", 50)
    rng = random.Random(k * percent)
    bases = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(3)]
    docs = []
    for i in range(150):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [rng.choice(["x", "y", f"n{i}"])] * rng.randrange(1, 3)
        docs.append((i, " ".join(words[rng.randrange(4) :])))
    got = rows(ngram_join.groups(spark.createDataFrame(docs, "doc_id long, text string"), k, percent))
    assert got == sorted(brute.jaccard_groups(docs, k, percent), key=str) and len({r[2] for r in got}) < 150


def test_pairs_of_variants_are_not_all_looked_at(spark, monkeypatch):
    """Variants of one text that lack passages, few of them similar: each difference is in many, still not all pairs are verified."""
    looked, verified = [], ngram_join._verified

    def counted(shingles, pairs, classes):
        looked.append(pairs.filter("not pivot").count())
        return verified(shingles, pairs, classes)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(160):
        words = list(base)
        for _ in range(5):
            at = rng.randrange(len(words) - 20)
            del words[at : at + rng.randrange(8, 20)]
        docs.append((i, " ".join(words)))
    got = rows(ngram_join.groups(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80))
    assert got == sorted(brute.jaccard_groups(docs, 5, 80), key=str) and len({r[2] for r in got}) > 100
    assert sum(looked) < 0.85 * len(docs) * (len(docs) - 1) / 2


def test_names_that_collide(spark, documents, corpus, monkeypatch):
    """Sets that share the 64 bits of their name are told apart by the check."""
    names = ngram_join.names
    monkeypatch.setattr(ngram_join, "names", lambda h, n, salt: names(h, n, salt) % 5 if salt == ngram_join.NAME else names(h, n, salt))
    few = documents.filter("doc_id < 12")
    assert rows(ngram_join.features(ngram_join.Shingles(few, 3, 90)).select("n")) == rows(ngram_join.groups(few, 3, 90).select("n_shingles"))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(12)]
    want = brute.roots({n for e in links for n in e}, links)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        centre = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((len(rows), [float(v) for v in centre + rng.normal(size=24) * rng.choice([0.0, 0.03, 0.2])], int(k % 3)))
    rows += [(900, rows[0][1], None), (901, None, 1), (902, [0.0] * 24, 1), (903, [float("nan")] * 24, 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (None, rows[0][1], 0)]
    # squares of these are infinite or 0
    rows += [(910, [1e200] * 8, 1), (911, [2e200] * 8, 1), (912, [1e-200] * 8, 1), (913, [1e300] + [1e-300] * 7, 1), (None, [float("inf")] * 8, 1), (914, rows[0][1], 0), (914, rows[0][1], 0)]
    return rows


def brute_links(vectors, limit=0.98):
    use = [i for i, (_, v, lab) in enumerate(vectors) if lab is not None and v and all(np.isfinite(v)) and any(v)]
    links = []
    for x, i in enumerate(use):
        for j in use[x + 1 :]:
            a, b = (np.array(vectors[k][1]) / np.abs(vectors[k][1]).max() for k in (i, j))
            if vectors[i][2] == vectors[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= limit:
                links.append((i, j))
    return links


@pytest.mark.parametrize("block", [None, 4])
def test_embeddings(spark, vectors, monkeypatch, block):
    if block:
        monkeypatch.setattr(embedding_dedup, "TASK", 2 * block)
    links = brute_links(vectors)
    up = brute.roots(range(len(vectors)), links)
    least = {}
    for i, r in up.items():
        if vectors[i][0] is not None:
            least[r] = min(least.get(r, 10**9), vectors[i][0])
    n = [sum(i in e for e in links) for i in range(len(vectors))]
    want = sorted([(vectors[i][0], n[i], least.get(up[i]), vectors[i][0] == least.get(up[i])) for i in range(len(vectors))], key=str)
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, label int, bucket string")
    got = rows(embedding_dedup.linked(df))
    # a vector without id is kept only if none with one is linked
    assert got == [(i, k, c, kept if i is not None else c is None) for i, k, c, kept in want]


def test_recall():
    """Vectors of cosine 0.98, the least similar that link, share a bucket."""
    rng = np.random.default_rng(2)
    for width in (24, 64, 768):
        x = rng.normal(size=(400, width))
        y = rng.normal(size=x.shape)
        x /= np.linalg.norm(x, axis=1)[:, None]
        y -= (x * y).sum(1)[:, None] * x
        y /= np.linalg.norm(y, axis=1)[:, None]
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * y
        label = np.zeros(len(x), np.uint64)
        a, b = embedding_dedup.buckets(x, label), embedding_dedup.buckets(y, label)
        assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() >= 0.99


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.linked(df).count() == 0


def test_words_built_to_collide(spark):
    """Words that collide under any polynomial hash modulo a power of two."""
    one = "a"
    while len(one) < 2048:
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = [(1, f"x {one} y z v"), (2, f"x {other} y z v"), (3, one), (4, other)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(ngram_join.groups(df)) == sorted(brute.jaccard_groups(docs, 5, 80), key=str)
    items = [(1, one), (2, f"y z {other}")]
    assert rows(decontamination.report(df, spark.createDataFrame(items, "item_id long, text string"))) == sorted(brute.leaks(docs, items), key=str)


@pytest.mark.parametrize("window", [1, 3, 5, 10])
def test_leaks_of_few_words(spark, window):
    """Texts of two words, so that windows repeat, overlap and end at every place."""
    rng = random.Random(window)
    text = lambda n: " ".join(rng.choice(["a", "b"] if window > 3 else ["a", "b", "c", "d"]) for _ in range(n))
    docs, items = [(i, text(rng.randrange(40))) for i in range(60)], [(i, text(rng.randrange(14))) for i in range(12)]
    got = rows(decontamination.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window))
    assert got == sorted(brute.leaks(docs, items, window), key=str)


def test_pairs_of_a_group_stay_together(spark, monkeypatch):
    """A set of a group whose members all meet each other is sent once, not once for each b."""
    monkeypatch.setattr(ngram_join, "BLOCK_PAIRS", 50)
    pairs = spark.createDataFrame([(100 * g + i, 100 * g + j, 5, 100 * g) for g in range(40) for i in range(8) for j in range(i + 1, 8)], "a long, b long, n long, head long")
    large = spark.range(1, 400).selectExpr("9000 as a", "9000 + id as b", "5L as n", "9000L as head")
    dealt = ngram_join._dealt(pairs.union(large), "head").cache()
    assert dealt.select(pairs.columns).exceptAll(pairs.union(large)).isEmpty() and dealt.count() == 40 * 28 + 399
    sent = dealt.filter("head < 9000").selectExpr("p", "explode(array(a, b)) as c").distinct().count()
    assert sent == 40 * 8 and dealt.filter("head = 9000").select("p").distinct().count() > 4
