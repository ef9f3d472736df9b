import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Random texts that share passages, copies, near copies, and odd cases."""
    rng = random.Random(7)
    few, many = ["a", "bb", "ccc", "ä", "Of", "x1"], [f"w{i}" for i in range(400)]
    shared = words(rng, 60, many)
    base = words(rng, 120, many)
    rows = [(i, words(rng, rng.randint(0, 90), few if i % 2 else many)) for i in range(60)]
    rows += [(100 + i, words(rng, i, many) + " " + shared[i:] + "\n" + words(rng, 9, many)) for i in range(15)]
    rows += [(200 + i, base) for i in range(4)]
    rows += [(300 + i, " ".join(w if rng.random() > 0.01 * i else "zz" for w in base.split())) for i in range(10)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "x " * 150), (404, "y x " * 100), (405, "one"), (406, "ONE"), (407, words(rng, 3000, many))]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "en", f"src{(d or 0) % 5}", len(t or ""), d, "k", 1) for d, t in corpus], "doc_id long, text string, lang string, source string, n_chars long, key long, class string, chunk int")


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
