"""Jaccard self-join of documents on word shingles, by adaptive multi-match prefixes.

Documents with equal sets form one class; only classes are compared. A class
sends its rarest shingles, n - ceil(t * n) + l of its n, and a pair is looked at
only if it shares at least min(l, l') of what both send, more if the sizes call for
more. Each class picks the l with the least estimated cost: more matches cost more
shingles and leave fewer candidates. Frequencies for the order come from a counter
table of fixed size over all documents; any order is right, a good one is fast.

All pairs of a short list of classes that send a shingle are candidates. A class
with fewer long lists than matches asked for meets all it is similar to in a short
one. What is left in long lists is compared with one member only, its pivot, and described
by the differences to it: the shingles that just one of both has. Two that are
similar to the pivot are connected through it. Of any other similar pair x, y with
d and e differences to the pivot, (d + e - distance(x, y)) / 2 are the same, at
least one, so the pair is found by the prefixes of its differences, in lists that
are short or treated again in the same way. There it is met only where what is left of both
ends' differences is enough for the rest, in one of the lists that have the same members. What large groups of copies have in
common is thereby left out of the comparison.

Hashes are keyed by a number drawn for the job. Classes whose 64-bit names are
equal are told apart by 64 bits more; two sets of a pair are compared by 64-bit
hashes of their shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._arrays import U64
from .components import components, cut, gathered, row_key

COUNTER_BITS, BLOCK = 20, 1 << 15
#: A prefix is lengthened for so many matches, and a part of what a similar set may lack, if the set has so many; for some more where the estimated cost is less.
LEAST_MATCHES, PART, MORE = 3, 8, (0, 1, 2, 3, 5, 8, 13)
#: Cost of verifying a candidate in shingles sent; links of a shingle of unknown frequency.
VERIFY_COST, UNSEEN = 20.0, 0.3
#: Ids that are sent to every task at most (8 MB); beyond that they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Lists of more classes than this get a pivot.
SHORT = 12
#: Times that lists get pivots; all pairs of what is left then are candidates.
LEVELS = 2
#: Bytes of the sets, and pairs, that are verified together.
BLOCK_BYTES, BLOCK_PAIRS = 16 << 20, 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, key: int):
    """Yields row range and (row, hash) of each row's distinct shingles in order; a row with fewer words than k has one, with none none."""
    words = A.Words(data, offsets, key, lower=True)
    size = np.diff(words.offsets)
    for i, j in A.slices(words.offsets):
        a, b = int(words.offsets[i]), int(words.offsets[j])
        own = words.hash[a:b]
        row = np.repeat(np.arange(i, j), size[i:j])
        h = A.grams(own, k, key)
        at = np.flatnonzero(row[: len(h)] == row[k - 1 :]) if len(h) else np.zeros(0, np.int64)
        few = np.flatnonzero((size[i:j] > 0) & (size[i:j] < k)) + i
        h, row = np.append(h[at], A.stretches(own, words.offsets[few] - a, size[few], key)), np.append(row[at], few)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield i, j, row[new], h[new]


def names(h: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each row's set."""
    at = np.append(0, np.cumsum(n))[:-1]
    sums = np.add.reduceat(np.append(A.mix(h ^ U64(salt)), U64(0)), np.minimum(at, len(h)))
    return A.mix(sums + n.astype(U64)).view(np.int64)


NAME, CHECK = 0x5851F42D4C957F2D, 0x14057B7EF767814F


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _key():
    """Names a row beside its id."""
    return row_key(F.col("text"))


class Shingles:
    """How a job hashes shingles, and how often they come."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent, self.key = docs, k, percent, A.job_key()
        counts = self.frequencies()
        usual = counts.mean()
        # what stands out of the noise of a counter
        often = np.maximum(1, counts - (usual + 4 * np.sqrt(usual))).astype(np.float32)
        self.often = docs.sparkSession.sparkContext.broadcast(often)

    def frequencies(self) -> np.ndarray:
        """How many documents have shingles of each counter; 2**COUNTER_BITS numbers."""
        k, key = self.k, self.key

        def count(batches):
            total = np.zeros(1 << COUNTER_BITS, np.uint32)
            for batch in A.pieces(batches):
                for _, _, _, h in shingle_sets(*A.utf8(batch.column("text")), k, key):
                    total += np.bincount(_counter(h), minlength=len(total)).astype(np.uint32)
            blocks = [total[i : i + BLOCK] for i in range(0, len(total), BLOCK)]
            yield pa.record_batch({"block": pa.array(range(len(blocks)), pa.int32()), "counts": pa.array([b.tobytes() for b in blocks], pa.binary())})

        def add(table: pa.Table) -> pa.Table:
            total = np.zeros(BLOCK, np.int64)
            for x in table["counts"].to_pylist():
                total += np.frombuffer(x, np.uint32)
            return pa.table({"block": table["block"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

        rows = self.docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
        out = np.zeros(1 << COUNTER_BITS, np.int64)
        for r in rows:
            out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.int64)
        return out


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - COUNTER_BITS)).astype(np.int64)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def features(shingles: Shingles) -> DataFrame:
    """doc_id, key (names the row), n (size of the set), class (null if empty), weight (how common its prefix is), prefix (its rarest shingles) of each row."""
    k, percent, key, table = shingles.k, shingles.percent, shingles.key, shingles.often

    def run(batches):
        for batch in A.pieces(batches):
            for i, j, row, h in shingle_sets(*A.utf8(batch.column("text")), k, key):
                n = np.bincount(row - i, minlength=j - i)
                often = table.value[_counter(h)]
                order = np.lexsort((h, np.log2(often).astype(np.int8), row))
                at = np.append(0, np.cumsum(n))
                cost = np.append(0, np.cumsum((often - 1 + UNSEEN)[order], dtype=np.float64))
                need = least_overlap(n, percent)
                best, matches = np.full(j - i, np.inf), np.ones(j - i, np.int64)
                for more in MORE:
                    m = np.maximum(1, np.minimum(need, LEAST_MATCHES + (n - need) // PART + more))
                    size = np.minimum(n, n - need + m)
                    c = size + VERIFY_COST * (cost[at[:-1] + size] - cost[at[:-1]]) / m
                    better = c < best
                    best[better], matches[better] = c[better], m[better]
                size = np.minimum(n, n - need + matches)
                sent, ends = A.gather(h[order], at[:-1], size)
                none = n == 0
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(i, j - i),
                        "key": batch.column("key").slice(i, j - i),
                        "n": pa.array(n),
                        "class": pa.array(names(h, n, NAME), mask=none),
                        "check": pa.array(names(h, n, CHECK), mask=none),
                        "weight": pa.array(cost[at[:-1] + size] - cost[at[:-1]]),
                        "prefix": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sent.view(np.int64))),
                    }
                )

    rows = _texts(shingles.docs).withColumn("key", _key()).mapInArrow(run, "doc_id long, key binary, n long, class long, check long, weight double, prefix array<long>")
    found = cut(rows)
    twice = gathered(found.groupBy("class").agg(F.min("check").alias("one"), F.max("check").alias("other")).filter("one <> other"))
    if not twice.isEmpty():  # different sets of one name: all but one get another
        found = cut(found.join(twice, "class", "left").withColumn("class", F.when(F.col("check") > F.col("one"), F.xxhash64("class", "check")).otherwise(F.col("class"))).drop("one", "other"))
    return found.drop("check")


def _sets(shingles: Shingles, wanted: DataFrame) -> DataFrame:
    """u, class, set (packed hashes, in order) for each of `to` of the wanted classes (class, rep, key, to).

    Sets are shuffled once, to where they are needed. Rows that repeat another give
    its set again only from another task.
    """
    k, key = shingles.k, shingles.key
    wanted = gathered(wanted).select("class", "to", "rep", F.col("key").alias("own"))
    small = wanted.agg(F.sum(F.size("to"))).first()[0] or 0
    texts = _texts(shingles.docs).withColumn("key", _key())
    wanted = F.broadcast(wanted) if small <= BROADCAST_IDS else wanted
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["rep"]) & (texts["key"] == wanted["own"])).select("class", "to", "text")

    def run(batches):
        told: set[int] = set()
        for batch in A.pieces(batches):
            new = []
            for name in batch.column("class").to_pylist():
                new.append(name not in told)
                told.add(name)
            batch = batch.filter(pa.array(new, pa.bool_()))
            for i, j, row, h in shingle_sets(*A.utf8(batch.column("text")), k, key):
                n = np.bincount(row - i, minlength=j - i)
                at = np.append(0, np.cumsum(n))
                raw = h.tobytes()
                yield pa.record_batch({"class": batch.column("class").slice(i, j - i), "to": batch.column("to").slice(i, j - i), "set": pa.array([raw[8 * at[r] : 8 * at[r + 1]] for r in range(j - i)], pa.binary())})

    return texts.mapInArrow(run, "class long, to array<long>, set binary").select(F.explode("to").alias("u"), "class", "set")


def _dealt(pairs: DataFrame, by: str = "b") -> DataFrame:
    """pairs (a, b, n: size of a's set) and p: what is verified together.

    Pairs are dealt by a column that groups them, so that a set is sent once for each
    group it is in at most. Groups of very many pairs are dealt by b, and the pairs of a b that
    has very many are divided by a.
    """
    total = pairs.agg(F.sum("n"), F.count("*")).first()
    deals = max(1, -(-8 * (total[0] or 0) // BLOCK_BYTES), -(-total[1] // BLOCK_PAIRS))

    def large(name: str) -> DataFrame:
        """What can't be verified together: a row for each BLOCK_BYTES or BLOCK_PAIRS at most."""
        many = pairs.groupBy(name).agg(F.sum("n").alias("n"), F.count("*").alias("pairs"))
        many = many.withColumn("parts", F.greatest(F.ceil(8 * F.col("n") / BLOCK_BYTES), F.ceil(F.col("pairs") / BLOCK_PAIRS)))
        return F.broadcast(gathered(many.filter("parts > 1").select(name, "parts")))

    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("a"), F.col("parts")) + 1)
    p = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("b"), F.lit(deals))).otherwise(F.xxhash64("b", part))
    out = pairs.join(large("b"), "b", "left").withColumn("p", p).drop("parts")
    if by != "b":
        p = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64(by), F.lit(deals))).otherwise(F.col("p"))
        out = out.join(large(by), by, "left").withColumn("p", p).drop("parts")
    return out


def _verified(shingles: Shingles, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """What a comparison of the sets of a and b shows, for pairs (a, b, n, weight, pivot, head: names their group): those that are similar, and all whose b is a pivot.

    near: whether they are similar. d: how many differences a pivot and its member have. far_prefix: the differences that a similar
    pair shares one of if its other end isn't near to the pivot; any_prefix, if a isn't near: the same
    for an end that may be.
    """
    percent, table = shingles.percent, shingles.often
    ends = lambda rows, *also: rows.select(*also, F.col("a").alias("class")).union(rows.select(*also, F.col("b").alias("class"))).distinct()
    keyed = gathered(_dealt(pairs, "head"))
    to = ends(keyed, F.col("p").alias("u")).groupBy("class").agg(F.collect_list("u").alias("to"))
    needed = _sets(shingles, to.join(classes.select("class", "rep", "key"), "class"))
    schema = "a long, b long, n long, weight double, pivot boolean, near boolean, d long, far_prefix array<long>, any_prefix array<long>"

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        known = sets["class"].to_numpy()
        order = np.argsort(known)
        have = [np.frombuffer(s.as_buffer(), U64) for s in sets["set"]]
        a, b = (order[np.searchsorted(known, pairs[c].to_numpy(), sorter=order)] if len(known) else np.zeros(0, np.int64) for c in ("a", "b"))
        pivot = pairs["pivot"].to_numpy()
        near, told, far_prefix, any_prefix = np.zeros(len(a), bool), pivot.copy(), [[]] * len(a), [[]] * len(a)
        size = np.zeros(len(a), np.int64)
        for r in range(len(a)):
            x, y = have[a[r]], have[b[r]]
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            near[r] = 100 * common >= percent * (len(x) + len(y) - common)
            if not pivot[r]:
                told[r] = near[r]
                continue
            d = size[r] = len(both) - 2 * common
            # what a similar pair shares at least, if the other end is far from the pivot, and in any case
            any_ = max(1, d - len(x) * (100 - percent) // percent)
            far = max(any_, ((100 + percent) * d + (100 - percent) * (len(y) - len(x))) // (2 * (100 + percent)) + 1)
            need = far if near[r] else any_
            if need <= d:
                rare = differences(x, y, table.value)
                far_prefix[r] = rare[: max(0, d - far + 1)].view(np.int64)
                if not near[r]:
                    any_prefix[r] = rare[: d - any_ + 1].view(np.int64)
        keep = np.flatnonzero(told)
        lists = lambda x: pa.array([x[r] for r in keep.tolist()], pa.list_(pa.int64()))
        out = pairs.select(["a", "b", "n", "weight", "pivot"]).take(pa.array(keep))
        return out.append_column("near", pa.array(near[keep])).append_column("d", pa.array(size[keep])).append_column("far_prefix", lists(far_prefix)).append_column("any_prefix", lists(any_prefix))

    return gathered(keyed.groupBy("p").cogroup(needed.groupBy("u")).applyInArrow(run, schema))


def differences(x: np.ndarray, pivot: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Hashes in just one of two sets: first what x has more, the rarest first; then what it lacks, the commonest, that few others lack, first."""
    lacks = lambda a, b: a[b[np.minimum(np.searchsorted(b, a), len(b) - 1)] != a]
    more, less = lacks(x, pivot), lacks(pivot, x)
    rank = lambda h: np.log2(often[_counter(h)]).astype(np.int8)
    return np.append(more[np.lexsort((more, rank(more)))], less[np.lexsort((less, -rank(less)))])


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """Which classes send a shingle (k1), if several do, and the number of long lists (n_long) of the class.

    A class is in long lists only if it has as many as a similar class must share at
    least, and then in the shorter ones. They are divided into bands of like sizes (k2): a class is in its own
    band and the next.
    """
    sent = classes.select(F.explode("prefix").alias("k1"), "class")
    shared = gathered(sent.groupBy("k1").agg(F.count("*").alias("f")).filter("f > 1"))
    by_class = sent.join(shared, "k1").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("f", "k1"))).alias("sent"))
    by_class = by_class.join(classes.select("class", "n", "weight", (F.col("n") - F.size("prefix")).alias("kept")), "class")
    share = lambda n: F.floor((n * percent + 99) / 100)
    long = F.size(F.filter("sent", lambda s: s["f"] > SHORT))
    # matches of the smallest set that can be similar; larger ones ask for more
    small = share(F.col("n"))
    asked = F.least(share(F.col("n")) - F.col("kept"), share(small), LEAST_MATCHES + F.floor((small - share(small)) / PART))
    band = F.floor(F.log("n") / math.log(100 / percent)).cast("long") if percent < 100 else F.col("n")
    bands = F.when(F.col("f") > SHORT, F.array(band, band + 1)).otherwise(F.array(F.lit(-1).cast("long")))
    # two classes that meet in long lists alone share `asked` of them: one is among the shortest, all but asked - 1
    kept = F.slice("sent", F.lit(1), F.size("sent") - F.least("n_long", F.col("asked") - 1).cast("int"))
    rows = by_class.withColumn("n_long", long).withColumn("asked", asked).select("*", F.inline(kept))
    rows = rows.select("k1", F.posexplode(bands).alias("next", "k2"), "class", "n", "weight", "kept", "n_long")
    return rows.select("k1", "k2", "class", "n", "weight", "kept", "n_long", F.lit(0).alias("side"), (F.col("next") == 0).alias("own"), *_unknown("d", "at"))


def _excess(percent: int) -> Column:
    """For similar sets, the sum of both ends' excess is 2 * (100 + percent) times what they share of d and e differences at most."""
    return (100 + percent) * F.col("d") - (100 - percent) * F.col("n")


def _reach(percent: int) -> Column:
    """The largest excess of another set that one can still share enough with from a place on; null: any."""
    return 2 * (100 + percent) * (F.col("d") - F.col("at")) - _excess(percent)


def _next_lists(found: DataFrame, percent: int) -> DataFrame:
    """Lists of the classes by pivot (k1) and shared difference (k2): pairs are to be looked for on side 0, or from side 1 to side 2."""
    company = found.groupBy(F.col("b").alias("pivot_")).agg(F.count_if("near").alias("nears"), F.count_if(~F.col("near")).alias("fars"), F.min(_excess(percent)).alias("least_excess"))
    found = found.join(company, F.col("b") == F.col("pivot_")).filter("fars > 1 or fars > 0 and nears > 0")
    row = lambda tokens, side: found.select("nears", "fars", "least_excess", F.col("b").alias("k1"), F.posexplode(tokens).alias("at", "k2"), F.col("a").alias("class"), "n", "weight", "near", "d").filter(_reach(percent) >= F.col("least_excess")).withColumn("side", F.lit(side))
    rows = row("far_prefix", 0).filter("not near and fars > 1").unionAll(row("any_prefix", 1).filter("not near and nears > 0")).unionAll(row("far_prefix", 2).filter("near"))
    k2 = F.when(F.col("side") == 0, F.col("k2")).otherwise(F.xxhash64("k2"))
    return rows.select("k1", k2.alias("k2"), "class", "n", "weight", *_unknown("kept", "n_long"), "side", F.lit(True).alias("own"), "d", F.col("at").cast("long").alias("at"))


def _unknown(*names: str) -> list[Column]:
    return [F.lit(None).cast("long").alias(name) for name in names]


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs x, y of a list's members that may be similar, a row for each list they meet in.

    By their differences to a pivot, d and e, they meet only where enough is left of
    both for what a similar pair shares; the first difference that it shares is such a place.
    """
    x, y = rows.alias("x"), rows.alias("y")
    sides = ((F.col("x.side") == 0) & (F.col("y.side") == 0) & (F.col("x.class") < F.col("y.class"))) | ((F.col("x.side") == 1) & (F.col("y.side") == 2))
    left = F.least(F.col("x.d") - F.col("x.at"), F.col("y.d") - F.col("y.at"))
    enough = F.coalesce(2 * left >= F.col("x.d") + F.col("y.d") - F.col("x.n") - F.col("y.n") + 2 * _common("x.n", "y.n", percent), F.lit(True))
    return x.join(y, (F.col("x.k1") == F.col("y.k1")) & (F.col("x.k2") == F.col("y.k2")) & sides & (F.col("x.label") != F.col("y.label")) & (F.col("x.own") | F.col("y.own")) & _alike("x.n", "y.n", percent) & enough)


def similar_classes(shingles: Shingles, found: DataFrame) -> DataFrame:
    """Links (a, b) between classes of `features` that connect all that similar pairs connect."""
    percent = shingles.percent
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    classes = found.filter("class is not null").groupBy("class").agg(first.alias("first"), F.max("n").alias("n"), F.max("weight").alias("weight"), F.max("prefix").alias("prefix"))
    classes = cut(classes.select("class", F.col("first.doc_id").alias("rep"), F.col("first.key").alias("key"), "n", "weight", "prefix"))
    lists = cut(_lists(classes, percent).withColumn("label", F.col("class")))
    links = classes.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0)

    def candidates(rows: DataFrame) -> DataFrame:
        """Pairs of short lists, in enough of them: shingles that the one whose last comes first has sent, and that meet nothing, meet nothing at all; long lists may hold the rest."""
        met, common = _met(rows, percent), _common("x.n", "y.n", percent)
        swap = F.col("x.class") < F.col("y.class")
        end = lambda c, first: F.when(swap == first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
        met = met.select(end("class", F.lit(True)).alias("a"), end("class", F.lit(False)).alias("b"), end("n", F.lit(True)).alias("n"), (common - F.greatest("x.kept", "y.kept") - F.least("x.n_long", "y.n_long")).alias("least"), F.col("x.lo").alias("head"))
        met = met.groupBy("a", "b").agg(F.max("n").alias("n"), F.count("*").alias("met"), F.coalesce(F.min("least"), F.lit(1)).alias("least"), F.min("head").alias("head")).filter("met >= least")
        return met.select("a", "b", "n", F.lit(0.0).alias("weight"), F.lit(False).alias("pivot"), "head")

    for level in range(LEVELS + 1):
        last = level == LEVELS
        if level:
            lists = cut(lists.join(label, "class", "left").withColumn("label", F.coalesce("label", "class")))
        # a list matters if it has two labels, a class in its own band and, if sides are to be joined, both
        heads = lists.groupBy("k1", "k2").agg(F.count("*").alias("f"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("side").alias("from"), F.max("side").alias("to"), F.max("own").alias("some"), F.max(F.struct("weight", "class")).alias("head"), F.bit_xor(F.xxhash64("class", "side")).alias("members"), F.bit_xor(F.xxhash64("side", "class")).alias("check"), F.sum("at").alias("at"), F.min(_excess(percent)).alias("least_excess"))
        heads = heads.filter("lo <> hi and some and (to = 0 or from < to)").select("k1", "k2", "f", "lo", F.col("head.class").alias("pivot"), "least_excess", "members", "check", "at")
        if level:  # of differences that the same members of a pivot share, the first comes first for all of them
            rest = F.struct("k2", "f", "lo", "pivot", "least_excess")
            heads = heads.groupBy("k1", "members", "check").agg(F.min_by(rest, F.struct("at", "k2")).alias("rest")).select("k1", "rest.*")
        heads = cut(heads.select("k1", "k2", "f", "lo", "pivot", "least_excess"))
        within = lambda some: lists.join(some, ["k1", "k2"]).filter(F.coalesce(_reach(percent) >= F.col("least_excess"), F.lit(True)))
        # the least label of a list names the group of its pairs: near copies meet in many lists of much the same members
        pairs = candidates(within(heads if last else heads.filter(F.col("f") <= SHORT)))
        if not last:
            long = within(heads.filter(F.col("f") > SHORT)).filter("class <> pivot")
            pairs = pairs.unionByName(long.groupBy(F.col("class").alias("a"), F.col("pivot").alias("b")).agg(F.max("n").alias("n"), F.max("weight").alias("weight"), F.min("lo").alias("head")).withColumn("pivot", F.lit(True)))
        pairs = gathered(pairs)
        if pairs.isEmpty():
            break
        seen = _verified(shingles, pairs, classes)
        links = gathered(links.unionByName(seen.filter("near").select("a", "b")))
        if last:
            break
        lists = _next_lists(seen.filter("pivot"), percent)
        label = components(links).toDF("class", "label")
    return links


def _common(x: str, y: str, percent: int) -> Column:
    """What similar sets of such sizes share at least."""
    return F.floor(((F.col(x) + F.col(y)) * percent + 99 + percent) / (100 + percent))


def _alike(x: str, y: str, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of docs (doc_id, text).

    Words are what white space divides, A-Z in lower case; a set has the distinct
    k-word shingles, of fewer words the whole as one. Sets link at a Jaccard
    similarity of `percent` or more. No words or null text: 0 shingles, a
    component of its own. Repeated rows give a row each; a null doc_id is never a
    component's id unless there is no other. Other columns are ignored.
    """
    shingles = Shingles(docs, k, percent)
    found = features(shingles)
    root = components(similar_classes(shingles, found))
    ids = found.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least")).join(root.withColumnRenamed("node", "class"), "class", "left")
    ids = ids.withColumn("root", F.coalesce("root", "class"))
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = ids.join(least, "root").select("class", "component_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), "class").join(ids, "class", "left").select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, all columns, of each group, and all rows without words.

    Groups are those of `groups`, formed by the rows' own texts. Of each stays the
    row with the least doc_id, null last; of rows that share it that with the least
    hash of its text; of rows equal in both one, the first by a hash of all columns.
    """
    shingles = Shingles(docs, k, percent)
    found = features(shingles)
    root = components(similar_classes(shingles, found))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "copies")
    rows = found.filter("class is not null").groupBy("class", "doc_id", "key").agg(F.count("*").alias("copies"))
    first = rows.groupBy("class").agg(F.min(place).alias("first")).join(root.withColumnRenamed("node", "class"), "class", "left")
    first = first.groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("first").alias("first"))
    wordless = found.filter("class is null").select("doc_id", "key").distinct().withColumn("copies", F.lit(1).cast("long"))
    keep = cut(first.select("first.doc_id", "first.key", "first.copies").union(wordless).toDF("_id", "_key", "_copies"))
    own = row_key(docs["text"])
    taken = lambda some: docs.join(some, docs["doc_id"].eqNullSafe(some["_id"]) & (own == some["_key"]), "left_semi")
    several = keep.filter("_copies > 1")
    out = taken(keep.filter("_copies = 1"))
    if not several.isEmpty():
        row = F.struct(*docs.columns)
        again = taken(several).groupBy(F.col("doc_id").alias("id"), _key().alias("key")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
        out = out.unionByName(again.select("row.*"))
    return out
