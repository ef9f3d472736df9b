"""Connected components of a graph given by its links."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; without one, a new folder in the warehouse."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints/{uuid.uuid4().hex}")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: its lineage ends there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a small table that are kept together; a thousand tasks for a few rows each would cost more than the rows.
TOGETHER = 50_000


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, or longer ones where df has such columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def row_key(text: Column) -> Column:
    """Names a row by its text, beside its id: 128 bits of its SHA-256, which can't be made to collide; null text has a name of its own."""
    return F.coalesce(F.substring(F.unhex(F.sha2(text.cast("string").cast("binary"), 256)), 1, 16), F.lit(b""))


def gathered(df: DataFrame) -> DataFrame:
    """`cut`, in as few partitions as its rows need."""
    out = cut(df)
    return out.coalesce(max(1, -(-out.count() // TOGETHER)))


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node that links reach) of links (a, b).

    Large-star and small-star steps in turn: links are turned towards the least
    neighbour until all are stars. Nodes without links, null ends and loops give
    no row.
    """
    def told(edges: DataFrame) -> tuple[DataFrame, tuple]:
        """The links, written, and what they are in short: their number and a hash of all."""
        edges = cut(edges)
        n, *sums = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.sum(F.xxhash64("b", "a") % (1 << 40))).first()
        return edges.coalesce(max(1, -(-n // TOGETHER))), (n, *sums)

    edges, before = told(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b").distinct()
        edges, after = told(small)
        if after == before:  # both steps leave stars, and only those, as they are
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
        before = after
