"""Sorts, top-n and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_size(reads: DataFrame, min_size: int = 0, max_size: int = 2**62, top: int | None = None) -> DataFrame:
    out = reads.where(F.col("size").between(min_size, max_size)).orderBy(F.col("size").desc(), "header", "seqno")
    return out.limit(top) if top is not None else out


def by_length(reads: DataFrame, top: int | None = None) -> DataFrame:
    out = reads.orderBy(F.length("seq").desc(), F.col("size").desc(), "header", "seqno")
    return out.limit(top) if top is not None else out


def shuffle(reads: DataFrame, seed: int = 1, top: int | None = None) -> DataFrame:
    """A seeded permutation that doesn't depend on partitions."""
    out = reads.orderBy(F.xxhash64(F.lit(seed), "seqno"), "seqno")
    return out.limit(top) if top is not None else out


def subsample(reads: DataFrame, n: int | None = None, percent: float | None = None, seed: int = 1) -> DataFrame:
    """Reads with ``drawn`` of their ``size`` copies, drawn without replacement; n copies in all.

    Each copy's hash is its place in the draw. Counts of 65536 ranges of the hash
    find the range in which the n-th copy is; only that one is ranked.
    """
    copies = reads.select("seqno", F.explode(F.expr("sequence(1, cast(size as int))")).alias("copy")).withColumn("h", F.xxhash64(F.lit(seed), "seqno", "copy"))
    copies = copies.withColumn("part", F.shiftright("h", 48))
    counts = copies.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("k").over(upto), F.lit(0)))
    total = reads.agg(F.sum("size").alias("total"))
    goal = F.lit(n) if n is not None else F.floor(F.col("total") * percent / 100)
    marked = copies.join(counts, "part").crossJoin(F.broadcast(total.select(goal.alias("goal"))))
    whole = marked.where(F.col("before") + F.col("k") <= F.col("goal")).select("seqno")
    edge = marked.where((F.col("before") < F.col("goal")) & (F.col("before") + F.col("k") > F.col("goal")))
    edge = edge.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("h", "seqno", "copy"))).where(F.col("before") + F.col("nth") <= F.col("goal")).select("seqno")
    drawn = whole.union(edge).groupBy("seqno").agg(F.count(F.lit(1)).alias("drawn"))
    return reads.join(drawn, "seqno", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
