"""Greedy clustering in frozen-prefix rounds, and merging of read pairs.

A sequence joins the best centroid among those before it in the order, or
becomes one. Whether two sequences align well enough doesn't depend on the
order, so a round aligns a block of sequences, in parallel, with the centroids
so far and with one another; only the walk over a block's verdicts is ordered.
A round's block has a fixed number of rows, and so has what the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import kmers
from .search import Search, aligned, side
from .transforms import numbered

#: Fixed value: least identity of noise to its centroid.
UNOISE_ID = 0.90
CLUSTER = "seqno long, cluster long, is_centroid boolean, centroid long, id double, cigar string"


def order_of(how: str) -> list[Column]:
    by_size = [F.col("size").desc(), F.col("header"), F.col("seqno")]
    return {"fast": [F.length("seq").desc(), *by_size], "size": by_size, "smallmem": [F.col("seqno")], "unoise": by_size}[how]


def unoise_test(alpha: float = 2.0) -> Column:
    """A sequence is noise of a target when it is rare enough for its mismatches."""
    beta = F.pow(F.lit(0.5), alpha * F.col("mism") + 1)
    return (F.col("mism") == 0) | (F.col("q_size") / F.col("t_size") <= beta)


def cluster(reads: DataFrame, how: Search, order: str = "fast", block: int = 512, alpha: float = 2.0, by_abundance: bool = False, min_size: int = 8) -> DataFrame:
    """``(seqno, cluster, is_centroid, centroid, id, cigar)`` of each read; clusters are numbered from 0 in order.

    In ``unoise`` order reads below ``min_size`` are left out, and a read joins a
    centroid of ``UNOISE_ID`` identity at least whose noise it may be, whatever ``how.id``.
    """
    spark = reads.sparkSession
    if order == "fast":
        how = replace(how, max_rejects=8) if how.max_rejects == 32 else how
    if order == "unoise":
        how = replace(how, id=UNOISE_ID, after=[*how.after, unoise_test(alpha)])
        reads = reads.where(F.col("size") >= min_size)
    placed = numbered(kmers.masked(reads, how.mask) if how.mask != "none" else reads, order_of(order)).withColumnRenamed("nth", "place").cache()
    total = placed.count()
    words = kmers.postings(placed, how.word).join(placed.select("seqno", "place"), "seqno").select(F.col("place").alias("p"), "word").cache()
    counts = words.groupBy("p").agg(F.count(F.lit(1)).alias("words"))
    left = side(placed.withColumn("seqno", F.col("place")), "q").join(counts.withColumnRenamed("p", "q"), "q", "left").fillna(0, ["words"])
    right = side(placed.withColumn("seqno", F.col("place")), "t")
    heads: list[int] = []
    done: list[tuple] = []
    for first in range(1, total + 1, block):
        last = min(total, first + block - 1)
        inside = F.col("p").between(first, last)
        known = spark.createDataFrame([(x,) for x in [*heads, *range(first, last + 1)]], "p long")
        targets = words.join(known, "p", "left_semi").withColumnRenamed("p", "t")
        met = words.where(inside).withColumnRenamed("p", "q").join(targets, "word").where("t < q").groupBy("q", "t").agg(F.count(F.lit(1)).alias("shared"))
        pairs = met.join(left, "q").where(F.col("shared") >= F.least(F.lit(how.least), F.col("words"))).join(right, "t")
        first_test = F.lit(True)
        for one in how.before:
            first_test = first_test & one
        tried = aligned(pairs.withColumn("tried", first_test).where("tried"), how).withColumn("id", F.col(f"id{how.id_def}"))
        test = F.col("id") >= 100 * how.id
        for one in how.after:
            test = test & one
        rows = tried.select("q", "t", "shared", "t_len", "t_size", "id", "cigar", test.alias("ok")).collect()
        by_query: dict[int, list] = {}
        for r in rows:
            by_query.setdefault(r.q, []).append(r)
        centroid = set(heads)
        for q in range(first, last + 1):
            accepts = rejects = 0
            hits = []
            walk = sorted((r for r in by_query.get(q, ()) if r.t in centroid), key=lambda r: (-r.shared, r.t_len, r.t))
            # A limit of 0 is none.
            for r in walk[: how.max_accepts + how.max_rejects + 8] if how.max_accepts and how.max_rejects else walk:
                if accepts >= (how.max_accepts or len(walk)) or rejects >= (how.max_rejects or len(walk)):
                    break
                accepts, rejects = accepts + r.ok, rejects + (not r.ok)
                if r.ok:
                    hits.append(r)
            if hits:
                best = min(hits, key=lambda r: (-r.t_size, -r.id, r.t) if by_abundance else (-r.id, r.t))
                done.append((q, best.t, best.id, best.cigar))
            else:
                heads.append(q)
                centroid.add(q)
    number = spark.createDataFrame([(i, p) for i, p in enumerate(heads)] or [(0, 0)], "cluster long, head long")
    joined = spark.createDataFrame(done, "place long, head long, id double, cigar string").unionByName(number.select(F.col("head").alias("place"), "head", F.lit(None).cast("double").alias("id"), F.lit(None).cast("string").alias("cigar")))
    own = placed.select("seqno", "place")
    out = joined.join(own, "place").join(number, "head").join(own.select(F.col("place").alias("head"), F.col("seqno").alias("centroid")), "head")
    return out.select("seqno", "cluster", (F.col("place") == F.col("head")).alias("is_centroid"), "centroid", "id", "cigar")


def cluster_stats(clusters: DataFrame, reads: DataFrame) -> DataFrame:
    return clusters.join(reads.select("seqno", "size"), "seqno").groupBy("cluster").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("members"))


def members(clusters: DataFrame, reads: DataFrame) -> DataFrame:
    """Rows for profiles and alignments: each member with its centroid's sequence and cigar."""
    centre = reads.select(F.col("seqno").alias("centroid"), F.col("seq").alias("c_seq"))
    own = clusters.join(reads.select("seqno", "seq", "size"), "seqno").join(centre, "centroid")
    return own.withColumn("cigar", F.coalesce("cigar", F.concat(F.length("seq").cast("string"), F.lit("M"))))


def uc_rows(clusters: DataFrame, reads: DataFrame) -> DataFrame:
    """S, H and C rows of clusters."""
    text = lambda c: F.col(c).cast("string")
    own = clusters.join(reads.select("seqno", "header", F.length("seq").alias("len")), "seqno").join(reads.select(F.col("seqno").alias("centroid"), F.col("header").alias("c_header")), "centroid")
    star = F.lit("*")
    s = own.where("is_centroid").select(F.lit("S").alias("type"), "cluster", F.col("len").cast("long").alias("size"), star.alias("id"), star.alias("strand"), star.alias("cigar"), F.col("header").alias("query"), star.alias("target"))
    h = own.where("not is_centroid").select(F.lit("H").alias("type"), "cluster", F.col("len").cast("long").alias("size"), F.format_string("%.1f", "id").alias("id"), F.lit("+").alias("strand"), text("cigar").alias("cigar"), F.col("header").alias("query"), F.col("c_header").alias("target"))
    counts = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.max(F.when(F.col("is_centroid"), F.col("header"))).alias("query"))
    c = counts.select(F.lit("C").alias("type"), "cluster", "size", star.alias("id"), star.alias("strand"), star.alias("cigar"), "query", star.alias("target"))
    return s.union(h).union(c)


def merge_pairs(forward: DataFrame, reverse: DataFrame, how: K.Merge | None = None) -> DataFrame:
    """``(seqno, header, seq, qual, ee, reason)`` of pairs by seqno."""
    how = how or K.Merge()
    both = forward.select("seqno", "header", "seq", "qual").join(reverse.select("seqno", F.col("seq").alias("seq2"), F.col("qual").alias("qual2")), "seqno")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [K.merge(*x, how) for x in zip(batch["seq"], batch["qual"], batch["seq2"], batch["qual2"], strict=True)]
            yield pd.concat([batch[["seqno", "header"]], pd.DataFrame(found, columns=["seq", "qual", "ee", "reason"], index=batch.index)], axis=1)

    return both.mapInPandas(run, "seqno long, header string, seq string, qual string, ee double, reason string")
