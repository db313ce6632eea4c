"""Word sets, shared counts, orientation and index statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import columns as C
from ..functions import words
from ..functions.kernels import dust_all

#: Rows of a block of queries and of targets.
QUERIES, TARGETS = 1024, 8192


def tasks(rows: DataFrame) -> int:
    """Partitions for work that takes long for its bytes, and so isn't to be dealt by these."""
    spark = rows.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


@F.pandas_udf(StringType())
def dust_masked(seq: pd.Series) -> pd.Series:
    some = seq.notna()
    out = pd.Series([None] * len(seq), index=seq.index, dtype=object)
    out[some] = dust_all(seq[some].tolist())
    return out


def masked(reads: DataFrame, how: str = "dust", hard: bool = False) -> DataFrame:
    """Low complexity in lower case (``dust``), as it is (``soft``), or nothing masked (``none``); ``hard`` makes it N."""
    if how == "dust":
        reads = reads.repartition(tasks(reads), "seqno")
    seq = {"dust": dust_masked("seq"), "soft": F.col("seq"), "none": F.upper("seq")}[how]
    return reads.withColumn("seq", F.regexp_replace(seq, "[a-z]", "N") if hard else seq)


def postings(reads: DataFrame, k: int = 8) -> DataFrame:
    """``(seqno, word)`` of the distinct words of each read."""
    return reads.select("seqno", F.explode(C.words(F.col("seq"), k)).alias("word"))


def shared(queries: DataFrame, targets: DataFrame, k: int = 8, least: int = 1, top: int | None = None) -> DataFrame:
    """``(q, t, shared, t_len)``: distinct words that a query and a target have in common, ``least`` of them or all that a query has.

    Rows are dealt to blocks by hash, and each pair of blocks is one group, whose
    counts are an array in its task; no word is dropped, and pairs leave a task
    only if they share enough words and, with ``top``, are among a query's best
    there. Null sequences and those without words share nothing; reads that
    repeat a seqno are counted by row.
    """
    rows = lambda x, name: x.where("seq is not null").select(F.col("seqno").alias(name), "seq")
    left, right = rows(queries, "q"), rows(targets, "t")
    # Counted without the sequences, so that masking isn't done for a count.
    n, m = (max(1, -(-x.count() // size)) for x, size in ((queries, QUERIES), (targets, TARGETS)))
    block = lambda name, of: F.pmod(F.xxhash64(name), F.lit(of)).cast("int")
    left = left.withColumn("i", block("q", n)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = right.withColumn("j", block("t", m)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return words.shared(a, b, k, least, top)

    left, right = (x.repartition(tasks(queries), "i", "j") for x in (left, right))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, "q long, t long, shared long, t_len long")


def orient(queries: DataFrame, targets: DataFrame, k: int = 12) -> DataFrame:
    """``(seqno, forward, reverse, strand)``: votes of a read's words for its strand; + or -, or ? without a clear majority."""
    counts = postings(targets, k).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    own = postings(queries, k).withColumn("rc", C.reverse_complement(F.col("word")))
    hits = own.join(counts, "word", "left").withColumnRenamed("n", "ahead")
    hits = hits.join(counts.select(F.col("word").alias("rc"), F.col("n").alias("behind")), "rc", "left").fillna(0, ["ahead", "behind"])
    votes = hits.groupBy("seqno").agg(F.count(F.when(F.col("ahead") > 8 * F.col("behind"), 1)).alias("forward"), F.count(F.when(F.col("behind") > 8 * F.col("ahead"), 1)).alias("reverse"))
    votes = queries.select("seqno").join(votes, "seqno", "left").fillna(0, ["forward", "reverse"])
    clear = lambda a, b: (F.col(a) >= 1) & (F.col(a) >= 4 * F.col(b))
    return votes.withColumn("strand", F.when(clear("forward", "reverse"), "+").when(clear("reverse", "forward"), "-").otherwise("?"))


def oriented(queries: DataFrame, strands: DataFrame) -> DataFrame:
    both = queries.join(strands.select("seqno", "strand"), "seqno")
    turn = F.col("strand") == "-"
    return both.withColumn("seq", F.when(turn, C.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).withColumn("qual", F.when(turn, F.reverse("qual")).otherwise(F.col("qual")))


def index_stats(reads: DataFrame, k: int = 8) -> DataFrame:
    """``(postings, words)``: how many words have how many postings."""
    return postings(reads, k).groupBy("word").agg(F.count(F.lit(1)).alias("postings")).groupBy("postings").agg(F.count(F.lit(1)).alias("words"))


def top_words(reads: DataFrame, k: int = 8, top: int = 10) -> DataFrame:
    return postings(reads, k).groupBy("word").agg(F.count(F.lit(1)).alias("postings")).orderBy(F.col("postings").desc(), "word").limit(top)
