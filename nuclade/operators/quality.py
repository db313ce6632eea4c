"""Statistics of symbols, lengths and qualities: sums by position within batches, then one small shuffle.

Reads without a sequence or quality count for nothing in these; an empty table
gives no rows, but for statistics of the whole table, which give one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import quals


def positions(reads: DataFrame, offset: int = 33, floor: bool = False) -> DataFrame:
    """``(seqno, pos, q, p, ee, low, n)``: each symbol's score and error, and running error and minimum of the read.

    A read without qualities has no rows. Nothing is shuffled: what runs along a
    read is known within its row.
    """
    names = ["seqno", "pos", "q", "p", "ee", "low", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("seqno")
            for rows, q, inside in quals.matrices(batch.column("qual"), offset):
                q = np.maximum(q, 0) if floor else q
                p, ee, low = quals.running(q, inside)
                at, place = np.nonzero(inside)
                lens = inside.sum(axis=1)
                columns = [numbers.slice(rows.start, rows.stop - rows.start).take(pa.array(at)), *(pa.array(x) for x in ((place + 1).astype(np.int32), q[inside].astype(np.int32), p[inside], ee[inside], low[inside].astype(np.int32), lens[at].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return reads.select("seqno", "qual").mapInArrow(run, "seqno long, pos int, q int, p double, ee double, low int, n int")


def chars(reads: DataFrame) -> DataFrame:
    """``(symbol, count, longest)`` of sequence symbols: how many there are and their longest run less one."""
    runs = reads.select(F.explode(F.regexp_extract_all("seq", F.lit(r"((.)\2*)"), 1)).alias("run"))
    return runs.groupBy(F.substring("run", 1, 1).alias("symbol")).agg(F.sum(F.length("run")).alias("count"), (F.max(F.length("run")) - 1).cast("long").alias("longest"))


def tails(reads: DataFrame, least: int = 4) -> DataFrame:
    """``(symbol, tails)``: reads that end in ``least`` equal symbols at least."""
    tail = F.regexp_extract("seq", r"((.)\2*)$", 1)
    return reads.where(F.length(tail) >= least).groupBy(F.right("seq", F.lit(1)).alias("symbol")).agg(F.count(F.lit(1)).alias("tails"))


def symbols(reads: DataFrame) -> DataFrame:
    """``(qual_min, qual_max, offset)`` and the guessed offset of quality symbols."""
    each = reads.select(F.array_min(F.split("qual", "")).alias("a"), F.array_max(F.split("qual", "")).alias("b")).agg(F.min("a").alias("qual_min"), F.max("b").alias("qual_max"))
    return each.withColumn("offset", F.when((F.col("qual_min") < ";") | (F.col("qual_max") < "K"), 33).otherwise(64))


def lengths(reads: DataFrame) -> DataFrame:
    """``(len, n, longer)``: reads of a length, and of this or a greater one."""
    counts = reads.groupBy(F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("longer", F.sum("n").over(Window.orderBy(F.col("len").desc())))


def score_counts(reads: DataFrame) -> DataFrame:
    return reads.select(F.explode(C.scores(F.col("qual"))).alias("q")).groupBy("q").agg(F.count(F.lit(1)).alias("n"))


def by_position(reads: DataFrame) -> DataFrame:
    """``(pos, recs, avg_q, avg_p, avg_ee)`` of all reads that reach a position."""
    sums = quals.summed(reads, 33, {"recs": lambda q, p, ee, low: 1, "q": lambda q, p, ee, low: q, "p": lambda q, p, ee, low: p, "ee": lambda q, p, ee, low: ee}, "double")
    return sums.select("pos", F.col("recs").cast("long").alias("recs"), *[(F.col(c) / F.col("recs")).alias(f"avg_{c}") for c in ("q", "p", "ee")])


def kept_by_error(reads: DataFrame, cutoffs: tuple[float, ...] = (1.0, 0.5, 0.25, 0.1)) -> DataFrame:
    """Reads whose expected error up to a position is within each cutoff."""
    return quals.summed(reads, 33, {f"ee_{str(c).replace('.', '_')}": lambda q, p, ee, low, c=c: ee <= c for c in cutoffs}, "long")


def kept_by_quality(reads: DataFrame, cutoffs: tuple[int, ...] = (5, 10, 15, 20)) -> DataFrame:
    """Reads whose scores up to a position are all above each cutoff."""
    return quals.summed(reads, 33, {f"q_{c}": lambda q, p, ee, low, c=c: low > c for c in cutoffs}, "long")


def eestats(reads: DataFrame) -> DataFrame:
    """By position: reads, quartiles, mean and range of scores, mean error, and quartiles of running error in bins of 1/1000."""
    rows = positions(reads, floor=True).withColumn("bin", F.floor(1000 * F.col("ee") + 1e-9))
    at = lambda f, c: f"percentile_disc({f}) within group (order by {c})"
    agg = [F.count(F.lit(1)).alias("recs"), F.min("q").alias("q_min"), F.avg("q").alias("q_mean"), F.max("q").alias("q_max"), F.avg("p").alias("pe_mean"), F.avg("ee").alias("ee_mean")]
    agg += [F.expr(at(f, "q")).cast("int").alias(f"q_{n}") for f, n in ((0.25, "lo"), (0.5, "med"), (0.75, "hi"))]
    agg += [((F.expr(at(f, "bin")) + 0.5) / 1000).alias(f"ee_{n}") for f, n in ((0.25, "lo"), (0.5, "med"), (0.75, "hi"))]
    return rows.groupBy("pos").agg(*agg)


def eestats2(reads: DataFrame, step: int = 50, errors: tuple[float, ...] = (0.5, 1.0, 2.0)) -> DataFrame:
    """``(len, ee, n)``: reads of a length at least whose error up to it is within each cutoff."""
    wide = quals.summed(reads, 33, {f"n{i}": lambda q, p, ee, low, e=e: ee <= e for i, e in enumerate(errors)}, "long").where(F.col("pos") % step == 0)
    pairs = F.explode(F.array(*[F.struct(F.lit(e).alias("ee"), F.col(f"n{i}").alias("n")) for i, e in enumerate(errors)]))
    return wide.select(F.col("pos").alias("len"), pairs.alias("x")).select("len", "x.ee", "x.n")


def db_stats(reads: DataFrame) -> DataFrame:
    n = F.length("seq")
    return reads.agg(F.sum(n).alias("nucleotides"), F.count(F.lit(1)).alias("sequences"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("average"))
