"""Filters and semi-joins of reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import quals

BIG = 2**31 - 1


@dataclass(frozen=True)
class Quality:
    strip_left: int = 0
    strip_right: int = 0
    trunc_len: int | None = None
    trunc_len_keep: int | None = None
    trunc_qual: int = -(10**6)
    trunc_ee: float = float("inf")
    trunc_ee_rate: float = float("inf")
    min_qual: int = -(10**6)
    max_ee: float = float("inf")
    max_ee_rate: float = float("inf")
    min_len: int = 1
    max_len: int = BIG
    max_ns: int = BIG
    min_size: int = 0
    max_size: int = 2**62
    offset: int = 33


def analyse(reads: DataFrame, how: Quality) -> DataFrame:
    """Reads trimmed and truncated, with ``ee``, ``discarded`` and ``truncated``; one pass within the row.

    The scan stops at the first symbol whose quality, or whose running expected
    error, calls for truncation; that symbol is left out and not tested.
    """
    cut = lambda c, a, n: F.substring(c, F.lit(a) if isinstance(a, int) else a, F.greatest(n, F.lit(0)))
    n = F.length("seq")
    start = F.least(F.lit(how.strip_left), n)
    length = F.greatest(n - start - how.strip_right, F.lit(0))
    if how.trunc_len is not None:
        length = F.least(length, F.lit(how.trunc_len))
    if how.trunc_len_keep is not None:
        length = F.least(length, F.lit(how.trunc_len_keep))
    rows = reads.withColumn("_old", n).withColumn("_len", length)
    rows = rows.withColumn("seq", cut("seq", start + 1, F.col("_len"))).withColumn("qual", cut("qual", start + 1, F.col("_len")))

    def stops(q, ee, n):
        return (q <= how.trunc_qual) | (ee > how.trunc_ee) | (ee > how.trunc_ee_rate * n)

    rows = rows.withColumn("_s", quals.scan(F.col("qual"), stops, how.min_qual, how.offset))
    rows = rows.withColumn("len", F.col("_s.n")).withColumn("ee", F.col("_s.ee"))
    rows = rows.withColumn("seq", cut("seq", 1, F.col("len"))).withColumn("qual", cut("qual", 1, F.col("len")))
    ns = F.length("seq") - F.length(F.translate("seq", "Nn", ""))
    bad = F.col("_s.low") | (F.col("ee") > how.max_ee) | ((F.col("len") > 0) & (F.col("ee") > how.max_ee_rate * F.col("len")))
    bad = bad | (F.col("len") < max(how.min_len, how.trunc_len or 0)) | (F.col("len") > how.max_len) | (ns > how.max_ns)
    bad = bad | (F.col("size") < how.min_size) | (F.col("size") > how.max_size)
    return rows.withColumn("discarded", bad).withColumn("truncated", F.col("len") < F.col("_old")).drop("_s", "_old", "_len")


def filter_reads(reads: DataFrame, how: Quality) -> tuple[DataFrame, DataFrame]:
    """Kept and discarded reads."""
    done = analyse(reads, how)
    return done.where(~F.col("discarded")), done.where("discarded")


def filter_pairs(forward: DataFrame, reverse: DataFrame, how: Quality) -> DataFrame:
    """Pairs of which neither read is discarded, by seqno."""
    a, b = analyse(forward, how), analyse(reverse, how)
    other = b.where(~F.col("discarded")).select("seqno", F.col("seq").alias("rev_seq"), F.col("qual").alias("rev_qual"), F.col("ee").alias("rev_ee"))
    return a.where(~F.col("discarded")).join(other, "seqno")


def by_label(reads: DataFrame, text: str, part: bool = False) -> DataFrame:
    """Reads whose label is ``text``, or contains it, whatever the case."""
    low = F.lower(C.label(F.col("header")))
    return reads.where(F.contains(low, F.lit(text.lower())) if part else low == text.lower())


def by_labels(reads: DataFrame, labels: DataFrame, keep: bool = True) -> DataFrame:
    """Reads whose label is, or isn't, in ``labels(label)``, whatever the case."""
    wanted = labels.select(F.lower("label").alias("_label")).where("_label is not null").distinct()
    return reads.join(wanted, F.lower(C.label(F.col("header"))) == F.col("_label"), "left_semi" if keep else "left_anti")


def by_word(reads: DataFrame, word: str, field: str | None = None) -> DataFrame:
    """Reads with a word in the label between other than letters and digits, or as the value of a field."""
    from re import escape

    return reads.where(F.rlike("header", F.lit(f"(?:^|;){escape(field)}={escape(word)}(?:;|$)" if field else f"(?:^|[^A-Za-z0-9]){escape(word)}(?:[^A-Za-z0-9]|$)")))


def window(reads: DataFrame, min_len: int = 1, max_len: int = 50000, min_size: int = 0, max_size: int = 2**62) -> DataFrame:
    return reads.where(F.length("seq").between(min_len, max_len) & F.col("size").between(min_size, max_size))


def sync_pairs(forward: DataFrame, reverse: DataFrame, separators: str = "/") -> DataFrame:
    """``(key, fwd, rev, state)``: pairs and orphans of two files by label without ``/1`` or ``/2``. A key that repeats on one side fails."""
    key = F.regexp_replace(C.label(F.col("header")), f"[{separators}][12]$", "")
    side = lambda x, name: x.select(key.alias("key"), F.col("header")).groupBy("key").agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a label repeats"))).otherwise(F.min("header")).alias(name))
    both = side(forward, "fwd").join(side(reverse, "rev"), "key", "full_outer")
    return both.withColumn("state", F.when(F.col("fwd").isNull(), "rev").when(F.col("rev").isNull(), "fwd").otherwise("pair"))
