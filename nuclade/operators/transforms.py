"""Row-wise operators: each keeps its input's rows and order keys, and shuffles nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from .shared import keep


def revcomp(reads: DataFrame, suffix: str = "") -> DataFrame:
    """Reverse complements with reversed qualities."""
    out = reads.withColumn("seq", C.reverse_complement(F.col("seq"))).withColumn("header", F.concat("header", F.lit(suffix)))
    return out.withColumn("qual", F.reverse("qual")) if "qual" in reads.columns else out


def subseq(reads: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """Positions ``start`` to ``end``, from 1 and both included, clamped to the sequence."""
    a = max(1, start)
    stop = F.length("seq") if end is None else F.least(F.lit(end), F.length("seq"))
    cut = lambda c: F.substring(c, F.lit(a), F.greatest(stop - a + 1, F.lit(0)))
    out = reads.withColumn("qual", cut("qual")) if "qual" in reads.columns else reads
    return out.withColumn("seq", cut("seq"))


def convert(reads: DataFrame, ascii_in: int = 33, ascii_out: int = 64, qmin: int = 0, qmax: int = 41, qmin_out: int = 0, qmax_out: int = 41) -> DataFrame:
    """Re-coded qualities, as one character table; a symbol outside ``qmin..qmax`` fails the query."""
    inside = [chr(q + ascii_in) for q in range(qmin, qmax + 1)]
    to = [chr(min(126, max(33, min(qmax_out, max(qmin_out, q)) + ascii_out))) for q in range(qmin, qmax + 1)]
    every = "".join(inside)
    wrong = F.length(F.translate("qual", every, "")) > 0
    moved = F.translate("qual", every, "".join(to))
    return reads.withColumn("qual", F.when(wrong, F.raise_error(F.lit("quality outside qmin..qmax"))).otherwise(moved))


def fasta_to_fastq(reads: DataFrame, ascii_out: int = 33, qmax_out: int = 41) -> DataFrame:
    return reads.withColumn("qual", F.expr(f"repeat(chr({ascii_out + qmax_out}), length(seq))"))


def hardmask(reads: DataFrame) -> DataFrame:
    """Lower case, which marks masked symbols, becomes N."""
    return reads.withColumn("seq", F.regexp_replace("seq", "[a-z]", "N"))


def unmasked(reads: DataFrame, least: float = 0.0, most: float = 100.0) -> DataFrame:
    """Reads whose percentage of upper-case symbols is within bounds."""
    share = 100.0 * F.length(F.regexp_replace("seq", "[^A-Z]", "")) / F.length("seq")
    return reads.withColumn("unmasked", share).where(F.col("unmasked").between(least, most))


def join_pairs(forward: DataFrame, reverse: DataFrame, pad: str = "NNNNNNNN", pad_q: str = "IIIIIIII") -> DataFrame:
    """Forward reads, a gap, and reverse complements, paired by seqno."""
    other = reverse.select("seqno", C.reverse_complement(F.col("seq")).alias("seq2"), F.reverse("qual").alias("qual2"))
    both = forward.join(other, "seqno")
    return both.select("seqno", "header", F.concat("seq", F.lit(pad), "seq2").alias("seq"), F.concat("qual", F.lit(pad_q), "qual2").alias("qual"))


def relabel(reads: DataFrame, how: str = "prefix", prefix: str = "seq", suffix: str = "") -> DataFrame:
    """New labels: ``md5`` or ``sha1`` of the normalised sequence, ``self``, or a prefix and the place in seqno order.

    Digests and ``self`` need no order. Places are offsets of ranges of seqno plus
    ranks within a range, so no task sees more than one range.
    """
    fixed = {"md5": F.md5(C.normalised(F.col("seq"))), "sha1": F.sha1(C.normalised(F.col("seq"))), "self": F.col("seq")}
    if how in fixed:
        return reads.withColumn("header", F.concat(fixed[how], F.lit(suffix)))
    return numbered(reads, ["seqno"]).withColumn("header", F.concat(F.lit(prefix), F.col("nth").cast("string"), F.lit(suffix))).drop("nth")


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """Rows with their place ``nth``, from 1, in a global order, by a range sort and counts of its partitions.

    The sorted rows are a table in the shared folder, so that the counts and the
    rows see the same partitions, also after an executor is lost.
    """
    placed = keep(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_first", "_before")
    return placed.join(F.broadcast(starts), "_part").withColumn("nth", F.col("_id") - F.col("_first") + F.col("_before") + 1).drop("_part", "_id", "_first", "_before")


def strip_attributes(reads: DataFrame, *keys: str) -> DataFrame:
    return reads.withColumn("header", C.without(F.col("header"), *(keys or ("size", "ee", "length"))))


def rereplicate(reads: DataFrame) -> DataFrame:
    """Each read as often as its abundance, with abundance 1."""
    copies = F.explode(F.expr("sequence(1, cast(size as int))"))
    return reads.where("size > 0").withColumn("copy", copies).drop("copy").withColumn("size", F.lit(1).cast("long")).withColumn("header", C.without(F.col("header"), "size"))


def cut(reads: DataFrame, pattern: str = "G^AATT_C") -> DataFrame:
    """Fragments ``(seqno, part, strand, seq)`` between the sites of a restriction pattern; reads without a site give none.

    ``^`` and ``_`` mark the cuts of the forward and the reverse strand. A cut is a
    place between what comes before and after it in the pattern, so sites may
    overlap and one pass of a regular expression finds them all.
    """
    bits = lambda x: [s for s, b in C.IUPAC.items() if b & C.IUPAC[x.upper()]]
    regex = lambda part: "".join(f"[{''.join(bits(x))}]" for x in part)

    def fragments(mark: str, other: str, strand: int) -> DataFrame:
        before, after = pattern.replace(other, "").split(mark)
        parts = F.split(F.regexp_replace("seq", f"(?i)(?<={regex(before)})(?={regex(after)})", "|"), r"\|")
        out = reads.select("seqno", parts.alias("parts")).where(F.size("parts") > 1).select("seqno", F.posexplode("parts").alias("part", "seq"))
        out = out.select("seqno", "part", F.lit(strand).alias("strand"), C.reverse_complement(F.col("seq")).alias("seq") if strand else F.col("seq"))
        return out.where(F.length("seq") > 0)

    return fragments("^", "_", 0).union(fragments("_", "^", 1))
