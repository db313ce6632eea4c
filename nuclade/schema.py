"""The relations of the library, and the adapter that makes reads of a corpus.

A read is a row ``(seqno, header, seq, qual, size, sample)``; ``seqno`` is the
final tie of every order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters to nucleotides, and hexadecimal digits to quality symbols Q4 to Q41.
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"
DIGITS, SYMBOLS = "0123456789abcdef", "%(+.147:=@CFGHIJ"

#: Nucleotides of a read at most, and the seqno of a text's first read by its id.
LONGEST, ITEM = 250, 100_000_000
READ = "seqno long, header string, seq string, qual string, size long, sample string"


def reads_of(table: DataFrame, key: str, sample: str | None, prefix: str) -> DataFrame:
    """Every line of every text as reads of ``LONGEST`` nucleotides at most.

    A line's letters are mapped to nucleotides, its digest and the read's number
    to qualities; the whole text is used.
    """
    lines = table.select(F.col(key).alias("id"), (F.col(sample) if sample else F.lit(None).cast("string")).alias("sample"), F.posexplode(F.split("text", "\n")).alias("line", "words"))
    seq = F.upper(F.translate(F.regexp_replace(F.lower("words"), "[^a-z]", ""), LETTERS, BASES))
    rows = lines.select("id", "line", "sample", "words", F.posexplode(F.regexp_extract_all(seq, F.lit(f".{{1,{LONGEST}}}"), 0)).alias("piece", "seq"))
    number = lambda *x: F.concat_ws(".", *[F.col(c).cast("string") for c in x])
    rows = rows.withColumn("digest", F.md5(F.concat("words", F.lit("#"), F.col("piece").cast("string"))))
    return rows.select(
        (F.col("id") * ITEM + F.col("line") * 1000 + F.col("piece")).alias("seqno"),
        F.concat(F.lit(prefix), number("id", "line", "piece"), F.lit(";size="), (1 + F.col("id") % 7).cast("string")).alias("header"),
        "seq",
        F.expr(f"substring(translate(repeat(digest, cast(length(seq) div 32 as int) + 1), '{DIGITS}', '{SYMBOLS}'), 1, length(seq))").alias("qual"),
        (1 + F.col("id") % 7).cast("long").alias("size"),
        "sample",
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", "d")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", None, "b")
