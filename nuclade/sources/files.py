"""Sequence files as relations: FASTA, FASTQ, SFF, label lists and word indexes.

Text is read by Spark's own splittable readers, compressed or not. Order in the
file is the path, the block's offset and the place in the block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import kmers
from ..operators.transforms import numbered


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    rows = spark.read.text(path, lineSep=separator)
    rows = rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return numbered(rows, ["path", "block", "row"])


def fasta(spark: SparkSession, path: str, whole_labels: bool = False) -> DataFrame:
    """Reads of FASTA files; lines of a record are put together, blanks and tabs in sequences dropped."""
    rows = _records(spark, path, "\n>").withColumn("value", F.regexp_replace("value", "^>|\r", ""))
    rows = rows.where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.when(F.contains("value", F.lit("\n")), F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    header = head if whole_labels else C.label(head)
    return rows.select((F.col("nth") - 1).alias("seqno"), header.alias("header"), F.regexp_replace(body, r"[\s]", "").alias("seq")).select("seqno", "header", "seq", F.lit(None).cast("string").alias("qual"), C.abundance(F.col("header")).alias("size"), C.attribute(F.col("header"), "sample").alias("sample"))


def fastq(spark: SparkSession, path: str, whole_labels: bool = False) -> DataFrame:
    """Reads of FASTQ files with four lines a record; a record that isn't one fails the query."""
    lines = _records(spark, path, "\n").withColumn("value", F.regexp_replace("value", "\r$", "")).withColumn("record", F.floor((F.col("nth") - 1) / 4))
    part = lambda k: F.max(F.when(F.pmod(F.col("nth") - 1, F.lit(4)) == k, F.col("value")))
    rows = lines.groupBy("record").agg(part(0).alias("h"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual")).where(F.trim(F.concat_ws("", "h", "seq", "plus", "qual")) != "")
    good = F.startswith("h", F.lit("@")) & F.startswith("plus", F.lit("+")) & (F.length("seq") == F.length("qual")) & ((F.length("plus") == 1) | (F.substring("plus", 2, 1 << 20) == F.substring("h", 2, 1 << 20)))
    head = F.when(good, F.substring("h", 2, 1 << 20)).otherwise(F.raise_error(F.lit("not a FASTQ record")))
    header = head if whole_labels else C.label(head)
    return rows.select(F.col("record").cast("long").alias("seqno"), header.alias("header"), "seq", "qual").withColumn("size", C.abundance(F.col("header"))).withColumn("sample", C.attribute(F.col("header"), "sample"))


def reads(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or FASTQ, by the first symbol of the file."""
    first = spark.read.text(path).where("trim(value) <> ''").head()
    return fastq(spark, path) if first is not None and first.value.startswith("@") else fasta(spark, path)


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("label")).where("label <> ''")


def parse_sff(data: bytes, clip: bool = False) -> Iterator[tuple[str, str, str]]:
    """``(header, seq, qual)`` of the reads of an SFF file (big-endian, parts padded to eight bytes)."""
    magic, _, _, _, n, size, _, flows, _ = struct.unpack(">4sIQIIHHHB", data[:31])
    if magic != b".sff":
        raise ValueError("not an SFF file")
    pad = lambda x: -(-x // 8) * 8
    at = size
    for _ in range(n):
        head, name_len, bases, ql, qr, al, ar = struct.unpack(">HHIHHHH", data[at : at + 16])
        name = data[at + 16 : at + 16 + name_len].decode()
        body = at + head
        seq_at = body + 2 * flows + bases
        seq = data[seq_at : seq_at + bases].decode()
        qual = "".join(chr(33 + q) for q in data[seq_at + bases : seq_at + 2 * bases])
        left = max(1, ql, al) - 1
        right = min(qr or bases, ar or bases)
        if clip:
            seq, qual = seq[left:right], qual[left:right]
        else:
            seq = seq[:left].lower() + seq[left:right].upper() + seq[right:].lower()
        yield name, seq, qual
        at = body + pad(2 * flows + 3 * bases)


def sff(spark: SparkSession, path: str, clip: bool = False) -> DataFrame:
    """Reads of SFF files, a file a row of the binary reader."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(p, i, *x) for i, x in enumerate(parse_sff(bytes(data), clip))], columns=["path", "place", "header", "seq", "qual"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, place long, header string, seq string, qual string")
    return numbered(rows, ["path", "place"]).select((F.col("nth") - 1).alias("seqno"), "header", "seq", "qual", F.lit(1).cast("long").alias("size"), F.lit(None).cast("string").alias("sample"))


def write_index(reads_: DataFrame, path: str, k: int = 8, buckets: int = 64) -> None:
    """The word index of a database, next to its reads: postings are laid out by word."""
    reads_.write.mode("overwrite").parquet(f"{path}/reads")
    kmers.postings(reads_, k).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("word").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/words_k={k}")


def read_index(spark: SparkSession, path: str, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """``(reads, postings)`` of :func:`write_index`."""
    return spark.read.parquet(f"{path}/reads"), spark.read.parquet(f"{path}/words_k={k}").select("seqno", "word")


def index_info(spark: SparkSession, path: str, k: int = 8) -> DataFrame:
    rows, words = read_index(spark, path, k)
    return rows.agg(F.count(F.lit(1)).alias("sequences"), F.sum(F.length("seq")).alias("nucleotides")).crossJoin(words.agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("word").alias("words"))).withColumn("word_length", F.lit(k))


# -------------------------------------------------------------------- writing


def annotated(rows: DataFrame, *names: str) -> F.Column:
    """A header with attributes from columns, in the fixed order of the format."""
    order = ["label_suffix", "sample", "seqs", "clusterid", "size", "centroid_size", "ee", "length"]
    base = C.without(F.col("header"), *[n for n in names if n in order])
    parts = [base]
    for n in order:
        if n in names:
            value = F.length("seq").cast("string") if n == "length" else ee_text(F.col("ee")) if n == "ee" else F.col(n).cast("string")
            parts.append(value if n == "label_suffix" else F.concat(F.lit(f"{n}="), value))
    return F.array_join(F.array(*parts), ";")


def ee_text(ee: F.Column) -> F.Column:
    """An expected error with more digits the smaller it is."""
    text = F.format_string("%.4f", ee)
    for digits in range(5, 14):
        text = F.when(ee < 10.0 ** (4 - digits), F.format_string(f"%.{digits}f", ee)).otherwise(text)
    return text


def fasta_text(rows: DataFrame, width: int = 80) -> DataFrame:
    """``value``: a FASTA record a row; sequences are wrapped."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n") if width else F.col("seq")
    return rows.select(F.concat(F.lit(">"), "header", F.lit("\n"), body).alias("value"))


def fastq_text(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(F.lit("@"), "header", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def write_text(text: DataFrame, path: str) -> None:
    text.write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated columns without a header, as reports are."""
    rows.write.mode("overwrite").csv(path, sep="\t", quote="", emptyValue="", nullValue="*")


def write_clusters(rows: DataFrame, path: str) -> None:
    """A folder of FASTA text for each cluster."""
    rows.select("cluster", F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value")).repartition("cluster").write.mode("overwrite").partitionBy("cluster").text(path)
