"""Proportional stratified interleaving of documents into shards.

Rows are ranked in a seeded shuffle within their source; the rank's fraction of
the source is a place on a line that all sources share; the line is cut into
equal counts. Every stretch of it has each source in its own proportion, so each
shard matches the mixture to one row a source.

Scale: only (id, size, crc, digest) rows are shuffled, twice, never the text. A
rank is a bucket's offset plus a rank within the bucket, so neither a source
with a third of the rows nor the whole table is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hex_bucket, keep, n_bytes, rank_within, seeded

#: Hex digits of a bucket: 4096 buckets of each source and of the line.
DIGITS = 3
#: Copies of a row that one task makes from their count.
COPIES = 1 << 16


def _numbered(rows: DataFrame) -> DataFrame:
    """Equal rows told apart by ``copy``, so that they too get places all over the line.

    They are counted, with partial sums, and made again from their counts, a
    bounded number in one task.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.select(*columns, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("from"))
    apart = blocks.where(f"n > {COPIES}").repartition("doc_id", "text_crc32", "from").unionByName(blocks.where(f"n <= {COPIES}"))
    return apart.select(*columns, F.explode(F.sequence("from", F.least(F.col("from") + COPIES, F.col("n")) - 1)).alias("copy"))


def interleave(docs: DataFrame, shards: int = 16, seed: int = 11) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of each row of ``docs(doc_id, text, source)``.

    The law is ``rows``: shards differ by one row at most. Slots run from 0
    without gaps. A null source is a source of its own; a null text has size 1
    and a null crc; rows that repeat an id or a text are placed as rows of their
    own, in an order set by their content; an empty table gives no rows. Other
    columns are ignored. ``grown_shard`` is null, as this law moves rows when the
    number of shards changes.
    """
    rows = docs.select(
        "doc_id",
        n_bytes(F.col("text")).alias("bytes"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("stratum"),
    )
    rows = keep(_numbered(rows).withColumn("digest", seeded(seed, F.col("doc_id"), F.col("text_crc32"), F.col("copy"))).drop("copy"))
    ties = [F.col("digest"), F.col("doc_id"), F.col("text_crc32"), F.col("bytes")]
    rows = rows.withColumn("part", hex_bucket(F.col("digest"), DIGITS))
    rows = rank_within(rows, ["stratum"], "part", ties, "nth")
    totals = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("of"))
    placed = rows.join(totals, "stratum").withColumn("at", (F.col("nth") + 0.5) / F.col("of"))
    placed = keep(placed.drop("part", "nth", "of").withColumn("cell", F.floor(F.col("at") * 16**DIGITS)))
    line = rank_within(placed, [], "cell", [F.col("at"), F.col("stratum"), *ties], "place")
    n = placed.count()
    shard = F.floor(F.col("place") * shards / F.lit(max(n, 1)).cast("decimal(20,0)")).cast("int")
    first = F.ceil(F.col("shard").cast("decimal(20,0)") * n / shards).cast("long")
    return line.withColumn("shard", shard).select(
        "doc_id",
        (F.col("bytes") + 1).alias("size"),
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
