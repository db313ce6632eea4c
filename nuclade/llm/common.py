"""What the training-data operators share: tables, cut lineage, ranking without one large task."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set and all is one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = getattr(shared_dir, "own", None)
        if folder is None:
            folder = shared_dir.own = tempfile.mkdtemp(prefix="nuclade-")
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    Lost executors cost nothing, as every later read finds the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nuclade-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.nuclade_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table of :func:`keep` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.nuclade_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if found := getattr(ctypes.CDLL(None), "malloc_trim", None):
        found(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker keeps nothing: workers stay for later stages, and count beside the executor's heap."""

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return all_


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def seeded(seed: int, *cols: Column) -> Column:
    """32 hex digits that depend on the seed and the columns only."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts))


def hex_bucket(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


def rank_within(df: DataFrame, keys: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """0-based rank of each row within ``keys``, ordered by ``bucket`` and then ``order``.

    ``bucket`` must be monotone in the order. Only one bucket of one key is ever
    sorted together, so a key that holds a third of all rows is spread over its
    buckets; what crosses buckets is a table of counts.
    """
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    if not keys:
        before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    ranked = df.withColumn("_inner", F.row_number().over(inner))
    return (
        ranked.join(counts, [*keys, bucket])
        .withColumn(out, F.col("_before") + F.col("_inner") - 1)
        .drop("_inner", "_before")
    )
