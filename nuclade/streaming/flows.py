"""The operators that make sense over unbounded input, as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import filters


def read_stream(spark: SparkSession, path: str, schema: str, files_each: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def derep(stream: DataFrame) -> DataFrame:
    """Running abundances by sequence, for update or complete mode; state is a row a distinct sequence."""
    return stream.groupBy(C.normalised(F.col("seq")).alias("seq")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("members"), F.min(F.struct("seqno", "header"))["header"].alias("header"))


def quality_filter(stream: DataFrame, how: filters.Quality) -> DataFrame:
    """Kept reads; works row by row and has no state."""
    return filters.analyse(stream, how).where("not discarded")


def matched(stream: DataFrame, targets: DataFrame) -> DataFrame:
    """Reads equal to a target: a stream-static join."""
    return stream.withColumn("key", C.normalised(F.col("seq"))).join(targets.select(C.normalised(F.col("seq")).alias("key"), F.col("seqno").alias("t")), "key").drop("key")


def rollup(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by window and type; windows close after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
