"""Tables in the folder that driver and executors share, to cut lineage between the rounds of ordered operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where none is set and all is one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = getattr(folder, "own", None) or tempfile.mkdtemp(prefix="nuclade-")
        folder.own = path
    return path.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """``df`` written as a table and read back; a lost executor costs nothing after that."""
    path = f"{folder(df.sparkSession)}/nuclade-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.nuclade_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table of :func:`keep` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.nuclade_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
