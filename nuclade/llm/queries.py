"""The queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .annsearch import search_every

    return search_every(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import captures, entries, evaluate

    return evaluate(captures(table(spark, sf_dir, "pages")), entries(spark))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import interleave

    return interleave(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embdedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import Vocabulary, encode

    return encode(table(spark, sf_dir, "documents"), Vocabulary.load(), with_paths=True)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import MinHash, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), MinHash(words=4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import licenses, urlfilter

    return {"op3_url_filter": urlfilter.oracle(), "op10_license_scan": licenses.oracle()}
