"""The corpus pipeline: stages of the training-data operators over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nuclade.llm.common import keep, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, predicts to be toxic go."""
    from nuclade.llm.toxicity import score, train

    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8) stays: the smallest doc_id.

    Rows of one id are one document: if it stays, each of its different texts
    stays once. Rows without an id are no copies of one another and all stay.
    """
    from nuclade.llm.minhash import MinHash, near_duplicates

    kept = near_duplicates(docs, MinHash()).where("kept and doc_id is not null").select("doc_id").distinct()
    one_each = docs.join(kept, "doc_id", "left_semi").withColumn("th", F.xxhash64("text")).dropDuplicates(["doc_id", "th"])
    return one_each.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a passage of 200 bytes that is also elsewhere goes; all documents stay, with their new lengths."""
    from nuclade.llm.suffixdedup import remove_repeats

    left = remove_repeats(docs, carry=["lang", "source"])
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of ``op1``: a row taken twice is two rows; one that isn't taken goes, as do texts without words.

    Rows that are equal in all columns are one with the sum of their times. A
    row without an id is taken like any other.
    """
    from nuclade.llm.mixing import mix

    # Null ids are 0 in the key, and told apart by the hash.
    key = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(*COLUMNS, F.col("doc_id").isNull()).alias("row")]
    docs = docs.select(*COLUMNS, *key)
    taken = mix(docs, carry=["id", "row"]).where("repeats > 0").groupBy("id", "row").agg(F.sum("repeats").cast("int").alias("times"))
    once = docs.dropDuplicates(["id", "row"])
    return once.join(taken, ["id", "row"]).withColumn("copy", F.explode(F.expr("sequence(1, times)"))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation of each text, with the scores of the four best."""
    from nuclade.llm.pieces import Vocabulary, encode

    return encode(docs, Vocabulary.load())


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeats),
    ("mixing", mixture),
    ("sentencepiece", pieces),
]
#: Flows, hash sketches, suffix arrays and learned weights have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
