"""Kernels as SQL functions and table functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import kernels as K


class Words:
    """``seq_words(seq, k)``: distinct unambiguous words."""

    def eval(self, seq: str, k: int):
        for word in dict.fromkeys(seq[i : i + k] for i in range(len(seq) - k + 1)):
            if not set(word) - set("ACGTU"):
                yield (word,)


class Fragments:
    """``seq_cut(seq, site, at)``: fragments between the sites, cut ``at`` symbols into each."""

    def eval(self, seq: str, site: str, at: int):
        if not site:
            return
        cuts = [i + at for i in range(len(seq) - len(site) + 1) if seq.startswith(site, i)]
        for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(seq)], strict=True)):
            yield (n, seq[a:b])


def register(spark: SparkSession) -> None:
    """``dust``, ``revcomp``, ``align_cigar`` and ``align_id``, and the table functions ``seq_words`` and ``seq_cut``."""
    spark.udf.register("dust", lambda s: None if s is None else K.dust(s), "string")
    spark.udf.register("revcomp", lambda s: None if s is None else K.reverse_complement(s), "string")
    spark.udf.register("align_cigar", lambda a, b: None if a is None or b is None else K.align([a], [b])[0]["cigar"], "string")
    spark.udf.register("align_id", lambda a, b: None if a is None or b is None else float(K.align([a], [b])[0]["id2"]), "double")
    spark.udtf.register("seq_words", udtf(Words, returnType="word string"))
    spark.udtf.register("seq_cut", udtf(Fragments, returnType="part int, seq string"))
