"""Text reports over the hits of a search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import kernels as K
from ..operators import search


@F.pandas_udf(StringType())
def _drawn(q: pd.Series, t: pd.Series, cigar: pd.Series) -> pd.Series:
    """Rows of 64 columns: query, marks of equal and of compatible symbols, target."""

    def one(x: str, y: str, c: str) -> str:
        a, b = K.rows_of(x, y, c)
        marks = "".join("|" if u == v else "+" if u != "-" and v != "-" and K._CODE[ord(u)] & K._CODE[ord(v)] else " " for u, v in zip(a, b, strict=True))
        out, i, j = [], 0, 0
        for k in range(0, len(a), 64):
            u, v = a[k : k + 64], b[k : k + 64]
            ni, nj = i + len(u.replace("-", "")), j + len(v.replace("-", ""))
            out.append(f"Qry {i + 1:>6} + {u} {ni}\n{'':13}{marks[k : k + 64]}\nTgt {j + 1:>6} + {v} {nj}")
            i, j = ni, nj
        return "\n\n".join(out)

    return pd.Series([one(*x) for x in zip(q, t, cigar, strict=True)])


def alignments(hits: DataFrame) -> DataFrame:
    """``(q, hit, value)``: each hit with its aligned rows and a summary."""
    gaps = F.format_string("%d cols, %d ids (%.1f%%), %d gaps", "int_alnlen", "matches", "id", "int_indels")
    return hits.select("q", "hit", F.concat(F.lit("Query >"), "q_header", F.lit("\nTarget >"), "t_header", F.lit("\n\n"), _drawn("q_seq", "t_seq", "cigar"), F.lit("\n\n"), gaps).alias("value"))


def sam_header(targets: DataFrame) -> DataFrame:
    """``@SQ`` lines with the length and the digest of each target."""
    return targets.select(F.format_string("@SQ\tSN:%s\tLN:%d\tM5:%s", "header", F.length("seq"), F.md5(F.upper("seq"))).alias("value"))


def fasta_pairs(hits: DataFrame) -> DataFrame:
    """Aligned query and target of each hit as two records."""
    one = F.concat(F.lit(">"), "q_header", F.lit("\n"), search.row("q"), F.lit("\n>"), "t_header", F.lit("\n"), search.row("t"), F.lit("\n"))
    return hits.select(one.alias("value"))


def segments(hits: DataFrame, which: str = "q") -> DataFrame:
    """The part of the query or of the target that is aligned, without the gaps at the ends."""
    left, right = F.col(f"trim_{which}_left"), F.col(f"trim_{which}_right")
    seq = F.substring(f"{which}_seq", left + 1, F.col(f"{which}_len") - left - right)
    return hits.select(F.col(f"{which}_header").alias("header"), seq.alias("seq"))


def mothur(table: DataFrame, label: str = "userLabel") -> DataFrame:
    """A line a sample, from ``(otu, sample, n)``: label, group, number of OTUs, counts in OTU order."""
    otus = table.select("otu").distinct().withColumn("at", F.row_number().over(Window.orderBy("otu")))
    every = table.select("sample").distinct().crossJoin(F.broadcast(otus)).join(table, ["sample", "otu"], "left").fillna(0, ["n"])
    counts = F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"].cast("string"))
    return every.groupBy("sample").agg(F.concat_ws("\t", F.lit(label), F.first("sample"), F.count(F.lit(1)).cast("string"), F.array_join(counts, "\t")).alias("value"))


def lca_lines(lineages: DataFrame, queries: DataFrame) -> DataFrame:
    return lineages.join(queries.select(F.col("seqno").alias("q"), "header"), "q").select(F.concat_ws("\t", "header", "lineage").alias("value"))
