"""Abundance tables, taxonomy and consensus."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import kernels as K


def otu_counts(hits: DataFrame, sample: F.Column, otu: F.Column) -> DataFrame:
    """``(otu, sample, n)`` with positive counts."""
    return hits.groupBy(otu.alias("otu"), sample.alias("sample")).agg(F.sum("q_size").alias("n")).where("n > 0 and otu is not null")


def sample_of(header: F.Column) -> F.Column:
    return F.coalesce(C.attribute(header, "(?:sample|barcodelabel)"), F.regexp_extract(header, "^[A-Za-z0-9_]*", 0))


def otu_of(header: F.Column) -> F.Column:
    return F.coalesce(C.attribute(header, "otu"), F.split(header, ";")[0])


def otu_table(counts: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """A column a sample; naming the samples saves a pass over the counts."""
    return counts.groupBy("otu").pivot("sample", samples).sum("n").fillna(0)


def biom(counts: DataFrame) -> DataFrame:
    """One row with the sparse table as JSON; rows and columns are numbered in name order."""
    rows, cols = (counts.select(c).distinct() for c in ("otu", "sample"))
    number = lambda x, c: x.withColumn("at", F.row_number().over(Window.orderBy(c)) - 1)
    r, s = number(rows, "otu"), number(cols, "sample")
    data = counts.join(r.withColumnRenamed("at", "i"), "otu").join(s.withColumnRenamed("at", "j"), "sample")
    names = lambda x, c: x.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", c))), lambda y: F.struct(y[c].alias("id"), F.lit(None).cast("string").alias("metadata"))).alias("v"))
    cells = data.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "n"))), lambda y: F.array(y.i.cast("long"), y.j.cast("long"), y.n)).alias("d"))
    whole = cells.crossJoin(names(r, "otu").withColumnRenamed("v", "r")).crossJoin(names(s, "sample").withColumnRenamed("v", "c"))
    return whole.select(F.to_json(F.struct(F.lit("Biological Observation Matrix 1.0").alias("format"), F.lit("OTU table").alias("type"), F.lit("sparse").alias("matrix_type"), F.lit("int").alias("matrix_element_type"), F.array(F.size("r"), F.size("c")).alias("shape"), F.col("r").alias("rows"), F.col("c").alias("columns"), F.col("d").alias("data"))).alias("biom"))


def lca(hits: DataFrame, cutoff: float = 1.0) -> DataFrame:
    """``(q, lineage)``: ranks on which enough of a query's hits agree, from the top down to the first that fails."""
    tax = hits.select("q", F.posexplode(F.array(*[F.struct(F.lit(r).alias("r"), C.taxonomy(F.col("t_header"))[r].alias("name")) for r in C.RANKS])).alias("level", "x")).select("q", "level", "x.r", "x.name")
    totals = hits.groupBy("q").agg(F.count(F.lit(1)).alias("of"))
    named = tax.where("name is not null").groupBy("q", "level", "r", "name").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("q", "level").orderBy(F.col("n").desc(), "name")
    top = named.withColumn("nth", F.row_number().over(best)).where("nth = 1").join(totals, "q").withColumn("ok", F.col("n") >= cutoff * F.col("of"))
    down = Window.partitionBy("q").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    held = top.withColumn("so_far", F.min(F.col("ok").cast("int")).over(down)).where("so_far = 1")
    lines = held.groupBy("q").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "r", "name"))), lambda x: F.concat(x["r"], F.lit(":"), x["name"])), ",").alias("lineage"))
    return totals.join(lines, "q", "left").select("q", F.coalesce("lineage", F.lit("")).alias("lineage"))


def profile(members: DataFrame) -> DataFrame:
    """``(cluster, at, symbol, n)`` over the centroid's columns, from ``(cluster, c_seq, seq, cigar, size)`` with cigars of member against centroid."""

    @F.udf("array<struct<at:int,symbol:string>>")
    def columns(seq: str, centroid: str, cigar: str):
        out, at = [], 0
        for a, b in zip(*K.rows_of(seq, centroid, cigar), strict=True):
            if b != "-":
                out.append((at, a.upper().replace("U", "T")))
                at += 1
        return out

    wide = members.select("cluster", "size", F.explode(columns("seq", "c_seq", "cigar")).alias("x"))
    return wide.groupBy("cluster", "x.at", "x.symbol").agg(F.sum("size").alias("n"))


def consensus(profile_rows: DataFrame) -> DataFrame:
    """``(cluster, seq)``: the most frequent of A, C, G, T in each column, N if there is only N, nothing where gaps are more."""
    count = lambda s: F.coalesce(F.sum(F.when(F.col("symbol") == s, F.col("n"))), F.lit(0))
    cols = profile_rows.groupBy("cluster", "at").agg(*[count(s).alias(s) for s in "ACGT"], count("N").alias("N"), count("-").alias("gap"))
    most = F.greatest("A", "C", "G", "T")
    pick = F.when(F.col("gap") > most, "").when(most == 0, F.when(F.col("N") > 0, "N").otherwise(""))
    for s in "ACGT":
        pick = pick.when(F.col(s) == most, s)
    return cols.withColumn("s", pick).groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda x: x.s), "").alias("seq"))


def msa(members: DataFrame) -> DataFrame:
    """``(cluster, seqno, row)``: a star alignment of each cluster, a cluster a group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        centroid = group["c_seq"].iloc[0]
        wide = [0] * (len(centroid) + 1)
        rows = []
        for seq, cigar in zip(group["seq"], group["cigar"], strict=True):
            slots, extra, at = [], [""] * (len(centroid) + 1), 0
            for a, b in zip(*K.rows_of(seq, centroid, cigar), strict=True):
                if b == "-":
                    extra[at] += a
                else:
                    slots.append(a)
                    at += 1
            wide = [max(w, len(x)) for w, x in zip(wide, extra, strict=True)]
            rows.append((slots, extra))
        text = ["".join(x.ljust(w, "-") + s for x, w, s in zip(extra, wide, [*slots, ""], strict=True)) for slots, extra in rows]
        return pd.DataFrame({"cluster": group["cluster"], "seqno": group["seqno"], "row": text})

    return members.groupBy("cluster").applyInPandas(run, "cluster long, seqno long, row string")


def sintax(queries: DataFrame, targets: DataFrame, k: int = 8, rounds: int = 100, draw: int = 32, seed: int = 1) -> DataFrame:
    """``(q, lineage)`` with the share of bootstraps that agree on each rank, names in brackets of confidence.

    Each bootstrap draws words with replacement by hash; it is answered by the
    target that has most of them (ties: shortest, then first), more than one at
    least. All bootstraps of all queries are one equality join on words.
    """
    from . import kmers

    words = kmers.postings(queries, k).groupBy("seqno").agg(F.sort_array(F.collect_list("word")).alias("words")).where(F.size("words") >= draw)
    pick = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(draw)), lambda i: F.element_at("words", (F.pmod(F.xxhash64(F.lit(seed), "seqno", "round", i), F.size("words")) + 1).cast("int")))))
    drawn = words.select(F.col("seqno"), "words", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).select(F.col("seqno").alias("q"), "round", pick.alias("word"))
    lens = targets.select(F.col("seqno").alias("t"), F.length("seq").alias("n"), "header")
    hits = drawn.join(kmers.postings(targets, k).withColumnRenamed("seqno", "t"), "word").groupBy("q", "round", "t").agg(F.count(F.lit(1)).alias("shared")).where("shared > 1")
    best = Window.partitionBy("q", "round").orderBy(F.col("shared").desc(), "n", "t")
    top = hits.join(lens, "t").withColumn("nth", F.row_number().over(best)).where("nth = 1")
    per = top.groupBy("q", C.attribute(F.col("header"), "tax").alias("tax")).agg(F.count(F.lit(1)).alias("n"))

    def vote(group: pd.DataFrame) -> pd.DataFrame:
        total = int(group["n"].sum())
        if total < rounds // 2:
            return pd.DataFrame({"q": [group["q"].iloc[0]], "lineage": [""]})
        left = [(dict(x.split(":", 1) for x in (tax or "").split(",") if ":" in x), n) for tax, n in sorted(zip(group["tax"].fillna(""), group["n"].tolist(), strict=True))]
        out = []
        for r in C.RANKS:
            counts = Counter()
            for names, n in left:
                if r in names:
                    counts[names[r]] += n
            if counts:
                name, n = max(sorted(counts.items()), key=lambda x: x[1])
                out.append(f"{r}:{name}({n / total:.2f})")
                left = [x for x in left if x[0].get(r) == name]
        return pd.DataFrame({"q": [group["q"].iloc[0]], "lineage": [",".join(out)]})

    found = per.groupBy("q").applyInPandas(vote, "q long, lineage string")
    return queries.select(F.col("seqno").alias("q")).join(found, "q", "left").select("q", F.coalesce("lineage", F.lit("")).alias("lineage"))
