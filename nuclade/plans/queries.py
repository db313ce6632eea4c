"""Queries over the driver's tables: each operator applied to whole tables of reads.

Reads are all lines of ``documents`` in pieces, and references those of ``benchmark``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import chimera, cluster, derep, filters, kmers, order, quality, search, tables, transforms
from ..schema import ITEM, reads, refs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LABELS = ["d1.0.0;size=2", "D2.0.0;SIZE=3", "d10.1.0;size=4"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first and the reversed last six tenths of each read."""
    n = F.ceil(F.length("seq") * 0.6).cast("int")
    forward = rows.withColumn("qual", F.substring("qual", F.lit(1), n)).withColumn("seq", F.substring("seq", F.lit(1), n))
    reverse = rows.withColumn("qual", F.reverse(F.right("qual", n))).withColumn("seq", C.reverse_complement(F.right("seq", n)))
    return forward, reverse


def tax(rows: DataFrame) -> DataFrame:
    """References with a taxonomy from their number."""
    i = F.floor(F.col("seqno") / ITEM)
    name = lambda r, m: F.concat(F.lit(f"{r}:{r}"), (i % m).cast("string"))
    return rows.withColumn("header", F.concat("header", F.lit(";tax="), F.array_join(F.array(name("d", 2), name("p", 4), name("g", 8), name("s", 64)), ",")))


def long_enough(rows: DataFrame) -> DataFrame:
    return filters.window(rows, 32)


# ------------------------------------------------------------- dereplication


@query
def derep_fulllength(spark, d):
    return derep.fulllength(long_enough(reads(spark, d)))


@query
def derep_fulllength_both(spark, d):
    return derep.fulllength(long_enough(reads(spark, d)), both_strands=True)


@query
def derep_fulllength_minsize(spark, d):
    return derep.fulllength(long_enough(reads(spark, d)), sizein=False, min_size=2).select("seqno", "size")


@query
def derep_id(spark, d):
    return derep.by_id(long_enough(reads(spark, d)))


@query
def derep_smallmem(spark, d):
    return derep.fulllength(reads(spark, d)).select("seqno", "seq", "size").orderBy("seqno")


@query
def derep_prefix(spark, d):
    return derep.prefix(reads(spark, d)).select("seqno", "size", "members")


@query
def derep_stats(spark, d):
    return derep.stats(derep.fulllength(long_enough(reads(spark, d))))


@query
def fastx_uniques(spark, d):
    return derep.uniques_quality(reads(spark, d))


@query
def fastx_uniques_best(spark, d):
    return derep.uniques_quality(reads(spark, d), keep_best=True)


# --------------------------------------------------------------------- order


@query
def sortbysize_top(spark, d):
    return order.by_size(derep.fulllength(long_enough(reads(spark, d))), top=100).select("seqno", "size")


@query
def sortbylength_top(spark, d):
    return order.by_length(reads(spark, d), top=100).select("seqno", F.length("seq").alias("len"), "size")


@query
def shuffle(spark, d):
    return order.shuffle(reads(spark, d)).select("seqno")


@query
def fastx_subsample(spark, d):
    return order.subsample(reads(spark, d), percent=10.0).select("seqno", "size", "drawn")


@query
def fastx_subsample_total(spark, d):
    drawn = order.subsample(reads(spark, d), percent=10.0)
    return drawn.agg(F.sum("drawn").alias("drawn"), F.count(F.when(F.col("drawn") > F.col("size"), 1)).alias("above"), F.count(F.lit(1)).alias("reads"))


@query
def rereplicate(spark, d):
    return transforms.rereplicate(reads(spark, d)).groupBy("seqno", "header", "size").agg(F.count(F.lit(1)).alias("copies"))


# ----------------------------------------------------------------- transforms


@query
def fastx_revcomp(spark, d):
    return transforms.revcomp(reads(spark, d), "_rc").select("seqno", "header", "seq", "qual")


@query
def fastx_getsubseq(spark, d):
    return transforms.subseq(reads(spark, d), 11, 60).select("seqno", "seq", "qual")


@query
def fastq_convert(spark, d):
    return transforms.convert(reads(spark, d), qmin_out=5, qmax_out=38).select("seqno", "qual")


@query
def fasta2fastq(spark, d):
    return transforms.fasta_to_fastq(reads(spark, d)).select("seqno", "qual")


@query
def maskfasta_dust(spark, d):
    return kmers.masked(reads(spark, d)).select("seqno", "seq")


@query
def maskfasta_soft(spark, d):
    return kmers.masked(soft(reads(spark, d)), "soft", hard=True).select("seqno", "seq")


@query
def search_exact_tests(spark, d):
    """Hits of equal sequences that also pass tests of sizes and labels."""
    own = search.exact(refs(spark, d), reads(spark, d)).join(search.side(refs(spark, d), "q"), "q").join(search.side(reads(spark, d), "t"), "t")
    for test in search.unaligned_tests(max_q_size=5, min_t_size=2, min_size_ratio=0.5, max_size_ratio=2.0, min_qt=0.9, max_sl=1.0, id_prefix=8, id_suffix=8, self_=True):
        own = own.where(test)
    return own.select("q", "t")


def soft(rows: DataFrame) -> DataFrame:
    """Reads whose runs of four or more equal symbols are in lower case."""
    runs = F.regexp_extract_all("seq", F.lit(r"((.)\2*)"), 1)
    return rows.withColumn("seq", F.array_join(F.transform(runs, lambda x: F.when(F.length(x) >= 3, F.lower(x)).otherwise(x)), ""))


@query
def fastx_mask_hard(spark, d):
    return transforms.hardmask(soft(reads(spark, d))).select("seqno", "seq")


@query
def fastx_mask_unmasked(spark, d):
    return transforms.unmasked(soft(reads(spark, d)), 80.0, 99.0).select("seqno", "unmasked")


@query
def fastq_join(spark, d):
    return transforms.join_pairs(*pairs(reads(spark, d))).select("seqno", "seq", "qual")


@query
def relabel_md5(spark, d):
    return transforms.relabel(reads(spark, d), "md5").select("seqno", "header")


@query
def relabel_prefix(spark, d):
    return transforms.relabel(reads(spark, d), prefix="r").select("seqno", "header")


@query
def xsize(spark, d):
    return transforms.strip_attributes(reads(spark, d), "size").select("seqno", "header")


@query
def cut_ecori(spark, d):
    return transforms.cut(reads(spark, d), "G^RC_").select("seqno", "part", "strand", "seq")


# -------------------------------------------------------------------- filters

STRICT = filters.Quality(strip_left=3, strip_right=2, trunc_qual=4, max_ee=2.0, min_len=20, max_ns=0)


@query
def fastq_filter(spark, d):
    return filters.filter_reads(reads(spark, d), STRICT)[0].select("seqno", "seq", F.round("ee", 6).alias("ee"))


@query
def fastq_filter_discarded(spark, d):
    return filters.filter_reads(reads(spark, d), STRICT)[1].select("seqno")


@query
def fastq_filter_truncee(spark, d):
    done = filters.analyse(reads(spark, d), filters.Quality(trunc_ee=1.0, trunc_len_keep=80, max_ee_rate=0.05))
    return done.select("seqno", "len", F.round("ee", 6).alias("ee"), "discarded", "truncated")


@query
def fastq_filter_pairs(spark, d):
    return filters.filter_pairs(*pairs(reads(spark, d)), filters.Quality(max_ee=1.0)).select("seqno", "seq", "rev_seq")


@query
def fastx_getseq(spark, d):
    return filters.by_label(reads(spark, d), "D1", part=True).select("seqno", "header")


@query
def fastx_getseqs(spark, d):
    labels = spark.createDataFrame([(x,) for x in LABELS], "label string")
    return filters.by_labels(reads(spark, d), labels).select("seqno", "header")


@query
def fastx_getseqs_not(spark, d):
    labels = spark.createDataFrame([(x,) for x in LABELS], "label string")
    return filters.by_labels(reads(spark, d), labels, keep=False).select("seqno")


@query
def fastx_getseqs_word(spark, d):
    return filters.by_word(reads(spark, d), "3", "size").select("seqno")


@query
def length_window(spark, d):
    return filters.window(reads(spark, d), 50, 200, 2, 5).select("seqno")


@query
def fastx_syncpairs(spark, d):
    rows = reads(spark, d)
    forward = rows.withColumn("header", F.concat("header", F.lit("/1"))).where("size <> 3")
    reverse = rows.withColumn("header", F.concat("header", F.lit("/2"))).where("size <> 5")
    return filters.sync_pairs(forward, reverse)


# -------------------------------------------------------------------- quality


@query
def fastq_chars(spark, d):
    return quality.chars(reads(spark, d))


@query
def fastq_chars_tails(spark, d):
    return quality.tails(reads(spark, d))


@query
def fastq_chars_symbols(spark, d):
    return quality.symbols(reads(spark, d))


@query
def fastq_stats_lengths(spark, d):
    return quality.lengths(reads(spark, d))


@query
def fastq_stats_scores(spark, d):
    return quality.score_counts(reads(spark, d))


@query
def fastq_stats_positions(spark, d):
    return quality.by_position(reads(spark, d)).select("pos", "recs", *[F.round(c, 6).alias(c) for c in ("avg_q", "avg_p", "avg_ee")])


@query
def fastq_stats_errors(spark, d):
    return quality.kept_by_error(reads(spark, d))


@query
def fastq_stats_minq(spark, d):
    return quality.kept_by_quality(reads(spark, d))


@query
def fastq_eestats(spark, d):
    out = quality.eestats(reads(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if c.startswith(("pe", "ee", "q_mean")) else F.col(c) for c in out.columns])


@query
def fastq_eestats2(spark, d):
    return quality.eestats2(reads(spark, d))


@query
def db_stats(spark, d):
    return quality.db_stats(reads(spark, d))


# ---------------------------------------------------------------------- words


@query
def kmers_distinct(spark, d):
    return kmers.postings(refs(spark, d)).groupBy("seqno").agg(F.count(F.lit(1)).alias("words"))


@query
def shared_kmers(spark, d):
    return kmers.shared(refs(spark, d), long_enough(reads(spark, d)), least=12).where("shared >= 12").drop("t_len")


@query
def usearch_candidates(spark, d):
    how = search.Search(mask="none")
    return search.candidates(refs(spark, d), derep.fulllength(long_enough(reads(spark, d))), how).select("q", "t", "shared", "rank")


@query
def udbstats(spark, d):
    return kmers.index_stats(reads(spark, d))


@query
def udbstats_top(spark, d):
    return kmers.top_words(reads(spark, d))


@query
def orient(spark, d):
    mixed = reads(spark, d).withColumn("seq", F.when(F.col("size") % 3 == 0, C.reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    return kmers.orient(mixed, refs(spark, d)).select("seqno", "forward", "reverse", "strand")


# --------------------------------------------------------------------- search


def found(spark, d, **more) -> DataFrame:
    """Hits of the lines of ``benchmark`` among the distinct lines of ``documents``."""
    return search.globally(refs(spark, d), derep.fulllength(long_enough(reads(spark, d))), search.Search(id=0.9, max_accepts=4, **more))


@query
def search_exact(spark, d):
    return search.exact(refs(spark, d), reads(spark, d)).select("q", "t", "strand", "cigar", "id")


@query
def search_exact_both(spark, d):
    turned = transforms.revcomp(refs(spark, d))
    return search.exact(turned, reads(spark, d), both_strands=True).select("q", "t", "strand")


@query
def search_notmatched(spark, d):
    return search.matched(refs(spark, d), search.exact(refs(spark, d), reads(spark, d)), keep=False).select("seqno")


@query
def search_dbmatched(spark, d):
    own = reads(spark, d)
    hits = search.exact(refs(spark, d), own).join(search.side(refs(spark, d), "q").select("q", "q_size"), "q")
    return search.targets_hit(own, hits, sizein=True).where("hits > 0").select("seqno", F.col("hits").cast("long").alias("hits"))


@query
def usearch_global(spark, d):
    return found(spark, d).select("q", "t", "strand", "cigar", F.round("id", 4).alias("id"), "hit")


@query
def usearch_global_both(spark, d):
    return found(spark, d, both_strands=True, top_hits_only=True).select("q", "t", "strand", F.round("id", 4).alias("id"))


@query
def usearch_userout(spark, d):
    hits = found(spark, d)
    return search.userout(hits, "+".join(search.fields(hits)))


@query
def usearch_blast6out(spark, d):
    return search.blast6(found(spark, d), refs(spark, d))


@query
def usearch_uc(spark, d):
    return search.uc(found(spark, d), refs(spark, d))


@query
def usearch_sam(spark, d):
    return search.sam(found(spark, d))


@query
def allpairs_global(spark, d):
    return search.all_pairs(refs(spark, d), search.Search(id=0.5)).select("q", "t", F.round("id", 4).alias("id"), "cigar")


# --------------------------------------------------- clusters, chimeras, pairs


def _clusters(spark, d, order_: str, id_: float = 0.7) -> DataFrame:
    return cluster.cluster(refs(spark, d), search.Search(id=id_), order_)


@query
def cluster_fast(spark, d):
    return _clusters(spark, d, "fast")


@query
def cluster_size(spark, d):
    return _clusters(spark, d, "size")


@query
def cluster_smallmem(spark, d):
    return _clusters(spark, d, "smallmem")


@query
def cluster_unoise(spark, d):
    own = refs(spark, d).withColumn("size", F.col("size") * 8)
    return cluster.cluster(own, search.Search(), "unoise")


@query
def cluster_uc(spark, d):
    return cluster.uc_rows(_clusters(spark, d, "fast"), refs(spark, d))


@query
def cluster_stats(spark, d):
    return cluster.cluster_stats(_clusters(spark, d, "size"), refs(spark, d))


@query
def cluster_consensus(spark, d):
    return tables.consensus(tables.profile(cluster.members(_clusters(spark, d, "fast"), refs(spark, d))))


@query
def cluster_msa(spark, d):
    return tables.msa(cluster.members(_clusters(spark, d, "fast"), refs(spark, d)))


@query
def fastq_mergepairs(spark, d):
    return cluster.merge_pairs(*pairs(reads(spark, d))).select("seqno", "seq", "qual", F.round("ee", 6).alias("ee"), "reason")


def _chimeric(rows: DataFrame) -> DataFrame:
    """Reads made of the first half of one reference and the second half of the next."""
    long_ = rows.where(F.length("seq") >= 100).withColumn("item", F.floor(F.col("seqno") / ITEM))
    one = long_.groupBy("item").agg(F.min(F.struct("seqno", "header", "seq", "size"))["seq"].alias("seq"), F.min("seqno").alias("seqno"), F.min("size").alias("size"))
    other = one.select((F.col("item") - 1).alias("item"), F.col("seq").alias("seq2"))
    half = lambda c: F.floor(F.length(c) / 2).cast("int")
    both = one.join(other, "item")
    return both.select((F.col("seqno") + ITEM // 2).alias("seqno"), F.concat(F.lit("c"), F.col("item").cast("string"), F.lit(";size=1")).alias("header"), F.concat(F.substring("seq", F.lit(1), half("seq")), F.substring("seq2", half("seq2") + 1, F.length("seq2"))).alias("seq"), F.lit(None).cast("string").alias("qual"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("string").alias("sample"))


@query
def uchime_ref(spark, d):
    own = refs(spark, d)
    return chimera.detect(_chimeric(own), own).select("query", "parent_a", "parent_b", F.round("score", 4).alias("score"), F.round("divergence", 4).alias("divergence"), "flag")


def _denovo(spark, d, rule: str, skew: float) -> DataFrame:
    own = refs(spark, d)
    rows = own.withColumn("size", F.lit(64).cast("long")).unionByName(_chimeric(own))
    return chimera.denovo(rows, chimera.Chimera(rule=rule, abskew=skew)).select("query", "parent_a", "parent_b", "flag")


@query
def uchime_denovo(spark, d):
    return _denovo(spark, d, "denovo", 2.0)


@query
def uchime2_denovo(spark, d):
    return _denovo(spark, d, "exact", 2.0)


@query
def uchime3_denovo(spark, d):
    return _denovo(spark, d, "exact", 16.0)


@query
def chimeras_denovo(spark, d):
    return _denovo(spark, d, "long", 1.0)


# --------------------------------------------------------------------- tables


@query
def otu_table(spark, d):
    own = reads(spark, d)
    hits = search.exact(own, refs(spark, d)).join(search.side(own, "q").select("q", "q_size", "q_header"), "q").join(search.side(refs(spark, d), "t").select("t", "t_header"), "t")
    return tables.otu_counts(hits.join(own.select(F.col("seqno").alias("q"), "sample"), "q"), F.col("sample"), tables.otu_of(F.col("t_header")))


@query
def biom(spark, d):
    return tables.biom(otu_table(spark, d))


@query
def lca(spark, d):
    own = tax(refs(spark, d))
    hits = search.exact(reads(spark, d), own).join(own.select(F.col("seqno").alias("t"), F.col("header").alias("t_header")), "t")
    return tables.lca(hits, 0.6)


@query
def sintax(spark, d):
    return tables.sintax(refs(spark, d), tax(refs(spark, d)))


