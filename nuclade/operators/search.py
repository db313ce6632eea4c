"""Search: exact, by words and alignment, and all pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import kernels as K
from . import kmers
from .shared import keep

#: Least shared words by word length.
LEAST_WORDS = {3: 18, 4: 17, 5: 16, 6: 15, 7: 14, 8: 12, 9: 11, 10: 10, 11: 9, 12: 8, 13: 7, 14: 5, 15: 3}
ALIGNED = "score int, cigar string, alnlen int, matches int, mism int, gaps int, indels int, int_alnlen int, int_gaps int, int_indels int, trim_q_left int, trim_q_right int, trim_t_left int, trim_t_right int, id0 double, id1 double, id2 double, id3 double, id4 double"


@dataclass(frozen=True)
class Search:
    id: float = 0.97
    max_accepts: int = 1
    max_rejects: int = 32
    word: int = 8
    least_words: int | None = None
    id_def: int = 2
    both_strands: bool = False
    mask: str = "dust"
    max_hits: int | None = None
    top_hits_only: bool = False
    #: Tests before an alignment, on ``q_*`` and ``t_*`` columns (seq, header, size, len), and after it.
    before: list[Column] = field(default_factory=list)
    after: list[Column] = field(default_factory=list)
    #: Which targets ``t`` a query ``q`` may meet at all; others don't take places among its candidates.
    within: Column | None = None
    penalties: K.Penalties = K.Penalties()

    @property
    def least(self) -> int:
        return LEAST_WORDS[self.word] if self.least_words is None else self.least_words


def unaligned_tests(max_q_size: float | None = None, min_t_size: float | None = None, min_size_ratio: float | None = None, max_size_ratio: float | None = None, min_qt: float | None = None, max_qt: float | None = None, min_sl: float | None = None, max_sl: float | None = None, id_prefix: int = 0, id_suffix: int = 0, self_: bool = False, self_id: bool = False) -> list[Column]:
    """Tests before an alignment, for ``Search.before``; those not asked for are none.

    Sizes of the query and the target; their ratio; lengths of the query to the
    target's and of the shorter to the longer; equal first and last symbols; with
    ``self_`` not the same label, with ``self_id`` not the same sequence. A target
    of size 0 is above every ratio.
    """
    q, t = F.col("q_len"), F.col("t_len")
    short, long_ = F.least(q, t), F.greatest(q, t)
    asked = [
        (max_q_size, lambda x: F.col("q_size") <= x),
        (min_t_size, lambda x: F.col("t_size") >= x),
        (min_size_ratio, lambda x: F.col("q_size") >= F.col("t_size") * x),
        (max_size_ratio, lambda x: F.col("q_size") <= F.col("t_size") * x),
        (min_qt, lambda x: q >= t * x),
        (max_qt, lambda x: q <= t * x),
        (min_sl, lambda x: short >= long_ * x),
        (max_sl, lambda x: short <= long_ * x),
        (id_prefix or None, lambda n: (short >= n) & (F.substring("q_seq", 1, n) == F.substring("t_seq", 1, n))),
        (id_suffix or None, lambda n: (short >= n) & (F.right("q_seq", F.lit(n)) == F.right("t_seq", F.lit(n)))),
        (self_ or None, lambda _: F.col("q_header") != F.col("t_header")),
        (self_id or None, lambda _: F.col("q_seq") != F.col("t_seq")),
    ]
    return [test(x) for x, test in asked if x is not None]


def aligned_tests(weak_id: float | None = None, max_subs: int | None = None, max_gaps: int | None = None, min_cols: int | None = None, left_just: bool = False, right_just: bool = False, query_cov: float | None = None, target_cov: float | None = None, max_id: float | None = None, mid: float | None = None, max_diffs: int | None = None) -> list[Column]:
    """Tests after an alignment, for ``Search.after``; those not asked for are none.

    Identities and coverages are shares, but ``mid``, the identity without gaps,
    is in percent. Gaps, columns and differences are those inside the ends.
    """
    both = F.col("matches") + F.col("mism")
    asked = [
        (weak_id, lambda x: F.col("id") >= 100.0 * x),
        (max_subs, lambda x: F.col("mism") <= x),
        (max_gaps, lambda x: F.col("int_gaps") <= x),
        (min_cols, lambda x: F.col("int_alnlen") >= x),
        (left_just or None, lambda _: F.col("trim_q_left") + F.col("trim_t_left") == 0),
        (right_just or None, lambda _: F.col("trim_q_right") + F.col("trim_t_right") == 0),
        (query_cov, lambda x: both >= F.col("q_len") * x),
        (target_cov, lambda x: both >= F.col("t_len") * x),
        (max_id, lambda x: F.col("id") <= 100.0 * x),
        (mid, lambda x: 100.0 * F.col("matches") >= both * x),
        (max_diffs, lambda x: F.col("mism") + F.col("int_indels") <= x),
    ]
    return [test(x) for x, test in asked if x is not None]


def side(reads: DataFrame, p: str, *more: str) -> DataFrame:
    return reads.select(*more, F.col("seqno").alias(p), F.col("header").alias(f"{p}_header"), C.normalised(F.col("seq")).alias(f"{p}_seq"), F.col("size").alias(f"{p}_size"), F.length("seq").alias(f"{p}_len"))


def exact(queries: DataFrame, targets: DataFrame, both_strands: bool = False) -> DataFrame:
    """``(q, t, strand, cigar, id)`` of equal sequences: an equality join."""
    left = side(queries, "q").withColumn("strand", F.lit(0)).withColumn("key", F.col("q_seq"))
    if both_strands:
        left = left.union(left.withColumn("strand", F.lit(1)).withColumn("key", C.reverse_complement(F.col("q_seq"))))
    both = left.join(side(targets, "t"), F.col("key") == F.col("t_seq"))
    return both.select("q", "t", "strand", F.concat(F.col("q_len").cast("string"), F.lit("M")).alias("cigar"), F.lit(100.0).alias("id"))


def candidates(queries: DataFrame, targets: DataFrame, how: Search) -> DataFrame:
    """``(q, t, shared, rank)``: the targets to be tried for each query, most shared words first.

    A query without words meets every target, shortest first; these few queries
    are joined with the shortest targets only. Where either limit is 0, which is
    none, no target is left out.
    """
    top = how.max_accepts + how.max_rejects + 8 if how.max_accepts and how.max_rejects else None
    own = kmers.masked(queries, how.mask)
    # Where only some targets may be met, a block's best are not all that count.
    counts = kmers.shared(own, kmers.masked(targets, how.mask), how.word, how.least, top if how.within is None else None)
    counts = counts if how.within is None else counts.where(how.within)
    lens = targets.select(F.col("seqno").alias("t"), F.length("seq").alias("t_len"))
    shortest = lens if top is None or how.within is not None else F.broadcast(targets.orderBy(F.length("seq"), "seqno").limit(top).select(F.col("seqno").alias("t"), F.length("seq").alias("t_len")))
    bare = own.where(F.size(C.words(F.col("seq"), how.word)) == 0).select(F.col("seqno").alias("q"))
    none = bare.crossJoin(shortest).select("q", "t", F.lit(0).cast("long").alias("shared"), F.col("t_len").cast("long").alias("t_len"))
    none = none if how.within is None else none.where(how.within)
    order = Window.partitionBy("q").orderBy(F.col("shared").desc(), "t_len", "t")
    ranked = counts.union(none).withColumn("rank", F.row_number().over(order)).drop("t_len")
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def aligned(pairs: DataFrame, how: Search) -> DataFrame:
    """``pairs`` with ``q_seq`` and ``t_seq`` and their alignment; Arrow batches of pairs, aligned together."""
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    penalties = how.penalties

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.join(pd.DataFrame(K.align(batch["q_seq"].tolist(), batch["t_seq"].tolist(), penalties), index=batch.index)[names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.repartition(kmers.tasks(pairs), "q", "t").mapInPandas(run, f"{own}, {ALIGNED}")


def verdicts(pairs: DataFrame, how: Search) -> DataFrame:
    """Candidates ``(q, t, rank, ...)`` with sequences, aligned if the first tests pass; ``accepted`` or not.

    Of equal pairs of a query, those are left which a walk in rank order would
    have come to before it had enough accepts or rejects.
    """
    first = F.lit(True)
    for test in how.before:
        first = first & test
    tried = pairs.withColumn("tried", F.coalesce(first, F.lit(False)))
    yes = aligned(tried.where("tried"), how).withColumn("id", F.col(f"id{how.id_def}"))
    test = F.col("id") >= 100 * how.id
    for one in how.after:
        test = test & one
    done = yes.withColumn("accepted", test).unionByName(tried.where("not tried").withColumn("accepted", F.lit(False)), allowMissingColumns=True)
    run = Window.partitionBy("q", *(["strand"] if "strand" in pairs.columns else [])).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(run), F.lit(0))
    walk = done.withColumn("_a", before(F.col("accepted"))).withColumn("_r", before(~F.col("accepted")))
    return walk.where((F.col("_a") < (how.max_accepts or 2**31 - 1)) & (F.col("_r") < (how.max_rejects or 2**31 - 1))).drop("_a", "_r")


def globally(queries: DataFrame, targets: DataFrame, how: Search | None = None) -> DataFrame:
    """Hits of each query, best first: words in common, then alignments in that order until enough pass or fail."""
    how = how or Search()
    # Counted, masked and joined: what it took to make the targets is done once.
    targets = keep(targets.select("seqno", "header", "seq", "size"))
    own = queries.select("seqno", "header", "seq", "size").withColumn("strand", F.lit(0))
    if how.both_strands:
        own = own.union(own.withColumn("seq", C.reverse_complement(F.col("seq"))).withColumn("strand", F.lit(1)))
    if how.both_strands and how.within is None:
        # Both strands are counted at once: the last bit of a number is the strand.
        found = candidates(own.withColumn("seqno", 2 * F.col("seqno") + F.col("strand")), targets, how)
        found = found.withColumn("strand", F.col("q").bitwiseAND(1).cast("int")).withColumn("q", F.shiftright("q", 1))
    else:
        parts = [candidates(own.where(F.col("strand") == i), targets, how).withColumn("strand", F.lit(i)) for i in range(1 + how.both_strands)]
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    pairs = found.join(side(own, "q", "strand"), ["q", "strand"]).join(side(targets, "t"), "t")
    hits = verdicts(pairs, how).where("accepted")
    best = Window.partitionBy("q").orderBy(F.col("id").desc(), "t", "strand")
    hits = hits.withColumn("hit", F.row_number().over(best))
    if how.top_hits_only:
        hits = hits.withColumn("_top", F.max("id").over(Window.partitionBy("q"))).where(F.col("id") == F.col("_top")).drop("_top")
    return hits.where(F.col("hit") <= how.max_hits) if how.max_hits else hits


def all_pairs(reads: DataFrame, how: Search | None = None, accept_all: bool = False, block: int = 256) -> DataFrame:
    """Every pair ``q < t`` aligned, and those that pass.

    Rows are dealt to blocks, and a pair of blocks is one equality key, so work
    is spread evenly and no task holds more than two blocks.
    """
    how = how or Search()
    n = max(1, -(-reads.count() // block))
    own = side(reads, "q").withColumn("i", F.pmod(F.xxhash64("q"), F.lit(n)).cast("int"))
    left = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = side(reads, "t").withColumn("j", F.pmod(F.xxhash64("t"), F.lit(n)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = left.join(right, ["i", "j"]).where("q < t").drop("i", "j")
    out = aligned(pairs, how).withColumn("id", F.col(f"id{how.id_def}"))
    test = F.lit(True) if accept_all else F.col("id") >= 100 * how.id
    for one in [] if accept_all else how.after:
        test = test & one
    return out.where(test)


def matched(queries: DataFrame, hits: DataFrame, keep: bool = True) -> DataFrame:
    """Queries with, or without, a hit."""
    return queries.join(hits.select(F.col("q").alias("seqno")).distinct(), "seqno", "left_semi" if keep else "left_anti")


def targets_hit(targets: DataFrame, hits: DataFrame, sizein: bool = False) -> DataFrame:
    """``(seqno, header, hits)``: how often, or with what abundance, each target was hit."""
    n = F.sum("q_size") if sizein else F.count(F.lit(1))
    return targets.select("seqno", "header").join(hits.groupBy(F.col("t").alias("seqno")).agg(n.alias("hits")), "seqno", "left").fillna(0, ["hits"])


# ------------------------------------------------------------------ reports


def fields(hits: DataFrame) -> dict[str, Column]:
    """The columns of a report by name, over the rows of ``globally``."""
    c = F.col
    q_end, t_end = c("q_len") - c("trim_q_right"), c("t_len") - c("trim_t_right")
    pct = lambda n, of: F.when(of > 0, 100.0 * n / of).otherwise(0.0)
    strand = F.when(c("strand") == 1, "-").otherwise("+")
    pairs = c("matches") + c("mism")
    one = lambda x: F.format_string("%.1f", x.cast("double"))
    return {
        "query": c("q_header"), "target": c("t_header"), "evalue": F.lit("-1"), "id": one(c("id")), "pctpv": one(pct(c("matches"), c("int_alnlen"))), "pctgaps": one(pct(c("int_indels"), c("int_alnlen"))),
        "pairs": pairs, "gaps": c("int_indels"), "qlo": F.lit(1), "qhi": c("q_len"), "tlo": F.lit(1), "thi": c("t_len"), "pv": c("matches"), "ql": c("q_len"), "tl": c("t_len"), "qs": c("q_len"), "ts": c("t_len"),
        "alnlen": c("int_alnlen"), "opens": c("int_gaps"), "exts": c("int_indels") - c("int_gaps"), "raw": c("score"), "bits": F.lit(0), "aln": aln(c("cigar")), "caln": c("cigar"), "qstrand": strand, "tstrand": F.lit("+"),
        "qrow": row("q"), "trow": row("t"), "qframe": F.lit("+0"), "tframe": F.lit("+0"), "mism": c("mism"), "ids": c("matches"), "qcov": one(pct(pairs, c("q_len"))), "tcov": one(pct(pairs, c("t_len"))),
        "id0": one(c("id0")), "id1": one(c("id1")), "id2": one(c("id2")), "id3": one(c("id3")), "id4": one(c("id4")), "qilo": c("trim_q_left") + 1, "qihi": q_end, "tilo": c("trim_t_left") + 1, "tihi": t_end,
    }


def aln(cigar: Column) -> Column:
    """A cigar with a letter for each column."""
    runs = F.regexp_extract_all(cigar, F.lit("([0-9]*[MID])"), 1)
    return F.array_join(F.transform(runs, lambda x: F.repeat(F.right(x, F.lit(1)), F.when(F.length(x) > 1, F.substring(x, F.lit(1), F.length(x) - 1).cast("int")).otherwise(1))), "")


def row(which: str) -> Column:
    """The inner part of the aligned query or target, with gaps; built run by run within the row."""
    gap = "I" if which == "q" else "D"
    runs = F.regexp_extract_all(F.col("cigar"), F.lit("([0-9]*[MID])"), 1)
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("at"))

    def step(s, x):
        n = F.when(F.length(x) > 1, F.substring(x, F.lit(1), F.length(x) - 1).cast("int")).otherwise(1)
        own = F.right(x, F.lit(1)) == gap
        piece = F.when(own, F.repeat(F.lit("-"), n)).otherwise(F.substring(F.col(f"{which}_seq"), s.at, n))
        return F.struct(F.concat(s.s, piece).alias("s"), F.when(own, s.at).otherwise(s.at + n).alias("at"))

    full = F.aggregate(runs, start, step).s
    skip = F.col("trim_q_left") + F.col("trim_t_left")
    return F.substring(full, skip + 1, F.col("int_alnlen"))


def userout(hits: DataFrame, names: str = "query+target+id") -> DataFrame:
    known = fields(hits)
    return hits.select(*[known[n].alias(n) for n in names.split("+")])


def blast6(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """The twelve columns; with ``queries`` those without hits have a row of ``*``."""
    names = "query+target+id+alnlen+mism+opens+qlo+qhi+tlo+thi+evalue+bits"
    if queries is None:
        return userout(hits, names)
    known = fields(hits)
    blank = {c: F.lit("*" if c == "target" else "0.0" if c == "id" else "-1" if c == "evalue" else 0) for c in known} | {"query": F.col("header")}
    # One join, so that hits are found once: queries without any are those left over.
    every = queries.select("seqno", "header").join(hits, F.col("seqno") == F.col("q"), "left")
    return every.select(*[F.when(F.col("q").isNotNull(), known[n]).otherwise(blank[n]).alias(n) for n in names.split("+")])


def uc(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """H rows of best hits and N rows of queries without any."""
    text = lambda x: x.cast("string")
    star = F.lit("*")
    hit = F.col("q").isNotNull()
    columns = {
        "type": ("H", "N"), "cluster": (text(F.col("t")), star), "size": (text(F.col("q_len")), star), "id": (F.format_string("%.1f", "id"), star), "strand": (F.when(F.col("strand") == 1, "-").otherwise("+"), "."),
        "cigar": (F.when((F.col("id1") == 100.0) & (F.col("q_len") == F.col("t_len")), "=").otherwise(F.col("cigar")), star), "query": (F.col("q_header"), F.col("header")), "target": (F.col("t_header"), star),
    }
    every = queries.select("seqno", "header").join(hits.where("hit = 1"), F.col("seqno") == F.col("q"), "left")
    return every.select(*[F.when(hit, h).otherwise(n).alias(c) for c, (h, n) in columns.items()])


def sam(hits: DataFrame) -> DataFrame:
    """Alignment lines; I and D change places, as there they are of the target."""
    turned = F.translate("cigar", "ID", "DI")
    rank = F.when(F.col("hit") == 1, 0).otherwise(256)
    return hits.select(F.col("q_header").alias("qname"), (rank + F.when(F.col("strand") == 1, 16).otherwise(0)).alias("flag"), F.col("t_header").alias("rname"), F.lit(1).alias("pos"), F.lit(255).alias("mapq"), turned.alias("cigar"), F.col("q_seq").alias("seq"), F.format_string("AS:i:%d\tXN:i:0\tXM:i:%d\tXO:i:%d\tXG:i:%d\tNM:i:%d\tMD:Z:%s\tYT:Z:UU", F.round("id").cast("int"), "mism", "int_gaps", "int_indels", F.col("mism") + F.col("int_indels"), md("q_seq", "t_seq", "cigar")).alias("tags"))


@F.pandas_udf(StringType())
def md(q: pd.Series, t: pd.Series, cigar: pd.Series) -> pd.Series:
    """Matches by number, mismatched target symbols, and target symbols that the query lacks after ``^``."""

    def one(x: str, y: str, c: str) -> str:
        out, n, gap = [], 0, False
        for a, b in zip(*K.rows_of(x, y, c), strict=True):
            if b == "-":
                continue
            if a == "-":
                out.append(b if gap else f"{n}^{b}")
                n, gap = (n if gap else 0), True
            elif a == b:
                n, gap = n + 1, False
            else:
                out.append(f"{n}{b}")
                n, gap = 0, False
        return "".join(out) + str(n)

    return pd.Series([one(*x) for x in zip(q, t, cigar, strict=True)])
