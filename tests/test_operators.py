import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from nuclade.functions import columns as C
from nuclade.operators import chimera, cluster, derep, filters, kmers, order, quality, search, tables, transforms
from nuclade.schema import READ
from nuclade.sources import files


def reads(spark, rows):
    return spark.createDataFrame([(i, f"r{i};size={n}", s, q or "I" * len(s), n, "s") for i, (s, q, n) in enumerate(rows)], READ)


def test_dereplication_conserves_abundance(spark):
    df = reads(spark, [("ACGU", None, 2), ("acgt", None, 3), ("TTTT", None, 1), ("AAAA", None, 4)])
    one = {r.seq: (r.seqno, r.size) for r in derep.fulllength(df).collect()}
    assert one == {"ACGT": (0, 5), "TTTT": (2, 1), "AAAA": (3, 4)}
    both = derep.fulllength(df, both_strands=True).collect()
    assert sorted((r.seqno, r.size) for r in both) == [(0, 5), (2, 5)]
    again = transforms.rereplicate(derep.fulllength(df))
    assert again.count() == 10 and derep.fulllength(again).agg(F.sum("size")).first()[0] == 10


def test_prefixes_go_to_the_end_of_their_chain(spark):
    base = "ACGTTGCATGTCAGTACCGATTGCAGGTCTAACGTGATC"
    df = reads(spark, [(base, None, 1), (base[:36], None, 2), (base[:34], None, 3), ("ACG", None, 1), ("TTT", None, 5)])
    assert {r.seqno: r.size for r in derep.prefix(df).collect()} == {0: 7, 4: 5}


def test_filter_stops_before_the_bad_symbol(spark):
    df = reads(spark, [("ACGTAC", "III#II", 1), ("ACGNAC", "IIIIII", 1), ("AC", "II", 1)])
    out = {r.seqno: r for r in filters.analyse(df, filters.Quality(trunc_qual=2, min_len=3, max_ns=0)).collect()}
    assert out[0].seq == "ACG" and not out[0].discarded and out[0].truncated
    assert out[1].discarded and out[2].discarded


def test_transforms(spark):
    df = reads(spark, [("ACGTN", "ABCDE", 1)])
    row = transforms.revcomp(df).first()
    assert (row.seq, row.qual) == ("NACGT", "EDCBA")
    assert transforms.subseq(df, 2, 99).first().seq == "CGTN" and transforms.subseq(df, 9, 12).first().seq == ""
    assert transforms.strip_attributes(df, "size").first().header == "r0"
    cut = transforms.cut(reads(spark, [("AAGAATTCTT", None, 1), ("AAAA", None, 1)])).collect()
    assert sorted((r.strand, r.seq) for r in cut) == [(0, "AAG"), (0, "AATTCTT"), (1, "AAG"), (1, "AATTCTT")]


def test_sampling_draws_the_right_number(spark):
    df = reads(spark, [("ACGT" * 3, None, n) for n in (5, 1, 9, 30)])
    out = order.subsample(df, n=12).collect()
    assert sum(r.drawn for r in out) == 12 and all(r.drawn <= r.size for r in out)


def test_search_finds_its_own_sequence_and_near_ones(spark):
    base = "ACGTTGCATGTCAGTACCGATTGCAGGTCTAACGTGATCCATGCGTA"
    df = reads(spark, [(base, None, 1), (base[:20] + "A" + base[21:], None, 1), ("TTGACCATGGCATCGATCGGATCCTTAGCAATCGGCTAAGCTTAGC", None, 1)])
    hits = search.globally(df, df, search.Search(id=0.9, max_accepts=3, mask="none")).collect()
    found = {(r.q, r.t): round(r.id, 1) for r in hits}
    assert found[(0, 0)] == 100.0 and (0, 1) in found and (0, 2) not in found and (2, 2) in found
    turned = transforms.revcomp(df)
    assert {(r.q, r.t, r.strand) for r in search.exact(turned, df, both_strands=True).collect()} == {(0, 0, 1), (1, 1, 1), (2, 2, 1)}
    out = search.userout(search.globally(df, df, search.Search(id=0.9, max_accepts=3, mask="none")), "query+target+id+qrow+trow+aln").collect()
    assert all(len(r.qrow) == len(r.trow) for r in out) and len(search.fields(df.limit(0).select(*[F.lit(0).alias(c) for c in ["id"]]))) == 43


def test_queries_without_words_meet_the_shortest(spark):
    df = reads(spark, [("ACGTTGCATGTCAGTACCGATTGC", None, 1), ("ACGTAC", None, 1)])
    rows = search.candidates(df.where("seqno = 1"), df, search.Search(mask="none")).collect()
    assert [(r.t, r["rank"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 1), (0, 2)]


def test_clusters_hold_their_threshold(spark):
    base = "ACGTTGCATGTCAGTACCGATTGCAGGTCTAACGTGATCCATGCGTA"
    df = reads(spark, [(base, None, 3), (base[:-1] + "C", None, 2), ("TTGACCATGGCATCGATCGGATCCTTAGCAATCGGCTAAGCTTAGC", None, 5)])
    out = {r.seqno: r for r in cluster.cluster(df, search.Search(id=0.9, mask="none"), "size", block=2).collect()}
    assert out[0].is_centroid and out[2].is_centroid and out[1].centroid == 0 and out[1].id >= 90
    own = cluster.members(cluster.cluster(df, search.Search(id=0.9, mask="none"), "size"), df)
    assert {r.seq for r in tables.consensus(tables.profile(own)).collect()} == {base, "TTGACCATGGCATCGATCGGATCCTTAGCAATCGGCTAAGCTTAGC"}


def test_a_limit_of_zero_is_none(spark):
    base = "ACGTTGCATGTCAGTACCGATTGCAGGTCTAACGTGATCCATGCGTA"
    df = reads(spark, [(base, None, 1)] * 50)
    for accepts, rejects in ((0, 0), (0, 32), (60, 0)):
        how = search.Search(id=0.9, mask="none", max_accepts=accepts, max_rejects=rejects)
        assert search.globally(df.where("seqno = 0"), df, how).count() == 50
        assert cluster.cluster(df.where("seqno < 4"), how, "size").where("is_centroid").count() == 1
    assert search.globally(df.where("seqno = 0"), df, search.Search(id=0.9, mask="none", max_accepts=2)).count() == 2


def test_chimera_of_two_references(spark):
    import random

    rng = random.Random(11)
    a, b = ("".join(rng.choice("ACGT") for _ in range(240)) for _ in range(2))
    b = "".join(x if rng.random() < 0.7 else y for x, y in zip(a, b, strict=True))
    df = reads(spark, [(a, None, 1), (b, None, 1)])
    query = spark.createDataFrame([(9, "q;size=1", a[:120] + b[120:], None, 1, None), (10, "clean", a, None, 1, None)], READ)
    out = {r.query: r for r in chimera.detect(query, df).collect()}
    assert out["q;size=1"].flag == "Y" and out["clean"].flag == "N"


def test_statistics(spark):
    df = reads(spark, [("AAACG", "IIII#", 1), ("AC", "II", 1)])
    assert {r.symbol: (r["count"], r.longest) for r in quality.chars(df).collect()} == {"A": (4, 2), "C": (2, 0), "G": (1, 0)}
    assert {r.len: r.longer for r in quality.lengths(df).collect()} == {5: 1, 2: 2}
    assert kmers.postings(reads(spark, [("ACGTNACGT", None, 1)]), 4).count() == 1
    assert C.attribute(F.lit("a;size=3;b"), "size") is not None


def test_files_round_trip(spark, tmp_path):
    df = reads(spark, [("ACGT" * 30, None, 2), ("GGGT", None, 1)])
    files.write_text(files.fasta_text(df), str(tmp_path / "a"))
    back = files.reads(spark, str(tmp_path / "a"))
    assert sorted((r.header, r.seq, r.size) for r in back.collect()) == sorted((r.header, r.seq, r.size) for r in df.collect())
    files.write_text(files.fastq_text(df).coalesce(1), str(tmp_path / "q"))
    assert sorted((r.seq, r.qual) for r in files.reads(spark, str(tmp_path / "q")).collect()) == sorted((r.seq, r.qual) for r in df.collect())
    files.write_index(df, str(tmp_path / "i"))
    assert files.index_info(spark, str(tmp_path / "i")).first().sequences == 2


def test_a_bad_record_fails(spark, tmp_path):
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        files.fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_entry_has_queries_and_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_folded_qualities_are_those_of_the_c_library(spark):
    both = [(a, b) for a in range(42) for b in range(42)]
    symbols = lambda i: "".join(chr(33 + x[i]) for x in both)
    sizes = [(n, m) for n in range(1, 8) for m in range(1, 8)]
    rows = [(2 * i + j, "x", f"{i:b}".translate(str.maketrans("01", "AC")), symbols(j), s[j], None) for i, s in enumerate(sizes) for j in (0, 1)]
    error = lambda q: 0.75 if q < 2 else math.pow(10.0, -q / 10.0)
    score = lambda p: max(0, min(41, math.floor(-10.0 * math.log10(p))))
    out = {r.seqno: r.qual for r in derep.uniques_quality(spark.createDataFrame(rows, READ)).collect()}
    for i, (n, m) in enumerate(sizes):
        assert out[2 * i] == "".join(chr(33 + score((error(a) * n + error(b) * m) / (n + m))) for a, b in both), (n, m)


def test_folds_of_several_reads_and_of_none(spark):
    rows = [(0, "a", "ACGT", "IIII", 1, None), (1, "b", "ACGT", "5555", 1, None), (2, "c", "ACGT", "++++", 2, None), (3, "d", "GG", None, 1, None), (4, "e", "GG", "II", 1, None), (5, "f", "TTT", "#I~", 3, None)]
    df = spark.createDataFrame(rows, READ)
    assert {r.seqno: (r.qual, r["size"]) for r in derep.uniques_quality(df).collect()} == {0: ("----", 4), 3: (None, 2), 5: ("#I~", 3)}
    assert {r.seqno: r.qual for r in derep.uniques_quality(df, keep_best=True).collect()} == {0: "IIII", 3: None, 5: "#I~"}


def test_prefixes_meet_over_the_bounds_of_parts(spark):
    rnd = random.Random(3)
    seqs = {"".join(rnd.choice("AC") for _ in range(rnd.randint(1, 9))) for _ in range(220)}
    seqs |= {"ACGT" * 12 + "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 6))) for _ in range(80)}
    rows = [(i, f"r{i}", s, "I" * len(s), rnd.randint(1, 5), None) for i, s in enumerate(sorted(seqs, key=lambda _: rnd.random()))]
    up, sums = {}, {}
    for i, _, s, *_ in rows:
        later = [(len(t), -n, h, j) for j, h, t, _, n, _ in rows if t != s and t.startswith(s)]
        up[i] = min(later)[3] if later else None
    for i, *_, n, _ in rows:
        end = i
        while up[end] is not None:
            end = up[end]
        sums[end] = sums.get(end, 0) + n
    df = spark.createDataFrame(rows, READ)
    for parts in (1, 7):
        out = derep.prefix(df, parts=parts, one_in=1)
        assert {r.seqno: r["size"] for r in out.collect()} == sums
    assert {r.seqno: r.seq for r in out.collect()} == {i: s for i, _, s, *_ in rows if i in sums}
    assert derep.prefix(df.where("seqno < 0")).count() == 0


def test_prefixes_are_found_without_pairs(spark):
    # Every sequence of 5 letters or less: the shortest starts a quarter of all.
    seqs = [s for n in range(1, 6) for s in map("".join, itertools.product("ACGT", repeat=n))]
    plan = derep.prefix(reads(spark, [(s, None, 1) for s in seqs]))
    assert plan.count() == 4**5
    assert "Generate" not in plan._jdf.queryExecution().optimizedPlan().toString()
