import struct

from pyspark.sql import functions as F

from nuclade.functions.register import register
from nuclade.operators import search
from nuclade.schema import READ
from nuclade.sources import files, reports
from nuclade.streaming import flows

BASE = "ACGTTGCATGTCAGTACCGATTGCAGGTCTAACGTGATCCATGCGTA"


def test_reports_of_hits(spark):
    df = spark.createDataFrame([(0, "a", BASE, None, 1, "s"), (1, "b", BASE[3:20] + BASE[21:], None, 1, "s")], READ)
    hits = search.globally(df, df, search.Search(id=0.8, max_accepts=2, mask="none")).persist()
    assert hits.count() == 4
    assert all("Qry" in r.value for r in reports.alignments(hits).collect())
    assert all(len(a) == len(b) for r in reports.fasta_pairs(hits).collect() for a, b in [r.value.split("\n")[1:4:2]])
    assert {r.seq for r in reports.segments(hits.where("q = 0 and t = 1")).collect()} == {BASE[3:]}
    assert reports.sam_header(df).count() == 2 and search.sam(hits).where("contains(tags, 'MD:Z:')").count() == 4
    table = spark.createDataFrame([("o1", "s1", 2), ("o2", "s2", 3)], "otu string, sample string, n long")
    assert sorted(r.value for r in reports.mothur(table).collect()) == ["userLabel\ts1\t2\t2\t0", "userLabel\ts2\t2\t0\t3"]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("select revcomp('AACG'), align_cigar('ACGT', 'ACGT')").first()[:] == ("CGTT", "4M")
    assert [r.word for r in spark.sql("select * from seq_words('ACGTA', 4)").collect()] == ["ACGT", "CGTA"]
    assert [r.seq for r in spark.sql("select * from seq_cut('AAGCTT', 'GC', 1)").collect()] == ["AAG", "CTT"]


def test_sff(spark):
    flows_, seq, qual = 4, b"ACGTA", bytes([30, 31, 32, 33, 34])
    head = struct.pack(">4sIQIIHHHB", b".sff", 1, 0, 0, 1, 40, 4, flows_, 1) + b"TACGTCAG"
    read = struct.pack(">HHIHHHH", 24, 2, 5, 2, 4, 0, 0) + b"r1" + b"\0" * 6 + b"\0" * (2 * flows_ + 5) + seq + qual
    data = head.ljust(40, b"\0") + read
    assert list(files.parse_sff(data)) == [("r1", "aCGTa", "?@ABC")]
    assert list(files.parse_sff(data, clip=True)) == [("r1", "CGT", "@AB")]


def test_streaming_derep_and_rollup(spark, tmp_path):
    rows = [(i, f"h{i}", s, "IIII", 2, "s") for i, s in enumerate(["ACGT", "ACGU", "TTTT"])]
    spark.createDataFrame(rows, READ).write.parquet(str(tmp_path / "in"))
    stream = flows.derep(flows.read_stream(spark, str(tmp_path / "in"), READ))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("derep_out").start()
    q.processAllAvailable()
    q.stop()
    assert {r.seq: r.size for r in spark.sql("select * from derep_out").collect()} == {"ACGT": 4, "TTTT": 2}
    events = spark.createDataFrame([(1, "a", 2.0)], "s long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s"))
    assert flows.rollup(events).first().n == 1


def test_reports_find_hits_once(spark):
    rows = [(i, f"r{i}", s, "I" * len(s), 1, None) for i, s in enumerate(["ACGTTGCATGTCAGTACCGATTGCAGGTCTAACGTGATC", "ACGTTGCATGTCAGTACCGATTGCAGGTCTAACGTGATG", "TTGACCAGTTGACCATTGACCAGGATTTACAGATTACCA"])]
    df = spark.createDataFrame(rows, READ)
    hits = search.globally(df, df.where("seqno = 0"), search.Search(id=0.9, mask="none", both_strands=True))
    uc, lines = search.uc(hits, df), search.blast6(hits, df)
    assert {(r.type, r.cluster, r.id, r.strand, r.cigar, r["query"], r.target) for r in uc.collect()} == {("H", "0", "100.0", "+", "=", "r0", "r0"), ("H", "0", "97.4", "+", "39M", "r1", "r0"), ("N", "*", "*", ".", "*", "r2", "*")}
    assert {(r["query"], r.target, r.id, r.alnlen, r.evalue) for r in lines.collect()} == {("r0", "r0", "100.0", 39, "-1"), ("r1", "r0", "97.4", 39, "-1"), ("r2", "*", "0.0", 0, "-1")}
    for report in (uc, lines):
        plan = report._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") == 1 and plan.count("FlatMapCoGroupsInPandas") == 1
