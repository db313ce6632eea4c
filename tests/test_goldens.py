"""Small inputs with results that are known in advance: the operators must give these."""

from nuclade.functions import kernels as K
from nuclade.operators import chimera, cluster, derep, search
from nuclade.schema import READ

# Sequences with labels, and what must come out of them.
REFS = [
    ("ref1", "AAGCCCAATCAACCACTCTCACTGGACGATTGCGGATATTGGCAACGAATTGGGAGGCGACCCGGACGACAGTCACGCCTTCTCGTTTGCGTACAGCTATTTGAAGGAGTCTAGCAGCCGCAGTAAGGCACAATACCTCCGCCGTGATACCGGACCAAACAAGACGTCCACTTCAATGTTTAAATGACCTACGCGTCAGAACACCTTTCTACTATGTGTTCTCCCAGAATCATCTAGTACAATGGCGCGTCGTCATTAAAGCACCGGATGCGACGAACGGAGCGTGAATGAAGCTACTAC"),
    ("ref2", "AAGCACAATAAACCCCTGTCACGGGTCGAATAGGGGTTTAGGCAACGATCTCTGCAGAGCCCCTTGAGACAGTGACGCTTGTGCCGTTGCTTAAACTGATTTGAAGGAGTCTAGCGGCCGCAGTAACGCACATTACCTAGTCCGCGTTCCCAGACGAAACAGGACGACATCTTTAAGGTTTAACTGACCGTCTATTCTTAAAACCTTCCAACTATGTGTTCCGAAAGAATCACCAACTACATTTACGCGTCGTGAATAACGTGTCGCCTGAGACGATAGGCGCGTGAATGAGGCGCTTAA"),
    ("ref3", "AAGCCTAAGAGGCCACACCGACTGGCCGAGCAGGAATTCAGTCAAAGATATGTGCGGCCAACCTTGCGATAGTTACGCAGTCGCCGTTTCCTAAACCTATTTGAAGGTTTCTAGCAGCCGCAGTAAGTGAGGATACCTCATCCGTATTACCAGACAAAATAACCGGTCATCTTAAATGTGTATATGACCCTTTCGTCACAAAACCTTTTTGCTGTGTGTCCCGCAAGAATCAACAACTACAATGGCGAGCCGCGACTAACGCGACGGCTGATACTAACGGCGCGTGAATGAAGCGCTTAA"),
    ("ref4", "AAGCCCAATAAACCAACCTGTCTGGCCAAATAGCGTTAGTGGCAACGTCATGTGTGACTACCCTTGCGATAGTGACGAACTCGCCGTTGCCTAACCCTATTTGATGGAGTCTAGCGGACGCAGTAAGTCACAATACCTCGACCGTTTTACCTGAACAAACGAGGCGTCTTCGACAATGTTTTTAGGACCCTCTCGTAATAAAAAATTCCTACTATGTGTTCAGCAAGCATCAACAGCTGCATTGGAGCGTCGTGAATAAAGCGAGGGCTGTGACGGACTGTGCGTGAATGAAGCGCTTGA"),
    ("ref5", "CAGCGCAATAAATCACTACGTCTGGCCGAATACGGATATAGGCAACGACTCGAGCGGCGACCCTGGCGACAGTGACGCTTTCGCCGTTGCCTAAACCTATCTGAAGGAGTCTAGCACTCGCTACAAGGCGCTATAGCTCGTCCGTGTTACCAGACCAAACAGGACGTCCTTGTCACTGTTGAACTTACCCTATCGTGGTAGAACCTTTCTACTAGGTGGTACGCAACAATCACCAACTACAATGGCACGTCGTGAATAACTCTCCGGATGAGACGAGCGTCGCTTTAGTGGACCACGTAA"),
    ("ref6", "AAGCCCACTAAACACCTCTGACTGGCCGGATACGGATTTAGGCAACGATGTGTGCCGCGCCCCTTACCACGGTGACGCTCTCGGAGTTGTCTAAACCTTTTTTAAGGAGTCCGGCAGCCGCACTAAGGCACAATATCTCCTACGCGTAAGCAGATCAAACATGACGTCCTCTATAATGTTGAAATGAACCTCTCGTCATAAAACCATTCTACTATGAGTTCCGAAAGAATCAACAACTACAGTGGCGCGTCGGGTTTATCCTGACGGCTGAGATGAACGGTGCGCTAATGAACTGCTTAA"),
]
QUERIES = [
    ("query_clean1", "AAGCCCAATCAACCACTCTCACTGGACGATTGCGGATATTGGCAACGAATTGGGAGGCGACCCGGACGACAGTCACGCCTTCTCGTTTGCGTACAGCTATTTGAAGGAGTCTAGCAGCCGCAGTAAGGCACAATACCTCCGCCGTGATACCGGACCAAACAAGACGTCCACTTCAATGTTTAAATGACCTACGCGTCAGAACACCTTTCTACTATGTGTTCTCCCAGAATCATCTAGTACAATGGCGCGTCGTCATTAAAGCACCGGATGCGACGAACGGAGCGTGAATGAAGCTACTAC"),
    ("query_clean2", "AAGCCTAAGAGGCCACACCGACTGGCCGAGCAGGAATTCAGTCAAAGATATGTGCGGCCAACCTTGCGATAGTTACGCAGTCGCCGTTTCCTAAACCTATTTGAAGGTTTCTAGCAGCCGCAGTAAGTGAGGATACCTCATCCGTATTACCAGACAAAATAACCGGTCATCTTAAATGTGTATATGACCCTTTCGTCACAAAACCTTTTTGCTGTGTGTCCCGCAAGAATCAACAACTACAATGGCGAGGCGCGACTAACGCGACGGCTGATACTAACGGCGCGTGAATGAAGCGCTTCA"),
    ("query_chimera1", "AAGCCCAATCAACCACTCTCACTGGACGATTGCGGATATTGGCAACGAATTGGGAGGCGACCCGGACGACAGTCACGCCTTCTCGTTTGCGTACAGCTATTTGAAGGAGTCTAGCAGCCGCAGTAAGGCACAATACCTCCGCCGTGATACCAGACGAAACAGGACGACATCTTTAAGGTTTAACTGACCGTCTATTCTTAAAACCTTCCAACTATGTGTTCCGAAAGAATCACCAACTACATTTACGCGTCGTGAATAACGTGTCGCCTGAGACGATAGGCGCGTGAATGAGGCGCTTAA"),
    ("query_chimera2", "AAGCCTAAGAGGCCACACCGACTGGCCGAGCAGGAATTCAGTCAAAGATATGTGCGGCCAACCTTGCGATAGTTACGCAGTCGCCGTTTCCTAAACCTATTTGAAGGTTTCTAGCAGCCGCAGTAAGTCACAATACCTCGACCGTTTTACCTGAACAAACGAGGCGTCTTCGACAATGTTTTTAGGACCCTCTCGTAATAAAAAATTCCTACTATGTGTTCAGCAAGCATCAACAGCTGCATTGGAGCGTCGTGAATAAAGCGAGGGCTGTGACGGACTGTGCGTGAATGAAGCGCTTGA"),
    ("query_chimera3", "CAGCGCAATAAATCACTACGTCTGGCCGAATACGGATATAGGCAACGACTCGAGCGGCGACCCTGGCGACAGTGACGCTTTCGCCGTTGCCTAAACCTATCTGAAGGAGTCTAGCACTCGCTACAAGGCGCTATAGCTCGTCCGTGTTACCAGATGAAACATGACGTCCTCTATAATGTTGAAATGAACCTCTCGTCATAAAACCATTCTACTATGAGTTCCGAAAGAATCAACAACTACAGTGGCGCGTCGGGTTTATCCTGACGGCTGAGATGAACGGTGCGCTAATGAACTGCTTAA"),
    ("query_noparent", "ACAAATAGAGTACACATGTCAGAGGCTGCTGTCGAGGTTGTAATCATTAACAATGGAGTCACATTGACCAGCTTCACGCGCTGTGCACCCACGCAGGGAGCCGGTATCATAACGAGCACGGGCTTCACGACTGAGACTAAGGCGGAAAACGCGTAAGCGACGCGAGTATCCCTCCTCACCAAAGATCTCATACGGAATTAAGGAGAGCCTGAAAGGCTACGTCGTGATTGTCCTGAACCGAGGCCTCTAGCAGCGTTATAGGTACCCGCTCGAACAGAACACCACCCTTGCGTAATTCAA"),
    ("query_divergent_chimera", "AAGCCCAATCAACCACTCTCACTGGACGATTGCGGATATTGGCCACGAATTGGGAGGCGACCCGGACGACAGTTACGCCTTCTCGTTTGCGTACAGCTATTTGAAGGAGTCTAGCAGCCGCGGTGAGGCACAATACCTCCGCCGTGATACCAGACGAAACAGGACGAGAACTTTAAGGTTTAACTGAACGTCTATTATTAAAACCTTACAAGTATGGGTTCCGAAAGCATGACCAACTACATTGACGCGTCGTGAATAACGTGTCGCCTGAGACGATAGGCGCGTGAATGAGTCGCTTAA"),
    ("query_short", "AAGCCCAATCAACCACTCTCACTGGACGATTGCGGATATTGGCAACGAATTGGGAGGCGA"),
]
CHIMERAS = [
    ("0.0000", "query_clean1", "*", "*", "*", "*", "*", "*", "*", "*", "0", "0", "0", "0", "0", "0", "*", "N"),
    ("0.0000", "query_clean2", "*", "*", "*", "*", "*", "*", "*", "*", "0", "0", "0", "0", "0", "0", "*", "N"),
    ("16.5019", "query_chimera1", "ref1", "ref2", "ref2", "100.0", "84.7", "85.0", "69.7", "85.0", "45", "0", "0", "46", "0", "0", "15.0", "Y"),
    ("0.0000", "query_noparent", "*", "*", "*", "*", "*", "*", "*", "*", "0", "0", "0", "0", "0", "0", "*", "N"),
    ("13.9509", "query_chimera2", "ref3", "ref4", "ref4", "100.0", "83.3", "88.3", "71.7", "88.3", "35", "0", "0", "50", "0", "0", "11.7", "Y"),
    ("13.8466", "query_chimera3", "ref5", "ref6", "ref6", "99.7", "85.0", "85.3", "71.0", "85.3", "43", "0", "0", "44", "0", "1", "14.3", "Y"),
    ("0.0000", "query_short", "*", "*", "*", "*", "*", "*", "*", "*", "0", "0", "0", "0", "0", "0", "*", "N"),
    ("3.4385", "query_divergent_chimera", "ref1", "ref2", "ref1", "95.0", "81.3", "80.3", "69.7", "81.3", "44", "0", "4", "43", "2", "9", "13.7", "Y"),
]
HITS = [
    ("query_chimera2", "ref4", "88.3"),
    ("query_chimera2", "ref3", "83.3"),
    ("query_chimera2", "ref1", "69.3"),
    ("query_chimera1", "ref2", "85.0"),
    ("query_chimera1", "ref1", "84.7"),
    ("query_chimera1", "ref5", "72.3"),
    ("query_clean1", "ref1", "100.0"),
    ("query_clean1", "ref4", "70.3"),
    ("query_clean1", "ref2", "69.7"),
    ("query_clean2", "ref3", "99.3"),
    ("query_clean2", "ref4", "71.7"),
    ("query_clean2", "ref1", "68.7"),
    ("query_divergent_chimera", "ref1", "81.3"),
    ("query_divergent_chimera", "ref2", "80.3"),
    ("query_divergent_chimera", "ref5", "69.7"),
    ("query_short", "ref1", "100.0"),
    ("query_chimera3", "ref6", "85.3"),
    ("query_chimera3", "ref5", "85.0"),
    ("query_chimera3", "ref2", "73.3"),
]
CLUSTERS = [
    ("S", "0", "300", "*", "*", "*", "*", "*", "ref1", "*"),
    ("S", "1", "300", "*", "*", "*", "*", "*", "ref2", "*"),
    ("S", "2", "300", "*", "*", "*", "*", "*", "ref3", "*"),
    ("H", "0", "300", "70.3", "+", "0", "0", "300M", "ref4", "ref1"),
    ("H", "1", "300", "70.7", "+", "0", "0", "300M", "ref5", "ref2"),
    ("H", "1", "300", "73.3", "+", "0", "0", "300M", "ref6", "ref2"),
    ("C", "0", "2", "*", "*", "*", "*", "*", "ref1", "*"),
    ("C", "1", "3", "*", "*", "*", "*", "*", "ref2", "*"),
    ("C", "2", "1", "*", "*", "*", "*", "*", "ref3", "*"),
]
COPIES = [
    ("seq1", "ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGT"),
    ("seq2", "GGGGCCCCAAAATTTTGGGGCCCCAAAATTTTGGGGCCCCAAAATTTTGGGG"),
    ("seq1dup", "ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGT"),
    ("seq3", "TTTTAAAACCCCGGGGTTTTAAAACCCCGGGGTTTTAAAACCCCGGGGTTTT"),
    ("seq2dup", "GGGGCCCCAAAATTTTGGGGCCCCAAAATTTTGGGGCCCCAAAATTTTGGGG"),
    ("seq2dup2", "GGGGCCCCAAAATTTTGGGGCCCCAAAATTTTGGGGCCCCAAAATTTTGGGG"),
    ("seq4unique", "ACGTACGTGGGGCCCCTTTTAAAACGTACGTACGTACGTACGTACGTACGTA"),
]
UNIQUES = [
    ("seq2;size=3", "GGGGCCCCAAAATTTTGGGGCCCCAAAATTTTGGGGCCCCAAAATTTTGGGG"),
    ("seq1;size=2", "ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGT"),
    ("seq3;size=1", "TTTTAAAACCCCGGGGTTTTAAAACCCCGGGGTTTTAAAACCCCGGGGTTTT"),
    ("seq4unique;size=1", "ACGTACGTGGGGCCCCTTTTAAAACGTACGTACGTACGTACGTACGTACGTA"),
]
LOW = [
    ("clean_seq", "ACGTACGTACGTACGTACGTACGTACGTACGT"),
    ("low_complexity", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"),
    ("mixed_seq", "ACGTACGTACGTACGTAAAAAAAAAAAAAAAAAAAAAAAAAAAAAACGTACGTACGTACGT"),
    ("short_repeat", "ATATATATATATATATATATATATATATATATAT"),
    ("gc_rich_repeat", "GCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGC"),
]
MASKED = [
    ("clean_seq", "acgtacgtacgtacgtacgtacgtacgtacgt"),
    ("low_complexity", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
    ("mixed_seq", "ACGTACGTACGTACGTaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaCGTACGTACGTACGT"),
    ("short_repeat", "atatatatatatatatatatatatatatatatat"),
    ("gc_rich_repeat", "gcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgcgc"),
]
FORWARD = "AAGCCCAATCAACCACTCTCACTGGACGATTGCGGATATTGGCAACGAATTGGGAGGCGACCCGGACGACAGTCACGCCTTCTCGTTTGCGTACAGCTATTTGAAGGAGTCTAGCAGCCGCAGTAAGGCACAATACCTCCGCCGTGATACCGGACCAAACAAGACGTCCACTTCAATGTTTAAATGACCTACGCGTCAGA"
REVERSE = "GTAGTAGCTTCATTCACGCTCCGTTCGTCGCATCCGGTGCTTTAATGACGACGCGCCATTGTACTAGATGATTCTGGGAGAACACATAGTAGAAAGGTGTTCTGACGCGTAGGTCATTTAAACATTGAAGTGGACGTCTTGTTTGGTCCGGTATCACGGCGGAGGTATTGTGCCTTACTGCGGCTGCTAGACTCCTTCAA"
MERGED = "AAGCCCAATCAACCACTCTCACTGGACGATTGCGGATATTGGCAACGAATTGGGAGGCGACCCGGACGACAGTCACGCCTTCTCGTTTGCGTACAGCTATTTGAAGGAGTCTAGCAGCCGCAGTAAGGCACAATACCTCCGCCGTGATACCGGACCAAACAAGACGTCCACTTCAATGTTTAAATGACCTACGCGTCAGAACACCTTTCTACTATGTGTTCTCCCAGAATCATCTAGTACAATGGCGCGTCGTCATTAAAGCACCGGATGCGACGAACGGAGCGTGAATGAAGCTACTAC"


def frame(spark, rows):
    return spark.createDataFrame([(i, h, s, None, 1, None) for i, (h, s) in enumerate(rows)], READ)


def test_copies_become_one(spark):
    out = derep.with_abundance(derep.in_order(derep.fulllength(frame(spark, COPIES)))).orderBy("seqno").collect()
    assert {(r.header, r.seq) for r in out} == set(UNIQUES)
    assert [r.header for r in derep.with_abundance(derep.in_order(derep.fulllength(frame(spark, COPIES)))).collect()] == [h for h, _ in UNIQUES]


def test_low_complexity_is_masked():
    assert [(h, K.dust(s)) for h, s in LOW] == MASKED


def test_a_pair_is_merged():
    quality = "I" * len(FORWARD)
    assert K.merge(FORWARD, quality, REVERSE, quality, K.Merge())["seq"] == MERGED


def test_hits_are_found_in_order(spark):
    how = search.Search(id=0.5, max_accepts=3, max_rejects=16, word=8)
    out = search.globally(frame(spark, QUERIES), frame(spark, REFS), how).orderBy("q", "hit").collect()
    own = {h: [] for h, _ in QUERIES}
    for r in out:
        own[r.q_header].append((r.q_header, r.t_header, f"{r.id:.1f}"))
    for h, rows in own.items():
        assert rows == [x for x in HITS if x[0] == h], h


def test_clusters_are_those(spark):
    refs = frame(spark, REFS)
    out = cluster.uc_rows(cluster.cluster(refs, search.Search(id=0.7), "fast"), refs).where("type <> 'C'").collect()
    rows = {(r.type, str(r.cluster), str(r["size"]), r.id, r.cigar, r.query, r.target) for r in out}
    assert rows == {(x[0], x[1], x[2], x[3], x[7], x[8], x[9]) for x in CLUSTERS if x[0] != "C"}


def test_chimeras_are_those(spark):
    out = {r["query"]: r for r in chimera.detect(frame(spark, QUERIES), frame(spark, REFS)).collect()}
    for want in CHIMERAS:
        r = out[want[1]]
        text = lambda x, n: "*" if x is None else f"{x:.{n}f}"
        name = lambda x: "*" if x is None else x
        own = (text(r.score, 4), r["query"], name(r.parent_a), name(r.parent_b), name(r.closest), *(text(r[c], 1) for c in ("id_qm", "id_qa", "id_qb", "id_ab", "id_qt")), *(str(r[c]) for c in ("left_y", "left_n", "left_a", "right_y", "right_n", "right_a")), text(r.divergence, 1), r.flag)
        assert own == want
