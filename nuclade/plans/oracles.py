"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from ..functions.columns import COMPLEMENTS, SYMBOLS
from ..schema import BASES, DIGITS, ITEM, LETTERS, LONGEST
from ..schema import SYMBOLS as QUALS
from .queries import LABELS


def _reads(name: str, table: str, key: str, sample: str, prefix: str) -> str:
    return f"""{name}_lines AS (SELECT {key} AS id, {sample} AS sample, unnest(string_split(text, chr(10))) AS words, unnest(range(len(string_split(text, chr(10))))) AS line FROM {table}),
{name}_seqs AS (SELECT *, regexp_extract_all(upper(translate(regexp_replace(lower(words), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}')), '.{{1,{LONGEST}}}') AS seqs FROM {name}_lines),
{name}_raw AS (SELECT id, line, sample, words, unnest(seqs) AS seq, unnest(range(len(seqs))) AS piece FROM {name}_seqs),
{name} AS (SELECT id * {ITEM} + line * 1000 + piece AS seqno, '{prefix}' || id || '.' || line || '.' || piece || ';size=' || (1 + id % 7) AS header, seq, substr(translate(repeat(md5(words || '#' || piece), length(seq) // 32 + 1), '{DIGITS}', '{QUALS}'), 1, length(seq)) AS qual, 1 + id % 7 AS size, sample FROM {name}_raw WHERE length(seq) > 0)"""


READS = _reads("reads", "documents", "doc_id", "source", "d")
REFS = _reads("refs", "benchmark", "item_id", "NULL", "b")
POS = """pos AS (SELECT seqno, length(seq) AS n, unnest(range(1, length(seq) + 1)) AS pos, qual FROM reads),
sym AS (SELECT seqno, n, pos, ascii(substr(qual, pos, 1)) - 33 AS q FROM pos),
err AS (SELECT *, pow(10.0, -q / 10.0) AS p FROM sym),
run AS (SELECT *, sum(p) OVER w AS ee, min(q) OVER w AS low FROM err WINDOW w AS (PARTITION BY seqno ORDER BY pos ROWS UNBOUNDED PRECEDING))"""
RUNS = """chars AS (SELECT seqno, unnest(range(1, length(seq) + 1)) AS pos, seq FROM reads),
symbols AS (SELECT seqno, pos, substr(seq, pos, 1) AS s FROM chars),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY seqno, s ORDER BY pos) AS island FROM symbols),
stretches AS (SELECT seqno, s, island, min(pos) AS a, count(*) AS len FROM islands GROUP BY ALL)"""


def rc(x: str) -> str:
    return f"reverse(translate({x}, '{SYMBOLS}', '{COMPLEMENTS}'))"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def words(name: str, source: str, k: int = 8) -> str:
    return f"""{name}_at AS (SELECT seqno, seq, unnest(range(1, length(seq) - {k} + 2)) AS place FROM {source}),
{name} AS (SELECT DISTINCT seqno, substr(seq, place, {k}) AS word FROM {name}_at WHERE regexp_full_match(substr(seq, place, {k}), '[ACGTU]+'))"""


U = """uniq AS (SELECT min(seqno) AS seqno, seq, CAST(sum(size) AS BIGINT) AS size, count(*) AS members FROM reads WHERE length(seq) >= 32 GROUP BY seq)"""
N6 = "CAST(ceil(length(seq) * 0.6) AS BIGINT)"
PAIRS = f"""fwd AS (SELECT seqno, header, substr(seq, 1, {N6}) AS seq, substr(qual, 1, {N6}) AS qual, size FROM reads),
rev AS (SELECT seqno, header, {rc(f'right(seq, {N6})')} AS seq, reverse(right(qual, {N6})) AS qual, size FROM reads)"""


def scan(source: str, name: str, test: str) -> str:
    """Rows cut before the first position at which ``test`` holds."""
    return f"""{name}_pos AS (SELECT seqno, unnest(range(1, length(seq) + 1)) AS pos, qual FROM {source}),
{name}_err AS (SELECT seqno, pos, ascii(substr(qual, pos, 1)) - 33 AS q, pow(10.0, -(ascii(substr(qual, pos, 1)) - 33) / 10.0) AS p FROM {name}_pos),
{name}_run AS (SELECT *, sum(p) OVER (PARTITION BY seqno ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ee FROM {name}_err),
{name}_stop AS (SELECT seqno, min(pos) AS stop FROM {name}_run WHERE {test} GROUP BY seqno),
{name} AS (SELECT s.seqno, s.header, s.size, coalesce(t.stop - 1, length(s.seq)) AS len, substr(s.seq, 1, coalesce(t.stop - 1, length(s.seq))) AS seq,
  coalesce((SELECT r.ee FROM {name}_run r WHERE r.seqno = s.seqno AND r.pos = coalesce(t.stop - 1, length(s.seq))), 0.0) AS ee FROM {source} s LEFT JOIN {name}_stop t USING (seqno))"""


STRICT = f"""cutoff AS (SELECT seqno, header, size, substr(seq, 4, greatest(length(seq) - 5, 0)) AS seq, substr(qual, 4, greatest(length(seq) - 5, 0)) AS qual FROM reads),
{scan("cutoff", "done", "q <= 4")},
verdict AS (SELECT *, (ee > 2.0 OR len < 20 OR length(seq) <> length(replace(seq, 'N', ''))) AS bad FROM done)"""

SOFT = f"""{RUNS},
soft AS (SELECT seqno, string_agg(CASE WHEN len >= 3 THEN lower(repeat(s, len)) ELSE repeat(s, len) END, '' ORDER BY a) AS seq FROM stretches GROUP BY seqno)"""

EXACT = "hits AS (SELECT q.seqno AS q, t.seqno AS t, q.header AS q_header, t.header AS t_header, q.size AS q_size, length(q.seq) AS n FROM {q} q JOIN {t} t ON q.seq = t.seq)"
TAX = "concat('d:d', (seqno // {0}) % 2, ',p:p', (seqno // {0}) % 4, ',g:g', (seqno // {0}) % 8, ',s:s', (seqno // {0}) % 64)".format(ITEM)
SITES = """at_ AS (SELECT seqno, seq, unnest(range(1, length(seq) - 1)) AS i FROM reads WHERE length(seq) >= 3),
sites AS (SELECT seqno, seq, i FROM at_ WHERE regexp_full_match(substr(seq, i, 3), 'G[AG]C')),
cuts AS (SELECT seqno, seq, i, 0 AS strand, i - 1 + 1 AS cut FROM sites UNION ALL SELECT seqno, seq, i, 1, i - 1 + 3 FROM sites),
ends AS (SELECT DISTINCT seqno, seq, strand, 0 AS cut FROM cuts UNION ALL SELECT seqno, seq, strand, cut FROM cuts UNION ALL SELECT DISTINCT seqno, seq, strand, length(seq) FROM cuts),
spans AS (SELECT seqno, seq, strand, cut, lead(cut) OVER w AS stop, row_number() OVER w - 1 AS part FROM ends WINDOW w AS (PARTITION BY seqno, strand ORDER BY cut))"""

P = "percentile_disc({f}) WITHIN GROUP (ORDER BY {c})"
TO_P = "CASE WHEN {0} < 2 THEN 0.75 ELSE pow(10.0, -{0} / 10.0) END"
TO_Q = "greatest(0, least(41, CAST(floor(-10.0 * log10({0})) AS INTEGER)))"


def folded(new: str) -> str:
    """Qualities of equal sequences folded in seqno order; ``new`` is an error probability of ``z``, a pair of scores."""
    return f"""each_ AS (SELECT seq, seqno, size, list_transform(string_split(qual, ''), lambda c: ascii(c) - 33) AS q FROM reads),
lists AS (SELECT seq, min(seqno) AS seqno, CAST(sum(size) AS BIGINT) AS size, list(struct_pack(n := size, q := q) ORDER BY seqno) AS every FROM each_ GROUP BY seq),
folds AS (SELECT seqno, seq, size, list_reduce(every, lambda s, x: struct_pack(n := s.n + x.n, q := list_transform(list_zip(s.q, x.q), lambda z: {TO_Q.format(new)}))).q AS q FROM lists)
SELECT seqno, seq, size, array_to_string(list_transform(q, lambda v: chr(v + 33)), '') AS qual FROM folds"""


ORACLES = {
    "derep_prefix": with_(READS, "u AS (SELECT min(seqno) AS seqno, arg_min(header, seqno) AS header, seq, CAST(sum(size) AS BIGINT) AS size, count(*) AS members FROM reads GROUP BY seq)", "up AS (SELECT a.seqno, arg_min(b.seqno, struct_pack(l := length(b.seq), s := -b.size, h := b.header, n := b.seqno)) AS parent FROM u a JOIN u b ON b.seq > a.seq AND b.seq < a.seq || '~' GROUP BY a.seqno)").replace("WITH ", "WITH RECURSIVE ", 1) + ", walk AS (SELECT seqno, seqno AS root FROM u UNION ALL SELECT w.seqno, p.parent FROM walk w JOIN up p ON p.seqno = w.root) SELECT w.root AS seqno, CAST(sum(u.size) AS BIGINT) AS size, CAST(sum(u.members) AS BIGINT) AS members FROM walk w JOIN u USING (seqno) WHERE w.root NOT IN (SELECT seqno FROM up) GROUP BY w.root",
    "fastx_uniques": with_(READS) .rstrip() + ",\n" + folded(f"(({TO_P.format('z[1]')}) * s.n + ({TO_P.format('z[2]')}) * x.n) / (s.n + x.n)"),
    "fastx_uniques_best": with_(READS).rstrip() + ",\n" + folded(f"least({TO_P.format('z[1]')}, {TO_P.format('z[2]')})"),
    "shuffle": with_(READS) + "SELECT seqno FROM reads",
    "fastx_subsample_total": with_(READS) + "SELECT CAST(floor(sum(size) * 10.0 / 100) AS BIGINT) AS drawn, CAST(0 AS BIGINT) AS above, count(*) AS reads FROM reads",
    "maskfasta_soft": with_(READS, SOFT) + "SELECT seqno, regexp_replace(seq, '[a-z]', 'N', 'g') AS seq FROM soft",
    "search_exact_tests": with_(READS, REFS) + "SELECT q.seqno AS q, t.seqno AS t FROM refs q JOIN reads t ON q.seq = t.seq WHERE q.size <= 5 AND t.size >= 2 AND q.size >= 0.5 * t.size AND q.size <= 2.0 * t.size AND length(q.seq) >= 8 AND q.header <> t.header",
    "derep_fulllength": with_(READS, U) + "SELECT u.seqno, r.header, u.seq, u.size, u.members FROM uniq u JOIN reads r USING (seqno)",
    "derep_fulllength_both": with_(READS, f"k AS (SELECT *, least(seq, {rc('seq')}) AS key FROM reads WHERE length(seq) >= 32)") + "SELECT min(seqno) AS seqno, arg_min(header, seqno) AS header, arg_min(seq, seqno) AS seq, CAST(sum(size) AS BIGINT) AS size, count(*) AS members FROM k GROUP BY key",
    "derep_fulllength_minsize": with_(READS) + "SELECT min(seqno) AS seqno, count(*) AS size FROM reads WHERE length(seq) >= 32 GROUP BY seq HAVING count(*) >= 2",
    "derep_id": with_(READS) + "SELECT min(seqno) AS seqno, header, seq, CAST(sum(size) AS BIGINT) AS size, count(*) AS members FROM reads WHERE length(seq) >= 32 GROUP BY header, seq",
    "derep_smallmem": with_(READS) + "SELECT min(seqno) AS seqno, seq, CAST(sum(size) AS BIGINT) AS size FROM reads GROUP BY seq",
    "derep_stats": with_(READS, U) + "SELECT count(*) AS clusters, avg(size) AS avg_size, median(size) AS median_size, max(size) AS max_size FROM uniq",
    "sortbysize_top": with_(READS, U) + "SELECT seqno, u.size FROM uniq u JOIN (SELECT seqno, header FROM reads) USING (seqno) ORDER BY u.size DESC, header, seqno LIMIT 100",
    "sortbylength_top": with_(READS) + "SELECT seqno, length(seq) AS len, size FROM reads ORDER BY length(seq) DESC, size DESC, header, seqno LIMIT 100",
    "rereplicate": with_(READS) + "SELECT seqno, regexp_replace(header, ';size=[0-9]+', '') AS header, 1 AS size, size AS copies FROM reads",
    "fastx_revcomp": with_(READS) + f"SELECT seqno, header || '_rc' AS header, {rc('seq')} AS seq, reverse(qual) AS qual FROM reads",
    "fastx_getsubseq": with_(READS) + "SELECT seqno, substr(seq, 11, 50) AS seq, substr(qual, 11, 50) AS qual FROM reads",
    "fastq_convert": with_(READS) + "SELECT seqno, translate(qual, '{}', '{}') AS qual FROM reads".format("".join(chr(33 + q) for q in range(42)).replace("'", "''"), "".join(chr(64 + min(38, max(5, q))) for q in range(42)).replace("'", "''")),
    "fasta2fastq": with_(READS) + "SELECT seqno, repeat('J', length(seq)) AS qual FROM reads",
    "fastx_mask_hard": with_(READS, SOFT) + "SELECT seqno, regexp_replace(seq, '[a-z]', 'N', 'g') AS seq FROM soft",
    "fastx_mask_unmasked": with_(READS, SOFT) + "SELECT * FROM (SELECT seqno, 100.0 * length(regexp_replace(seq, '[^A-Z]', '', 'g')) / length(seq) AS unmasked FROM soft) WHERE unmasked BETWEEN 80 AND 99",
    "fastq_join": with_(READS, PAIRS) + f"SELECT f.seqno, f.seq || 'NNNNNNNN' || {rc('r.seq')} AS seq, f.qual || 'IIIIIIII' || reverse(r.qual) AS qual FROM fwd f JOIN rev r USING (seqno)",
    "relabel_md5": with_(READS) + "SELECT seqno, md5(seq) AS header FROM reads",
    "relabel_prefix": with_(READS) + "SELECT seqno, 'r' || row_number() OVER (ORDER BY seqno) AS header FROM reads",
    "xsize": with_(READS) + "SELECT seqno, regexp_replace(header, ';size=[0-9]+', '') AS header FROM reads",
    "cut_ecori": with_(READS, SITES) + f"SELECT seqno, part, strand, CASE WHEN strand = 1 THEN {rc('substr(seq, cut + 1, stop - cut)')} ELSE substr(seq, cut + 1, stop - cut) END AS seq FROM spans WHERE stop > cut",
    "fastq_filter": with_(READS, STRICT) + "SELECT seqno, seq, round(ee, 6) AS ee FROM verdict WHERE NOT bad",
    "fastq_filter_discarded": with_(READS, STRICT) + "SELECT seqno FROM verdict WHERE bad",
    "fastq_filter_truncee": with_(READS, "keep_ AS (SELECT seqno, header, size, substr(seq, 1, 80) AS seq, substr(qual, 1, 80) AS qual, length(seq) AS n FROM reads)", scan("keep_", "done", "ee > 1.0")) + "SELECT seqno, len, round(ee, 6) AS ee, (len < 1 OR (len > 0 AND ee > 0.05 * len)) AS discarded, len < k.n AS truncated FROM done JOIN (SELECT seqno, n FROM keep_) k USING (seqno)",
    "fastq_filter_pairs": with_(READS, PAIRS, scan("fwd", "a", "false"), scan("rev", "b", "false")) + "SELECT a.seqno, a.seq, b.seq AS rev_seq FROM a JOIN b USING (seqno) WHERE a.ee <= 1.0 AND b.ee <= 1.0 AND a.len >= 1 AND b.len >= 1",
    "fastx_getseq": with_(READS) + "SELECT seqno, header FROM reads WHERE contains(lower(header), 'd1')",
    "fastx_getseqs": with_(READS) + "SELECT seqno, header FROM reads WHERE lower(header) IN ({})".format(", ".join(f"'{x.lower()}'" for x in LABELS)),
    "fastx_getseqs_not": with_(READS) + "SELECT seqno FROM reads WHERE lower(header) NOT IN ({})".format(", ".join(f"'{x.lower()}'" for x in LABELS)),
    "fastx_getseqs_word": with_(READS) + "SELECT seqno FROM reads WHERE size = 3",
    "length_window": with_(READS) + "SELECT seqno FROM reads WHERE length(seq) BETWEEN 50 AND 200 AND size BETWEEN 2 AND 5",
    "fastx_syncpairs": with_(READS) + "SELECT coalesce(f.header, r.header) AS key, f.header || '/1' AS fwd, r.header || '/2' AS rev, CASE WHEN f.header IS NULL THEN 'rev' WHEN r.header IS NULL THEN 'fwd' ELSE 'pair' END AS state FROM (SELECT header FROM reads WHERE size <> 3) f FULL JOIN (SELECT header FROM reads WHERE size <> 5) r ON f.header = r.header",
    "fastq_chars": with_(READS, RUNS) + "SELECT s AS symbol, CAST(sum(len) AS BIGINT) AS count, max(len) - 1 AS longest FROM stretches GROUP BY s",
    "fastq_chars_tails": with_(READS) + "SELECT right(seq, 1) AS symbol, count(*) AS tails FROM reads WHERE length(seq) >= 4 AND right(seq, 4) = repeat(right(seq, 1), 4) GROUP BY 1",
    "fastq_chars_symbols": with_(READS, POS) + "SELECT chr(min(q) + 33) AS qual_min, chr(max(q) + 33) AS qual_max, CASE WHEN min(q) + 33 < 59 OR max(q) + 33 < 75 THEN 33 ELSE 64 END AS \"offset\" FROM sym",
    "fastq_stats_lengths": with_(READS) + "SELECT len, n, CAST(sum(n) OVER (ORDER BY len DESC) AS BIGINT) AS longer FROM (SELECT length(seq) AS len, count(*) AS n FROM reads GROUP BY 1)",
    "fastq_stats_scores": with_(READS, POS) + "SELECT q, count(*) AS n FROM sym GROUP BY q",
    "fastq_stats_positions": with_(READS, POS) + "SELECT pos, count(*) AS recs, round(avg(q), 6) AS avg_q, round(avg(p), 6) AS avg_p, round(avg(ee), 6) AS avg_ee FROM run GROUP BY pos",
    "fastq_stats_errors": with_(READS, POS) + "SELECT pos, count(*) FILTER (ee <= 1.0) AS ee_1_0, count(*) FILTER (ee <= 0.5) AS ee_0_5, count(*) FILTER (ee <= 0.25) AS ee_0_25, count(*) FILTER (ee <= 0.1) AS ee_0_1 FROM run GROUP BY pos",
    "fastq_stats_minq": with_(READS, POS) + "SELECT pos, " + ", ".join(f"count(*) FILTER (low > {q}) AS q_{q}" for q in (5, 10, 15, 20)) + " FROM run GROUP BY pos",
    "fastq_eestats": with_(READS, POS, "b AS (SELECT *, floor(1000 * ee + 1e-9) AS bin FROM run)") + "SELECT pos, count(*) AS recs, min(q) AS q_min, round(avg(q), 6) AS q_mean, max(q) AS q_max, round(avg(p), 6) AS pe_mean, round(avg(ee), 6) AS ee_mean, " + ", ".join(f"{P.format(f=f, c='q')} AS q_{n}, round(({P.format(f=f, c='bin')} + 0.5) / 1000, 6) AS ee_{n}" for f, n in ((0.25, "lo"), (0.5, "med"), (0.75, "hi"))) + " FROM b GROUP BY pos",
    "fastq_eestats2": with_(READS, POS) + "SELECT pos AS len, e AS ee, count(*) FILTER (run.ee <= e) AS n FROM run, (VALUES (0.5), (1.0), (2.0)) v(e) WHERE pos % 50 = 0 GROUP BY pos, e",
    "db_stats": with_(READS) + "SELECT CAST(sum(length(seq)) AS BIGINT) AS nucleotides, count(*) AS sequences, min(length(seq)) AS shortest, max(length(seq)) AS longest, avg(length(seq)) AS average FROM reads",
    "kmers_distinct": with_(REFS, words("w", "refs")) + "SELECT seqno, count(*) AS words FROM w GROUP BY seqno",
    "shared_kmers": with_(READS, REFS, "ok AS (SELECT * FROM reads WHERE length(seq) >= 32)", words("a", "refs"), words("b", "ok")) + "SELECT a.seqno AS q, b.seqno AS t, count(*) AS shared FROM a JOIN b USING (word) GROUP BY 1, 2 HAVING count(*) >= 12",
    "usearch_candidates": with_(READS, REFS, U, words("a", "refs"), words("b", "uniq"), "n AS (SELECT seqno, count(*) AS words FROM a GROUP BY seqno)", "c AS (SELECT a.seqno AS q, b.seqno AS t, count(*) AS shared FROM a JOIN b USING (word) GROUP BY 1, 2)", "short_ AS (SELECT seqno AS t FROM uniq ORDER BY length(seq), seqno LIMIT 41)", "every AS (SELECT c.* FROM c JOIN n ON c.q = n.seqno WHERE shared >= least(12, words) UNION ALL SELECT r.seqno, s.t, 0 FROM refs r, short_ s WHERE r.seqno NOT IN (SELECT seqno FROM n))", "r AS (SELECT q, t, shared, row_number() OVER (PARTITION BY q ORDER BY shared DESC, length(u.seq), t) AS rank FROM every JOIN uniq u ON u.seqno = t)") + "SELECT * FROM r WHERE rank <= 41",
    "udbstats": with_(READS, words("w", "reads")) + "SELECT postings, count(*) AS words FROM (SELECT word, count(*) AS postings FROM w GROUP BY word) GROUP BY postings",
    "udbstats_top": with_(READS, words("w", "reads")) + "SELECT word, count(*) AS postings FROM w GROUP BY word ORDER BY postings DESC, word LIMIT 10",
    "orient": with_(READS, REFS, f"mixed AS (SELECT seqno, CASE WHEN size % 3 = 0 THEN {rc('seq')} ELSE seq END AS seq FROM reads)", words("a", "mixed", 12), words("b", "refs", 12), "n AS (SELECT word, count(*) AS n FROM b GROUP BY word)", f"v AS (SELECT a.seqno, coalesce(x.n, 0) AS ahead, coalesce(y.n, 0) AS behind FROM a LEFT JOIN n x ON x.word = a.word LEFT JOIN n y ON y.word = {rc('a.word')})", "s AS (SELECT m.seqno, count(*) FILTER (ahead > 8 * behind) AS forward, count(*) FILTER (behind > 8 * ahead) AS reverse FROM mixed m LEFT JOIN v USING (seqno) GROUP BY m.seqno)") + "SELECT seqno, forward, reverse, CASE WHEN forward >= 1 AND forward >= 4 * reverse THEN '+' WHEN reverse >= 1 AND reverse >= 4 * forward THEN '-' ELSE '?' END AS strand FROM s",
    "search_exact": with_(READS, REFS, EXACT.format(q="refs", t="reads")) + "SELECT q, t, 0 AS strand, n || 'M' AS cigar, 100.0 AS id FROM hits",
    "search_exact_both": with_(READS, REFS, f"turned AS (SELECT seqno, {rc('seq')} AS seq FROM refs)") + f"SELECT q.seqno AS q, t.seqno AS t, 0 AS strand FROM turned q JOIN reads t ON q.seq = t.seq UNION ALL SELECT q.seqno, t.seqno, 1 FROM turned q JOIN reads t ON {rc('q.seq')} = t.seq",
    "search_notmatched": with_(READS, REFS) + "SELECT seqno FROM refs WHERE seq NOT IN (SELECT seq FROM reads)",
    "search_dbmatched": with_(READS, REFS, EXACT.format(q="refs", t="reads")) + "SELECT t AS seqno, CAST(sum(q_size) AS BIGINT) AS hits FROM hits GROUP BY t",
    "otu_table": with_(READS, REFS, EXACT.format(q="reads", t="refs")) + "SELECT split_part(t_header, ';', 1) AS otu, sample, CAST(sum(q_size) AS BIGINT) AS n FROM hits JOIN (SELECT seqno AS q, sample FROM reads) USING (q) GROUP BY 1, 2",
    "lca": with_(READS, REFS, f"tagged AS (SELECT seqno, seq, {TAX} AS tax FROM refs)", "hits AS (SELECT r.seqno AS q, t.tax FROM reads r JOIN tagged t ON r.seq = t.seq)", "names AS (SELECT q, unnest(range(4)) AS level, unnest(string_split(tax, ',')) AS name FROM hits)", "c AS (SELECT q, level, name, count(*) AS n FROM names GROUP BY ALL)", "top AS (SELECT *, row_number() OVER (PARTITION BY q, level ORDER BY n DESC, name) AS nth FROM c)", "ok AS (SELECT q, level, name, n >= 0.6 * (SELECT count(*) FROM hits h WHERE h.q = top.q) AS ok FROM top WHERE nth = 1)", "held AS (SELECT *, bool_and(ok) OVER (PARTITION BY q ORDER BY level ROWS UNBOUNDED PRECEDING) AS so_far FROM ok)") + "SELECT q, coalesce(string_agg(name, ',' ORDER BY level) FILTER (so_far), '') AS lineage FROM held GROUP BY q",
}
