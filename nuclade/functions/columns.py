"""Column functions over sequences, qualities and headers; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nucleotide symbols and their complements.
SYMBOLS, COMPLEMENTS = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"
#: Symbols and the nucleotides they stand for, as bits A 1, C 2, G 4, T 8.
IUPAC = {"A": 1, "C": 2, "M": 3, "G": 4, "R": 5, "S": 6, "V": 7, "T": 8, "U": 8, "W": 9, "Y": 10, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15}
#: Ranks of a taxonomy.
RANKS = ["d", "k", "p", "c", "o", "f", "g", "s", "t"]


def normalised(seq: Column) -> Column:
    return F.translate(F.upper(seq), "U", "T")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, SYMBOLS, COMPLEMENTS))


def canonical(seq: Column) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(normalised(seq), reverse_complement(normalised(seq)))


def label(header: Column) -> Column:
    return F.split(header, "[ \t]")[0]


def attribute(header: Column, key: str, value: str = "[^;]*") -> Column:
    """The first value of ``key=`` among ``;``-separated attributes, null without any."""
    return F.nullif(F.regexp_extract(header, f"(?:^|;){key}=({value})(?:;|$)", 1), F.lit(""))


def abundance(header: Column) -> Column:
    return F.coalesce(attribute(header, "size", "[0-9]+").cast("long"), F.lit(1).cast("long"))


def without(header: Column, *keys: str) -> Column:
    """The header without some attributes; what is left is separated by single ``;``."""
    return F.array_join(F.filter(F.split(header, ";"), lambda x: (x != "") & ~F.regexp_like(x, F.lit(f"^(?:{'|'.join(keys)})=[0-9.]*$"))), ";")


def taxonomy(header: Column) -> Column:
    """Names by rank of ``tax=d:..,k:..``."""
    return F.str_to_map(F.coalesce(attribute(header, "tax"), F.lit("")), F.lit(","), F.lit(":"))


def scores(qual: Column, offset: int = 33) -> Column:
    """Quality scores of each symbol."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def error(score: Column) -> Column:
    return F.pow(F.lit(10.0), -score / 10)


def expected_error(qual: Column, offset: int = 33) -> Column:
    return F.aggregate(scores(qual, offset), F.lit(0.0), lambda a, q: a + error(q))


def words(seq: Column, k: int) -> Column:
    """Distinct unambiguous upper-case words of k symbols; lower case is masked."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))
    return F.array_distinct(F.filter(every, lambda w: (F.length(w) == k) & (F.translate(w, "ACGTU", "") == "")))
