"""Toxicity: a learned lexicon trie, intersected with Levenshtein automata, read in context.

Training finds the words and stems whose documents are toxic. Their trie is
intersected with the automaton of at most one edit (insertion, deletion,
substitution or transposition) into one deterministic table, which reads all
words of a batch at once. Each hit is classed by its edits and by its context
window: inside quotation or reported speech, addressed to someone, or plain. The
precision of each class on the training rows is its score, so quoted terms count
for as little as the labels say they should.

Scale: the fit reads a bounded sample of labelled rows (``Fit.sample``); scoring
is one pass over the texts without any shuffle, with a table of some megabytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep
from .shingles import shingle_sets

#: Words of address and of reported speech, and quotation marks.
ADDRESS = ["you", "your", "youre", "u", "du", "dich", "dein", "sie", "ihr", "tu", "toi", "ton", "vous", "votre", "tú", "usted", "eres", "vosotros"]
REPORTED = ["said", "says", "wrote", "called", "quote", "quoted", "quoting", "word", "sagte", "schrieb", "zitat", "dit", "écrit", "mot", "dijo", "escribió", "palabra"]
QUOTES = "\"“”„«»‹›"

PLAIN, QUOTED, DIRECT = 0, 1, 2
#: Code points read at once; bounds memory, not the length of a text.
STEP = 1 << 19
#: Stands for letters and digits beyond the first 65,536 code points; no term has them.
OTHER_LETTER = 0xE000
_WORD_CHAR = np.array([chr(i).isalnum() if not 0xD800 <= i < 0xE000 else False for i in range(65536)])
_WORD_CHAR[OTHER_LETTER] = True


@dataclass(frozen=True)
class Fit:
    """``sample`` bounds the labelled rows that the fit reads, taken by hash of the id."""

    sample: int = 20_000
    #: A term is in this share of the sample's toxic documents at least, and in too many to be chance.
    support: float = 0.002
    #: Share of toxic documents among those that have the term.
    purity: float = 0.85
    #: Letters of a stem; whole words may have fewer or more.
    min_stem: int = 4
    max_length: int = 14
    window: int = 8
    #: Weight of a kind's overall precision against that of its single terms.
    prior: float = 3.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


# ---------------------------------------------------------------- automaton


@dataclass
class Trie:
    """Nodes by prefix; an entry is a whole word or a stem."""

    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    entry: list[int] = field(default_factory=lambda: [-1])

    def add(self, text: str, number: int) -> None:
        at = 0
        for c in text:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
                self.entry.append(-1)
            at = self.children[at][c]
        self.entry[at] = number


@dataclass
class Automaton:
    """``table[state, class]``; ``result[state]`` is 2 * entry + edits of a word that ends there, or -1."""

    classes: np.ndarray
    table: np.ndarray
    result: np.ndarray
    steps: int


def intersect(terms: list[tuple[str, bool]]) -> Automaton:
    """The table of all words within one edit of ``(text, is_stem)`` terms; short terms only as they are."""
    trie = Trie()
    for i, (text, _) in enumerate(terms):
        trie.add(text, i)
    fuzzy = [len(t) >= (6 if stem else 5) for t, stem in terms]
    # A branch may spend its edit only if some entry below it may be misspelled.
    bends = [False] * len(trie.children)
    for i in range(len(trie.children) - 1, -1, -1):
        e = trie.entry[i]
        bends[i] = (e >= 0 and fuzzy[e]) or any(bends[c] for c in trie.children[i].values())
    alphabet = sorted({c for t, _ in terms for c in t})

    def close(items: set) -> frozenset:
        """Skipped letters, and stems that are complete whatever follows."""
        out = set(items)
        for x in items:
            if x[0] == "at" and x[2] == 0 and x[3] is None and bends[x[1]]:
                out.update(("at", c, 1, None) for c in trie.children[x[1]].values() if bends[c])
        for x in list(out):
            if x[0] == "at" and x[3] is None and (e := trie.entry[x[1]]) >= 0 and terms[e][1] and (x[2] == 0 or fuzzy[e]):
                out.add(("stem", e, x[2], None))
        return frozenset(out)

    def move(items: frozenset, c: str | None) -> frozenset:
        out = set()
        for kind, node, edits, wait in items:
            if kind == "stem":
                out.add((kind, node, edits, wait))
            elif wait is not None:
                if c == wait[0]:
                    out.add(("at", wait[1], 1, None))
            else:
                kids = trie.children[node]
                if c in kids:
                    out.add(("at", kids[c], edits, None))
                if edits == 0 and bends[node]:
                    out.add(("at", node, 1, None))
                    for a, kid in kids.items():
                        if bends[kid]:
                            if a != c:
                                out.add(("at", kid, 1, None))
                            if c in trie.children[kid] and a != c:
                                out.add(("at", kid, 1, (a, trie.children[kid][c])))
        return close(out)

    def accepts(items: frozenset) -> int:
        best = min(((x[2], e) for x in items if x[3] is None and (e := x[1] if x[0] == "stem" else trie.entry[x[1]]) >= 0 and (x[2] == 0 or fuzzy[e])), default=None)
        return -1 if best is None else 2 * best[1] + best[0]

    start, dead = close({("at", 0, 0, None)}), frozenset()
    states, queue, rows, result = {dead: 0, start: 1}, [start], [[0] * (len(alphabet) + 1)], [-1]
    for items in queue:
        result.append(accepts(items))
        row = []
        for c in [None, *alphabet]:
            to = move(items, c)
            if to not in states:
                states[to] = len(states)
                queue.append(to)
            row.append(states[to])
        rows.append(row)
    classes = np.zeros(65536, dtype=np.uint8 if len(alphabet) < 255 else np.uint16)
    for i, c in enumerate(alphabet):
        if ord(c) < 65536:
            classes[ord(c)] = i + 1
    return Automaton(classes, np.array(rows, dtype=np.int32), np.array(result, dtype=np.int32), max((len(t) for t, _ in terms), default=0) + 1)


def read(automaton: Automaton, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``points``, and each word's result."""
    solid = _WORD_CHAR[points]
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    states = np.ones(len(starts), dtype=np.int32)
    live = np.arange(len(starts))
    for j in range(automaton.steps):
        live = live[(ends[live] - starts[live] > j) & (states[live] > 0)]
        if not len(live):
            break
        states[live] = automaton.table[states[live], automaton.classes[points[starts[live] + j]]]
    # A longer word stays only in states that no further letter leaves.
    longer = np.flatnonzero((ends - starts > automaton.steps) & (states > 0))
    settled = automaton.table[states[longer], 0]
    states[longer] = settled
    return starts, ends, automaton.result[states]


# ------------------------------------------------------------------ context


def _windows(text: str, starts: np.ndarray, ends: np.ndarray, hits: np.ndarray, window: int) -> list[int]:
    """The context of each hit, a number of a word of ``text``."""
    out = []
    for i in hits.tolist():
        a, b = max(0, i - window), min(len(starts), i + window + 1)
        words = {text[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)}
        left = text[starts[a] : starts[i]]
        right = text[ends[i] : ends[b - 1] + 2]
        quoted = sum(left.count(q) for q in QUOTES) % 2 == 1 and any(q in right for q in QUOTES)
        if quoted or not words.isdisjoint(REPORTED):
            out.append(QUOTED)
        else:
            out.append(DIRECT if not words.isdisjoint(ADDRESS) else PLAIN)
    return out


def hits(texts: list, automaton: Automaton, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """``(entry, edits, context)`` of each hit of each text; none for null and empty texts."""
    group, size = [], 0
    for text in [*texts, ...]:
        low = "" if text is None or text is ... else text.lower()
        if group and (text is ... or size + len(low) > STEP):
            yield from _hits(group, automaton, window)
            group, size = [], 0
        group.append(low)
        size += len(low) + 1


def _hits(group: list[str], automaton: Automaton, window: int) -> list[list[tuple[int, int, int]]]:
    joined = "\n".join(group)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    beyond = np.flatnonzero(points > 65535)
    if len(beyond):
        own, inverse = np.unique(points[beyond], return_inverse=True)
        points = points.copy()
        points[beyond] = np.array([OTHER_LETTER if chr(x).isalnum() else 0 for x in own.tolist()], dtype=np.uint32)[inverse]
    starts, ends, result = read(automaton, points)
    bounds = np.cumsum([0, *(len(x) + 1 for x in group)])
    found: list[list[tuple[int, int, int]]] = [[] for _ in group]
    at = np.flatnonzero(result >= 0)
    owner = np.searchsorted(bounds, starts[at], side="right") - 1
    for d in np.unique(owner).tolist():
        lo, hi = np.searchsorted(starts, bounds[d]), np.searchsorted(starts, bounds[d + 1])
        own = at[owner == d]
        contexts = _windows(group[d], starts[lo:hi] - bounds[d], ends[lo:hi] - bounds[d], own - lo, window)
        found[d] = [(int(result[i]) >> 1, int(result[i]) & 1, c) for i, c in zip(own.tolist(), contexts, strict=True)]
    return found


# --------------------------------------------------------------------- fit


def _prefixes(text: str | None, fit: Fit) -> set[str]:
    """Distinct prefixes and, with a blank after them, whole words of a text."""
    out: set[str] = set()
    low = (text or "").lower()
    for word in {w for w in "".join(c if c.isalnum() else " " for c in low).split()}:
        out.update(word[:n] for n in range(fit.min_stem, min(len(word), fit.max_length) + 1))
        out.add(word + " ")
    return out


def _count(rows: DataFrame, fit: Fit, only: set[str] | None) -> DataFrame:
    """Documents of each label that have each prefix, summed within batches first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                sums: dict[str, list[int]] = {}
                for text, toxic in zip(batch["text"].iloc[at : at + 500], batch["toxic"].iloc[at : at + 500], strict=True):
                    own = _prefixes(text, fit)
                    for p in own if only is None else own & only:
                        sums.setdefault(p, [0, 0])[toxic] += 1
                yield pd.DataFrame([(p, *n) for p, n in sums.items()], columns=["prefix", "clean", "toxic"])

    return rows.mapInPandas(run, "prefix string, clean long, toxic long").groupBy("prefix").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _least(base: float, tries: int) -> float:
    """Toxic documents, and no others, that a prefix must be in before chance is unlikely among so many tries."""
    return max(3.0, math.log(0.05 / max(1, tries)) / math.log(min(0.9, max(base, 1e-6))))


def _one_of_each(rows: DataFrame) -> DataFrame:
    """One row of texts that share their least word shingle, so that copies don't count as evidence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            least = [int(x[0]) if len(x) else 0 for x in shingle_sets(batch["text"].tolist(), 4)]
            yield batch.assign(twin=np.array(least, dtype=np.uint64).view(np.int64))

    return rows.mapInPandas(run, "text string, toxic int, twin long").groupBy("twin", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def choose(counts: dict[str, tuple[int, int]], total: int, base: float, fit: Fit) -> list[tuple[str, bool]]:
    """Terms among prefixes with ``(clean, toxic)`` counts: the shortest pure node, or the word it always grows into, and pure words without one."""
    least = max(fit.support * total, _least(base, len(counts)))
    pure = {p for p, (clean, toxic) in counts.items() if toxic >= least and toxic >= fit.purity * (toxic + clean)}
    terms: dict[str, bool | None] = {}
    for p in sorted((x for x in pure if not x.endswith(" ")), key=lambda x: (len(x), x)):
        if any(p[:n] in terms for n in range(fit.min_stem, len(p))):
            continue
        node, stem = p, True
        while stem:
            enough = 0.9 * counts[node][1]
            if counts.get(node + " ", (0, 0))[1] >= enough:
                stem = False
                break
            longer = [q for q in pure if len(q) == len(node) + 1 and q.startswith(node) and not q.endswith(" ") and counts[q][1] >= enough]
            if not longer:
                break
            node = longer[0]
        terms[p] = None  # keeps longer prefixes of this node out
        terms[node] = stem
    for word in sorted(x[:-1] for x in pure if x.endswith(" ")):
        if not any(word[:n] in terms for n in range(fit.min_stem, len(word) + 1)):
            terms[word] = False
    chosen = [(t, s) for t, s in terms.items() if s is not None]
    return sorted(chosen, key=lambda x: (-counts[x[0] if x[1] else f"{x[0]} "][1], x[0]))


@dataclass
class Model:
    automaton: Automaton
    #: Score by (entry, edits, context), and by (edits, context, is_stem) for those never seen.
    scores: dict[tuple[int, int, int], float]
    kinds: dict[tuple[int, int, bool], float]
    stems: list[bool]
    nothing: float
    window: int
    terms: list[tuple[str, bool]]

    def score(self, found: list[tuple[int, int, int]]) -> float:
        """The highest score of a hit; more hits bring it a little nearer to 1."""
        if not found:
            return self.nothing
        each = sorted({x: self.scores.get(x, self.kinds.get((x[1], x[2], self.stems[x[0]]), self.nothing)) for x in found}.values())[::-1]
        return each[0] + (1 - each[0]) * 0.5 * min(1.0, sum(each[1:]) / 10) if each[0] >= 0.5 else max(each[0], self.nothing)


def train(docs: DataFrame, labels: DataFrame, fit: Fit | None = None) -> Model:
    """Fit on rows of ``labels(doc_id, toxic)`` whose id isn't held out; without any, every score is 0."""
    fit = fit or Fit()
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(fit.sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = keep(_one_of_each(rows))
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    base = toxic / max(1, clean + toxic)
    least = max(3, fit.support * toxic)
    first = _count(rows.where("toxic = 1"), fit, None).where(F.col("toxic") >= least)
    only = {r.prefix for r in first.select("prefix").collect()}
    counts = {r.prefix: (r.clean, r.toxic) for r in _count(rows, fit, only).collect()} if only else {}
    terms = choose(counts, toxic, base, fit)
    automaton = intersect(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own, t in zip(hits(batch["text"].tolist(), automaton, fit.window), batch["toxic"].tolist(), strict=True):
                out += [(*x, t) for x in set(own) or {(-1, 0, 0)}]
            yield pd.DataFrame(out, columns=["entry", "edits", "context", "toxic"])

    seen = rows.mapInPandas(run, "entry int, edits int, context int, toxic int").groupBy("entry", "edits", "context").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).collect()
    stems = [s for _, s in terms]
    none = next(((r.t, r.n) for r in seen if r.entry < 0), (0, 0))
    kinds: dict[tuple[int, int, bool], list[float]] = {}
    for r in seen:
        if r.entry >= 0:
            sums = kinds.setdefault((r.edits, r.context, stems[r.entry]), [base, 1.0])
            sums[0] += r.t
            sums[1] += r.n
    rates = {k: t / n for k, (t, n) in kinds.items()}
    scores = {(r.entry, r.edits, r.context): (r.t + fit.prior * rates[(r.edits, r.context, stems[r.entry])]) / (r.n + fit.prior) for r in seen if r.entry >= 0}
    return Model(automaton, scores, rates, stems, (none[0] + base) / (none[1] + 1), fit.window, terms)


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row of ``docs(doc_id, text)``.

    Texts that are null, empty or without any hit have the score of training
    rows without hits. Rows that repeat an id are each scored. Label, language,
    source and id are not read. Other columns are ignored, but for those in
    ``carry``, which come back beside the four (doc_id only once).
    """

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(x) for x in hits(texts.tolist(), model.automaton, model.window)], dtype=float)

    more = [c for c in carry or [] if c != "doc_id"]
    scored = docs.select("doc_id", *more, rate("text").alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)
