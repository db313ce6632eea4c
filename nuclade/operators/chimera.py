"""Chimera detection: parts of a query find parents, the best two are judged by votes along the query.

Candidates come from the same words-and-alignment search as other queries, on
parts of each query as rows of their own; a query's candidates are aligned with
the whole query and judged together. De novo modes take parents among earlier
sequences that aren't chimeras themselves, in rounds until these stay the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .search import Search, globally, side, unaligned_tests
from .shared import drop, keep
from .transforms import numbered

COLUMNS = ["score", "query", "parent_a", "parent_b", "closest", "id_qm", "id_qa", "id_qb", "id_ab", "id_qt", "left_y", "left_n", "left_a", "right_y", "right_n", "right_a", "divergence", "flag"]
SCHEMA = "q long, score double, query string, parent_a string, parent_b string, closest string, id_qm double, id_qa double, id_qb double, id_ab double, id_qt double, left_y int, left_n int, left_a int, right_y int, right_n int, right_a int, divergence double, flag string"
WINDOW = 32


@dataclass(frozen=True)
class Chimera:
    min_h: float = 0.28
    min_div: float = 0.8
    min_diffs: int = 3
    xn: float = 8.0
    dn: float = 1.4
    #: ``ref`` and ``denovo`` judge by score, ``exact`` by a perfect model without a perfect parent, ``long`` by segments.
    rule: str = "ref"
    abskew: float = 2.0
    parts: int = 4
    max_parents: int = 3
    min_length: int = 10
    diff_pct: float = 0.0


def _matches(query: str, target: str, cigar: str) -> np.ndarray:
    """By query position: 1 match, 0 mismatch, -1 next to no target symbol."""
    out, at = np.zeros(len(query), dtype=np.int64), 0
    for a, b in zip(*K.rows_of(query, target, cigar), strict=True):
        if a != "-":
            out[at] = -1 if b == "-" else int(K._CODE[ord(a)] & K._CODE[ord(b)] > 0)
            at += 1
    return out


def parents(match: np.ndarray) -> list[int]:
    """The two candidates that win most windows; the second without the windows that the first won."""
    hit = (match > 0).astype(np.int64)
    chosen: list[int] = []
    smooth = np.zeros((len(hit), hit.shape[1]), dtype=np.int64)
    most = np.zeros(hit.shape[1], dtype=np.int64)
    for turn in range(2):
        if turn:
            for at in np.flatnonzero(smooth[chosen[0]] == most):
                if at >= WINDOW - 1:
                    hit[:, at + 1 - WINDOW : at + 1] = 0
        run = np.cumsum(hit, axis=1)
        run[:, WINDOW:] -= run[:, :-WINDOW].copy()
        run[:, : WINDOW - 1] = 0
        open_ = np.ones(len(hit), dtype=bool)
        open_[chosen] = False
        for i in np.flatnonzero(open_):
            smooth[i] = run[i]
        most = np.where(open_[:, None], smooth, 0).max(axis=0, initial=0)
        wins = ((smooth == most) & (most > 0))[:, WINDOW - 1 :].sum(axis=1)
        wins[~open_] = 0
        if not wins.size or wins.max() <= 0:
            return []
        chosen.append(int(wins.argmax()))
    return chosen


def _three(query: str, targets: list[tuple[str, str]]) -> list[str]:
    """Rows of the query and of targets, with room for each other's insertions."""
    pieces = []
    wide = [0] * (len(query) + 1)
    for target, cigar in targets:
        own, extra, at = [], [""] * (len(query) + 1), 0
        for a, b in zip(*K.rows_of(query, target, cigar), strict=True):
            if a == "-":
                extra[at] += b
            else:
                own.append(b)
                at += 1
        wide = [max(w, len(x)) for w, x in zip(wide, extra, strict=True)]
        pieces.append((own, extra))
    rows = ["".join("-" * w + s for w, s in zip(wide, [*query, ""], strict=True))]
    for own, extra in pieces:
        rows.append("".join(x.ljust(w, "-") + s for x, w, s in zip(extra, wide, [*own, ""], strict=True)))
    return rows


def judge(query: str, label: str, found: list[tuple[str, str, str]], how: Chimera) -> dict:
    """The verdict on a query, given ``(label, sequence, cigar)`` of its candidates."""
    none = dict(zip(COLUMNS, [0.0, label, None, None, None, None, None, None, None, None, 0, 0, 0, 0, 0, 0, None, "N"], strict=True))
    if len(found) < 2 or len(query) < WINDOW:
        return none
    best = parents(np.array([_matches(query, s, c) for _, s, c in found]))
    if len(best) < 2:
        return none
    rows = _three(query.upper(), [(found[i][1], found[i][2]) for i in best])
    q, a, b = (K._CODE[np.frombuffer(x.encode(), dtype=np.uint8)] for x in rows)
    gap = (q == 0) | (a == 0) | (b == 0)
    skip = gap.copy()
    skip[:-1] |= gap[1:]
    skip[1:] |= gap[:-1]
    for x in (q, a, b):
        skip |= ~(K._PLAIN[x] | (x == 0))
    kind = np.where(gap, " ", np.where(a == b, np.where(q == a, " ", "N"), np.where(q == a, "A", np.where(q == b, "B", "?"))))
    use = ~skip & (kind != " ")
    at = np.flatnonzero(use)
    is_a, is_b = kind[at] == "A", kind[at] == "B"
    ly, ln, la = np.cumsum(is_a), np.cumsum(is_b), np.cumsum(~is_a & ~is_b)
    if not len(at):
        return none
    rn, ry, ra = ly[-1] - ly, ln[-1] - ln, la[-1] - la
    score = lambda y, n, x: y / (how.xn * (n + how.dn) + x)
    straight = np.where((ly > ln) & (ry > rn), score(ly, ln, la) * score(ry, rn, ra), -1.0)
    turned = np.where((ln > ly) & (rn > ry), score(ln, ly, la) * score(rn, ry, ra), -1.0)
    h = np.maximum(straight, turned)
    k = int(h.argmax())
    if h[k] < 0:
        return none
    flip = turned[k] > straight[k]
    left = (int(ln[k]), int(ly[k]), int(la[k])) if flip else (int(ly[k]), int(ln[k]), int(la[k]))
    right = (int(rn[k]), int(ry[k]), int(ra[k])) if flip else (int(ry[k]), int(rn[k]), int(ra[k]))
    one, two = (best[1], best[0]) if flip else (best[0], best[1])
    x, y = (b, a) if flip else (a, b)
    model = np.where(np.arange(len(q)) <= at[k], x, y)
    cols = int((~skip).sum())
    pct = lambda u, v: 100.0 * int(((u == v) & ~skip).sum()) / cols
    qa, qb, ab, qm = pct(q, x), pct(q, y), pct(x, y), pct(q, model)
    qt = max(qa, qb)
    if how.rule == "exact":
        flag = "Y" if qm == 100.0 and qt < 100.0 else "N"
    elif h[k] < how.min_h:
        flag = "N"
    else:
        flag = "Y" if qm - qt >= how.min_div and sum(left) >= how.min_diffs and sum(right) >= how.min_diffs else "?"
    return dict(zip(COLUMNS, [float(h[k]), label, found[one][0], found[two][0], found[one][0] if qa >= qb else found[two][0], qm, qa, qb, ab, qt, left[0], left[1], left[2], right[0], right[1], right[2], qm - qt, flag], strict=True))


def judge_long(query: str, label: str, found: list[tuple[str, str, str]], how: Chimera) -> dict:
    """Parents one after the other, each the longest stretch left of the query that it matches well enough; a chimera is covered whole by two at least."""
    none = dict(zip(COLUMNS, [0.0, label, None, None, None, None, None, None, None, None, 0, 0, 0, 0, 0, 0, None, "N"], strict=True))
    match = [_matches(query, s, c) for _, s, c in found]
    free = np.ones(len(query), dtype=bool)
    used: list[tuple[int, int, int]] = []
    while len(used) < how.max_parents and free.any():
        best = (0, 0, 0)
        for i, own in enumerate(match):
            if any(u[2] == i for u in used):
                continue
            worth = np.where(own == 1, how.diff_pct, how.diff_pct - 100.0)
            bad = (own < 0) | ~free
            cut = np.concatenate([[-1], np.flatnonzero(bad), [len(query)]])
            for lo, hi in zip((cut[:-1] + 1).tolist(), cut[1:].tolist(), strict=True):
                sums = np.concatenate([[0.0], np.cumsum(worth[lo:hi])])
                low = np.minimum.accumulate(sums)
                for end in range(hi - lo, 0, -1):
                    if end <= best[0]:
                        break
                    start = int(np.argmax(sums[: end + 1] <= sums[end] + 1e-9))
                    if end - start > best[0] and low[end] <= sums[end] + 1e-9:
                        best = (end - start, lo + start, i)
        if best[0] < how.min_length:
            break
        used.append((best[1], best[1] + best[0], best[2]))
        free[best[1] : best[1] + best[0]] = False
    if len(used) < 2 or free.any():
        return none
    used.sort()
    return none | {"score": 99.9999, "parent_a": found[used[0][2]][0], "parent_b": found[used[1][2]][0], "closest": found[used[0][2]][0], "flag": "Y"}


def _parts(reads: DataFrame, how: Chimera) -> DataFrame:
    """Parts of each query as reads; their seqno tells the query and the part."""
    n = F.greatest(F.lit(2), F.least(F.lit(100), F.ceil(F.length("seq") / 100))) if how.rule == "long" else F.lit(how.parts)
    rows = reads.withColumn("n", n.cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    start = F.floor(F.length("seq") * F.col("part") / F.col("n")).cast("int")
    stop = F.floor(F.length("seq") * (F.col("part") + 1) / F.col("n")).cast("int")
    return rows.select((F.col("seqno") * 128 + F.col("part")).alias("seqno"), "header", F.substring("seq", start + 1, stop - start).alias("seq"), "qual", "size", "sample").where(F.length("seq") > 0)


def detect(queries: DataFrame, targets: DataFrame, how: Chimera | None = None, before: list | None = None, within: Column | None = None) -> DataFrame:
    """A row of ``COLUMNS`` for each query, with parents among ``targets``.

    Seqnos are unique among queries and among targets; the two may have the same.
    A query without candidates, or with a null or empty sequence, gets N.
    """
    how = how or Chimera()
    search = Search(id=0.55, max_accepts=4, max_rejects=16, mask="dust", before=before or [], within=within)
    hits = globally(_parts(queries, how), targets, search)
    pairs = hits.select(F.floor(F.col("q") / 128).cast("long").alias("q"), "t").distinct()
    whole = pairs.join(side(queries, "q"), "q").join(side(targets, "t"), "t")
    rule = judge_long if how.rule == "long" else judge

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        ways = K.align(group["q_seq"].tolist(), group["t_seq"].tolist())
        found = [(h, s, w["cigar"]) for h, s, w in zip(group["t_header"], group["t_seq"], ways, strict=True)]
        row = rule(group["q_seq"].iloc[0], group["q_header"].iloc[0], found, how)
        return pd.DataFrame([{"q": group["q"].iloc[0], **row}])

    # A query has 4 accepted candidates a part at most, so its group is bounded.
    judged = whole.groupBy("q").applyInPandas(run, SCHEMA)
    rest = queries.select(F.col("seqno").alias("q"), F.col("header").alias("h"))
    return rest.join(judged, "q", "left").withColumn("query", F.col("h")).drop("h").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("flag", F.coalesce("flag", F.lit("N"))).fillna(0, ["left_y", "left_n", "left_a", "right_y", "right_n", "right_a"])


def denovo(reads: DataFrame, how: Chimera | None = None) -> DataFrame:
    """As ``detect``, with parents among sequences that come earlier, are ``abskew`` times as abundant and aren't chimeras.

    Rows go in order of abundance, label and seqno. A row's verdict depends on
    earlier ones only through those of them that are chimeras, so all rows are
    judged at once, with the chimeras of the round before left out, until these
    stay the same: after k rounds all rows are final that hang on fewer than k
    others in turn. What is between rounds is a table in the shared folder.
    """
    how = how or Chimera(rule="denovo")
    placed = keep(numbered(reads, [F.col("size").desc(), F.col("header"), F.col("seqno")]).withColumnRenamed("seqno", "own").withColumn("seqno", F.col("nth")))
    rows = placed.select("seqno", "header", "seq", "qual", "size", "sample")
    earlier = F.col("t") < F.floor(F.col("q") / 128)
    known = None
    while True:
        targets = rows if known is None else rows.join(known.where("flag = 'Y'").select(F.col("q").alias("seqno")), "seqno", "left_anti")
        judged = keep(detect(rows, targets, how, [F.col("t_size") >= how.abskew * F.col("q_size"), *unaligned_tests(self_=True, self_id=True)], earlier))
        same = known is not None and known.where("flag = 'Y'").select("q").exceptAll(judged.where("flag = 'Y'").select("q")).isEmpty() and judged.where("flag = 'Y'").select("q").exceptAll(known.where("flag = 'Y'").select("q")).isEmpty()
        if same or (known is None and judged.where("flag = 'Y'").isEmpty()):
            return judged.join(placed.select(F.col("seqno").alias("q"), "own"), "q").withColumn("q", F.col("own")).drop("own")
        if known is not None:
            drop(known)
        known = judged
