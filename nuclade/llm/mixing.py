"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to; the flow routes
each pattern's words to its sources' quotas, where each further repetition of a
document costs more than the last (convex), so repetition is used only where a
quota cannot be met otherwise. A seeded order then selects whole documents.

Scale: the driver sees a row for each pattern (checked against ``max_patterns``)
and the flow's size does not depend on the number of documents. Selection needs
a running sum of words in seeded order: sums of 4096 hash buckets a pattern, and
a window over only those buckets in which a cut falls.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hex_bucket, keep, n_words, seeded

#: Hex digits of a bucket of the seeded order.
DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code-point order, null last."""

    weights: tuple[float, ...] = (5, 2, 1)
    #: Words to take in all, as a share of the words there are.
    share: float = 1.5
    #: Times that a document may be taken.
    repeats: int = 2
    seed: int = 5
    #: Most distinct membership patterns that the driver will solve for.
    max_patterns: int = 200_000


def fill(weights: list[float], caps: list[float], total: float) -> list[float]:
    """Share ``total`` by weight; what is above a cap is shared again among the rest."""
    out = [0.0] * len(weights)
    open_ = {i for i in range(len(weights)) if caps[i] > 0 and weights[i] > 0}
    left = min(total, sum(caps))
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if weights[i] * each >= caps[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * each
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
            open_.discard(i)
    return out


class Flow:
    """Min-cost flow by shortest paths with potentials and blocking flows."""

    def __init__(self, nodes: int) -> None:
        self.edges: list[list] = []  # to, capacity, cost
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, source: int, sink: int) -> None:
        """Saturate: costs are of edges without negative cycles at the start.

        All paths of one cost are filled together, by blocking flows, so the
        number of searches follows that of different costs.
        """
        height = [0] * len(self.out)
        while True:
            far = {source: 0}
            heap = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    b, capacity, cost = self.edges[e]
                    if capacity > 0 and (n := d + cost + height[a] - height[b]) < far.get(b, n + 1):
                        far[b] = n
                        heapq.heappush(heap, (n, b))
            if sink not in far:
                return
            most = max(far.values())
            for a in range(len(height)):
                height[a] += far.get(a, most)
            while self._fill(source, sink, height):
                pass

    def _fill(self, source: int, sink: int, height: list[int]) -> bool:
        """A blocking flow over edges that cost nothing under ``height``, by levels; whether there was any."""
        edges, out = self.edges, self.out
        level, queue = {source: 0}, [source]
        for a in queue:
            for e in out[a]:
                b, capacity, cost = edges[e]
                if capacity > 0 and b not in level and cost + height[a] == height[b]:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return False
        turn, path = [0] * len(out), []
        while True:
            a = edges[path[-1]][0] if path else source
            if a == sink:
                room = min(edges[e][1] for e in path)
                for e in path:
                    edges[e][1] -= room
                    edges[e ^ 1][1] += room
                # Back to before the first edge that is full.
                del path[next(k for k, e in enumerate(path) if edges[e][1] == 0) :]
                continue
            while turn[a] < len(out[a]):
                b, capacity, cost = edges[out[a][turn[a]]]
                if capacity > 0 and level.get(b) == level[a] + 1 and cost + height[a] == height[b]:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
            elif path:
                turn[edges[path.pop() ^ 1][0]] += 1
            else:
                return True


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int) -> list[dict[int, int]]:
    """Words of each pattern that go to each of its sources.

    ``patterns``: the sources of each and its words. The n-th repetition of a
    pattern's words costs n*n a word.
    """
    p, s = len(patterns), len(quotas)
    flow = Flow(p + s + 2)
    start, end = p + s, p + s + 1
    arcs: list[dict[int, int]] = []
    for i, (members, words) in enumerate(patterns):
        for n in range(1, repeats + 1):
            flow.add(start, i, words, n * n)
        arcs.append({q: flow.add(i, p + q, words * repeats, 0) for q in members})
    for q, quota in enumerate(quotas):
        flow.add(p + q, end, quota, 0)
    flow.run(start, end)
    return [{q: flow.edges[e ^ 1][1] for q, e in own.items()} for own in arcs]


def mix(docs: DataFrame, how: Mix | None = None, members: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """Each row of ``docs(doc_id, text, source)`` with the words the mix takes of it.

    ``members`` names a column of arrays of sources, where documents belong to
    several; without it a document belongs to its ``source``. Columns returned:
    doc_id, size, source_size, target, taken, repeats. A source's target is its
    share by weight, and at most ``repeats`` times its words. Null sources are
    one source, the last. Texts that are null or without words have size 0 and
    are never taken (repeats is 0). Rows that repeat a doc_id are rows of their
    own. An empty table gives no rows. Other columns are ignored, but for those
    in ``carry``, which come back beside these. More patterns than
    ``how.max_patterns`` raise an error, as the driver solves for all of them.
    """
    how = how or Mix()
    with_ = [f"with_{c}" for c in carry or []]
    own = F.col(members) if members else F.array("source")
    names = F.transform(own, lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("~")))
    rows = docs.select(
        "doc_id",
        n_words(F.col("text")).alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")).alias("home"),
        F.array_join(F.array_sort(F.array_distinct(names)), "\x1f").alias("pattern"),
        seeded(how.seed, F.col("doc_id"), F.crc32(F.col("text").cast("binary"))).alias("digest"),
        *(F.col(c).alias(w) for c, w in zip(carry or [], with_, strict=True)),
    ).withColumn("part", hex_bucket(F.col("digest"), DIGITS))
    rows = keep(rows)
    spark = docs.sparkSession

    found = rows.groupBy("pattern", "home").agg(F.sum("size").alias("words")).limit(how.max_patterns + 1).collect()
    if len(found) > how.max_patterns:
        raise ValueError(f"more than {how.max_patterns} membership patterns")
    words: dict[str, int] = {}
    sizes: dict[str, int] = {}
    for r in found:
        words[r.pattern] = words.get(r.pattern, 0) + r.words
        sizes[r.home] = sizes.get(r.home, 0) + r.words
    sources = sorted({*sizes, *(x for p in words for x in p.split("\x1f") if x)}, key=lambda x: [ord(c) for c in x])
    weights = [how.weights[i % len(how.weights)] for i in range(len(sources))]
    caps = [how.repeats * sizes.get(s, 0) for s in sources]
    targets = fill(weights, caps, how.share * sum(sizes.values()))
    at = {s: i for i, s in enumerate(sources)}
    patterns = sorted(words)
    sent = route([(tuple(at[x] for x in p.split("\x1f") if x), words[p]) for p in patterns], [round(t) for t in targets], how.repeats)
    # Whole passes over a pattern, and the words of one more that is cut short.
    plan = []
    for p, out in zip(patterns, sent, strict=True):
        passes, rest = divmod(sum(out.values()), words[p]) if words[p] else (0, 0)
        plan.append((p, passes, rest))
    plan = spark.createDataFrame(plan, "pattern string, passes long, rest long")
    goal = spark.createDataFrame([(s, sizes.get(s, 0), float(t)) for s, t in zip(sources, targets, strict=True)], "home string, source_size long, target double")

    sums = rows.groupBy("pattern", "part").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    steps = sums.join(plan, "pattern").select("pattern", "part", "passes", "rest", "before", (F.col("before") + F.col("sum")).alias("after"))
    rows = rows.join(steps, ["pattern", "part"])
    cut = (F.col("before") < F.col("rest")) & (F.col("after") > F.col("rest"))
    within = Window.partitionBy("pattern", "part").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    # A document on the cut is taken where that comes nearer to the quota.
    inside = rows.where(cut).withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    inside = inside.withColumn("extra", (F.col("before") + F.col("size") / 2 <= F.col("rest")).cast("long"))
    outside = rows.where(~cut).withColumn("extra", (F.col("after") <= F.col("rest")).cast("long"))
    chosen = outside.unionByName(inside).withColumn("repeats", F.when(F.col("size") > 0, F.col("passes") + F.col("extra")).otherwise(0))
    return chosen.join(goal, "home").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), F.col("repeats").cast("int"), *(F.col(w).alias(c) for c, w in zip(carry or [], with_, strict=True)))
