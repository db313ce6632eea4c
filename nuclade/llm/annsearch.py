"""Approximate nearest neighbours: NN-descent, greedy graph search and lists of rows.

The graph is fitted on landmarks, a bounded sample of the different vectors: it
starts from random-projection leaves and improves by joining each vector's
neighbours with one another (neighbours of neighbours). Every row hangs on its
nearest landmark. A query walks the graph greedily from entry points, expanding
the nearest unvisited landmarks of its list until none is left, and is then
compared with all rows that hang on the landmarks of its list. Up to
``Graph.landmarks`` different vectors, all are landmarks.

Scale: copies of a vector are one node with its smallest id, so a hot vector is
one row. Landmarks and graph are of bounded size and go along with the
functions. Lists are dealt to blocks of like numbers of rows, a long list to
several; a block meets all queries, in parts of bounded size, so a task's size is
bounded too. Rows are compared by products of matrices in single precision, with
a bound on their error; what may be among the nearest is measured in double
precision on the original vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import drop, keep


@dataclass(frozen=True)
class Graph:
    #: Neighbours of a node, and of those each way that a local join takes.
    degree: int = 30
    sample: int = 24
    #: Rounds at least; they go on until no more than this share of the edges is new.
    rounds: int = 4
    settled: float = 0.01
    #: Random-projection trees that give the first neighbours; rows of a leaf, about.
    trees: int = 8
    leaf: int = 400
    #: Different vectors that the graph is fitted on, at most.
    landmarks: int = 8192
    #: Length of a query's list, of which so many are expanded in a step; a search ends when all were. Common entry points.
    beam: int = 2500
    expand: int = 600
    entries: int = 120
    #: Rows of a block, and queries that it meets at once, at most.
    block: int = 300_000
    part: int = 200_000
    seed: int = 13


def usable(vector: F.Column) -> F.Column:
    """Not null, not all zero, and of finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _matrix(rows, width: int, kind=np.float32) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=kind)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _vectors(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """A row for each list of ``column``, padded with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    return _matrix(np.split(flat, np.cumsum(sizes)[:-1]), width, kind)


def _unpacked(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.float32).reshape(len(packed), -1)


def _square(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, in double precision from the first row, so that near copies keep their order."""
    x = x.astype(np.float64) - x[0]
    square = (x * x).sum(axis=1)
    return np.maximum(square[:, None] + square[None] - 2 * (x @ x.T), 0)


def _nearest(x: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n nearest rows of each row among all of ``x``, as (row's id, other's id, distance)."""
    far = _square(x)
    np.fill_diagonal(far, np.inf)
    n = min(n, len(x) - 1)
    at = np.argpartition(far, n - 1, axis=1)[:, :n] if n else np.zeros((len(x), 0), dtype=int)
    return np.repeat(ids, n), ids[at].ravel(), np.sqrt(np.take_along_axis(far, at, axis=1)).ravel()


EDGE = "u long, v long, d float"


def _nearest_of(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The number of the nearest of ``marks`` for each row."""
    out, half = np.zeros(len(x), dtype=np.int32), (marks * marks).sum(axis=1) / 2
    for a in range(0, len(x), 512):
        out[a : a + 512] = (x[a : a + 512] @ marks.T - half).argmax(axis=1)
    return out


def _walk(x: np.ndarray, marks: np.ndarray, links: np.ndarray, how: Graph) -> np.ndarray:
    """Squared distances of each row to the landmarks that its greedy walk keeps; infinite for the others."""
    m, rows = len(marks), np.arange(len(x))[:, None]
    far, done = np.full((len(x), m), np.inf, dtype=np.float32), np.zeros((len(x), m), dtype=bool)
    beam, expand = min(how.beam, m), min(how.expand, how.beam, m)
    new = np.zeros((len(x), m), dtype=bool)
    new[:, : how.entries] = True
    new[rows[:, 0], _nearest_of(x, marks)] = True
    while True:
        i, j = np.nonzero(new)
        for a in range(0, len(i), 1 << 15):
            apart = x[i[a : a + (1 << 15)]] - marks[j[a : a + (1 << 15)]]
            far[i[a : a + (1 << 15)], j[a : a + (1 << 15)]] = np.einsum("ij,ij->i", apart, apart)
        kept = np.partition(far, beam - 1, axis=1)[:, beam - 1 : beam]
        waiting = np.where(done | (far > kept), np.inf, far)
        pick = np.argpartition(waiting, expand - 1, axis=1)[:, :expand]
        i, k = np.nonzero(np.isfinite(np.take_along_axis(waiting, pick, axis=1)))
        if not len(i):
            return np.where(far > kept, np.inf, far)
        at = pick[i, k]
        done[i, at] = True
        new[:] = False
        new[i[:, None], links[at]] = True
        new &= np.isinf(far)


def _best(found: list[tuple[np.ndarray, ...]], n: int) -> tuple[np.ndarray, ...]:
    """The n first of each query in ``(query, row, distance, id)``, nearest first, ties to smaller ids; in order."""
    q, row, d, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, d, q))
    q, row, d, ids = q[order], row[order], d[order], ids[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=int)
    nth = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return q[nth < n], row[nth < n], d[nth < n], ids[nth < n]


def _scan(x: np.ndarray, ids: np.ndarray, lists: np.ndarray, q: np.ndarray, wanted: np.ndarray, most: np.ndarray, marks: dict[int, np.ndarray], n: int) -> tuple[np.ndarray, ...]:
    """The n nearest rows of each query among the lists that it wants, as :func:`_best` gives them.

    ``wanted[i, l]`` says whether query i wants the l-th of ``marks``; ``most``
    bounds the n-th smallest squared distance from above. Distances are squared,
    in double precision; what single precision rules out by its error isn't measured.
    """
    order = np.argsort(lists, kind="stable")
    x, ids = x[order], ids[order]
    most, held, size = most.copy(), [tuple(np.zeros(0, dtype=k) for k in (np.int64, np.int64, np.float64, np.int64))], 0
    for nth, (a, b, mark) in enumerate(zip(np.searchsorted(lists[order], list(marks)), np.searchsorted(lists[order], list(marks), "right"), marks.values(), strict=True)):
        asked = np.flatnonzero(wanted[:, nth])
        if a == b or not len(asked):
            continue
        # About the landmark, so that errors are in proportion to the list's own extent.
        side = (x[a:b] - mark).astype(np.float32)
        square = (side * side).sum(axis=1)
        side = np.concatenate([2 * side, -square[:, None]], axis=1).T
        each = max(16, (1 << 21) // int(b - a))
        for c in range(0, len(asked), each):
            who = asked[c : c + each]
            mine = (q[who] - mark).astype(np.float32)
            own = (mine * mine).sum(axis=1)
            least = own - most[who] - 1e-5 * (own + square.max())
            at = np.flatnonzero(np.concatenate([mine, np.ones((len(who), 1), dtype=np.float32)], axis=1) @ side >= least.astype(np.float32)[:, None])
            i, j = who[at // (b - a)], a + at % (b - a)
            for e in range(0, len(i), 1 << 16):
                apart = q[i[e : e + (1 << 16)]].astype(np.float64) - x[j[e : e + (1 << 16)]]
                held.append((i[e : e + (1 << 16)], j[e : e + (1 << 16)], np.einsum("ij,ij->i", apart, apart), ids[j[e : e + (1 << 16)]]))
            size += len(i)
            if size > 500_000 + 4 * n * len(q):
                held = [best := _best(held, n)]
                count = np.bincount(best[0], minlength=len(q))
                full = np.flatnonzero(count >= n)
                most[full] = np.minimum(most[full], best[2][np.cumsum(count)[full] - 1])
                size = len(best[0])
    i, j, d, own = _best(held, n)
    return i, order[j], d, own


class Index:
    """Rows, landmarks and their neighbour graph of ``vectors(vec_id, <vector>)``."""

    def __init__(self, vectors: DataFrame, how: Graph | None = None, vector: str = "embedding") -> None:
        self.how = how = how or Graph()
        spark = vectors.sparkSession
        single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
        self.kind, self.type = (np.float32, "array<float>") if single else (np.float64, "array<double>")

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column("vector")
                # Zeros of either sign are one.
                flat, ends = column.flatten().to_numpy(zero_copy_only=False) + 0, np.cumsum([0, *column.value_lengths().to_pylist()]).tolist()
                same = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), column, pa.array(same, pa.binary())], ["vec_id", "vector", "same"])

        raw = vectors.select(F.col("vec_id").cast("long"), F.col(vector).cast(self.type).alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
        self.raw = raw.mapInArrow(named, f"vec_id long, vector {self.type}, same binary")
        nodes = keep(self.raw.groupBy("same").agg(F.min("vec_id").alias("id"), F.max("vec_id").alias("last"), F.min("vector").alias("vector")))
        n, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        self.n, self.width = n, width or 0
        # A sample by content: the first of a hash order, of which a cut leaves few more.
        cut = int(min(1.0, (1.1 * how.landmarks + 100) / max(1, n)) * (1 << 31))
        some = nodes.where(F.pmod(F.xxhash64("same"), F.lit(1 << 31)) < cut).orderBy(F.xxhash64("same"), "same").limit(how.landmarks).select("vector").toArrow()
        self.marks = marks = _vectors(some.column("vector").combine_chunks(), self.width, self.kind)
        # Distances don't depend on the origin, but what float32 keeps of them does.
        self.centre = centre = marks.mean(axis=0, dtype=np.float64) if len(marks) else np.zeros(self.width)
        self.near = near = (marks - centre).astype(np.float32)
        self.nodes = keep(spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(near)], "node long, packed binary"))
        #: Landmarks' links, their own numbers where there are fewer.
        self.links = np.repeat(np.arange(len(marks))[:, None], how.degree, axis=1)
        if len(marks) > 1:
            for r in self._build().groupBy("u").agg(F.collect_list("v").alias("v")).collect():
                self.links[r.u, : len(r.v)] = r.v
        width, kind, names = self.width, self.kind, ["id", "more", "key", "vector", "list"]

        def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = _nearest_of((_vectors(batch.column("vector"), width, kind) - centre).astype(np.float32), near)
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names[:-1]), pa.array(own, pa.int32())], names)

        rows = nodes.select("id", (F.col("last") > F.col("id")).alias("more"), F.xxhash64("same").alias("key"), "vector")
        self.rows = keep(rows.mapInArrow(hang, f"id long, more boolean, key long, vector {self.type}, list int"))
        drop(nodes)

    def _blocks(self, rows_each: int) -> int:
        return max(1, -(-len(self.marks) // rows_each))

    def planes(self) -> list[np.ndarray]:
        """Normals of the cuts of each tree, by level."""
        rng = np.random.default_rng(self.how.seed)
        depth = max(0, int(np.ceil(np.log2(max(1, len(self.marks) / self.how.leaf)))))
        return [rng.standard_normal((depth, self.width)).astype(np.float32) for _ in range(self.how.trees)]

    def _leaves(self) -> DataFrame:
        """A row of each node for each tree: ``(leaf, node, vector)``, leaf a hash of the cuts' sides.

        Cuts go through the centre, so leaves are of like size; one that is still too large is split by hash, in each tree otherwise.
        """
        planes = self.planes()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if batch.empty:
                    continue
                x = _unpacked(batch["packed"].tolist())
                for t, cuts in enumerate(planes):
                    sides = (x @ cuts.T > 0) @ (1 << np.arange(len(cuts), dtype=np.int64)) if len(cuts) else np.zeros(len(x), dtype=np.int64)
                    yield pd.DataFrame({"leaf": sides * len(planes) + t, "node": batch["node"].to_numpy()})

        leaves = self.nodes.select("node", "packed").mapInPandas(run, "leaf long, node long")
        sizes = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
        parts = F.ceil(F.col("size") / (4 * self.how.leaf))
        leaves = leaves.join(sizes, "leaf").select("node", F.xxhash64("leaf", F.pmod(F.xxhash64("leaf", "node"), parts)).alias("leaf"))
        return leaves.join(self.nodes.select("node", "packed"), "node")

    def _top(self, edges: DataFrame) -> DataFrame:
        best = Window.partitionBy("u").orderBy("d", "v")
        return edges.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= self.how.degree)

    def _build(self) -> DataFrame:
        how = self.how
        bins = self._blocks(2000)

        def first(batch: pd.DataFrame) -> pd.DataFrame:
            out = [_nearest(_unpacked(own["packed"].tolist()), own["node"].to_numpy(), how.degree) for _, own in batch.groupby("leaf")]
            return pd.DataFrame({k: np.concatenate([x[i] for x in out]) for i, k in enumerate(("u", "v", "d"))})

        dealt = self._leaves().withColumn("bin", F.pmod("leaf", F.lit(bins * how.trees)))
        edges = dealt.groupBy("bin").applyInPandas(first, EDGE).withColumn("new", F.lit(True))
        graph = keep(self._top(edges))
        turn, left = 0, True
        while turn < how.rounds or left:
            graph = self._descend(graph, turn, bins)
            turn += 1
            if turn >= how.rounds:
                edges, new = graph.agg(F.count(F.lit(1)), F.count_if("new")).first()
                left = new > how.settled * edges
        return graph

    def _descend(self, graph: DataFrame, turn: int, bins: int) -> DataFrame:
        """One round: neighbours of a node are compared with one another; pairs of which neither is new were compared before."""
        how = self.how
        both = graph.select("u", "v", "new", "nth").union(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "new", "nth"))
        pick = Window.partitionBy("u").orderBy(F.col("new").desc(), F.xxhash64(F.lit(turn), "u", "v"))
        lists = both.groupBy("u", "v").agg(F.max("new").alias("new")).withColumn("k", F.row_number().over(pick)).where(F.col("k") <= 2 * how.sample)
        worst = graph.groupBy("u").agg(F.max("d").alias("worst"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("v"), F.when(F.col("n") >= how.degree, F.col("worst")).otherwise(float("inf")).alias("worst"))
        dealt = lists.select("u", "v", "new").join(worst, "v", "left").join(self.nodes.select(F.col("node").alias("v"), "packed"), "v")
        dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("u"), F.lit(bins * 4)))

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            batch = batch.sort_values("u", kind="stable")
            x, v = _unpacked(batch["packed"].tolist()), batch["v"].to_numpy()
            new, worst = batch["new"].to_numpy(dtype=bool), batch["worst"].fillna(np.inf).to_numpy(dtype=np.float32)
            u = batch["u"].to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(u[1:] != u[:-1]) + 1, [len(u)]])
            out = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                far = np.sqrt(_square(x[a:b]))
                good = (far < worst[a:b, None]) & (new[a:b, None] | new[None, a:b])
                np.fill_diagonal(good, False)
                i, j = np.nonzero(good)
                out.append((v[a + i], v[a + j], far[i, j]))
            if not out:
                return pd.DataFrame({"u": [], "v": [], "d": []})
            found = pd.DataFrame({k: np.concatenate([x[i] for x in out]) for i, k in enumerate(("u", "v", "d"))})
            found = found.drop_duplicates(["u", "v"]).sort_values(["u", "d"], kind="stable")
            return found[found.groupby("u").cumcount() < how.degree]

        fresh = dealt.groupBy("bin").applyInPandas(run, EDGE).withColumn("new", F.lit(True))
        after = keep(self._top(graph.select("u", "v", "d", F.lit(False).alias("new")).union(fresh)))
        drop(graph)
        return after

    # ---------------------------------------------------------------- search

    def search(self, queries: DataFrame, k: int = 10, exclude_own: bool = True) -> DataFrame:
        """``(query_id, rank, vec_id, score)``: the k nearest found of each row of ``queries(query_id, vector)``.

        Nearest first, ties to the smaller vec_id; all candidates if there are
        fewer. With ``exclude_own`` a query isn't its own neighbour. Queries that
        aren't usable get no rows; repeated ones are answered once.
        """
        how, spark, width, kind, marks, near, links, centre = self.how, self.rows.sparkSession, self.width, self.kind, self.marks, self.near, self.links, self.centre
        queries = queries.select(F.col("query_id").cast("long"), F.col("vector").cast(self.type).alias("vector"))
        queries = keep(queries.where(usable(F.col("vector")) & F.col("query_id").isNotNull()).dropDuplicates(["query_id"]))
        asked, n = queries.count(), k + 6
        out = "query_id long, rank int, vec_id long, score double"
        if not asked or not self.n:
            return spark.createDataFrame([], out)
        # Blocks of lists, filled in order; a longer list has blocks of its own and its rows are dealt by hash.
        each = min(how.block, max(2000, self.n // 24))
        sizes = dict(self.rows.groupBy("list").count().collect())
        begin, parts, lists, fill = np.zeros(len(marks), dtype=np.int64), np.ones(len(marks), dtype=np.int64), [], each
        for at, size in sorted(sizes.items()):
            parts[at] = -(-size // each)
            if parts[at] > 1 or fill + size > each:
                lists += [[] for _ in range(parts[at])]
                fill = 0
            begin[at] = len(lists) - parts[at]
            for own in lists[begin[at] :]:
                own.append(at)
            fill = fill + size if parts[at] == 1 else each
        lists = [np.array(x) for x in lists]
        turns = -(-asked // how.part)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, key = batch.column("list").to_numpy(), batch.column("key").to_numpy()
                x, ids, more = _vectors(batch.column("vector"), width, kind), batch.column("id").to_numpy(), batch.column("more").to_numpy(zero_copy_only=False)
                block = begin[own] + (key >> 7) % parts[own]
                for b in np.unique(block).tolist():
                    at = np.flatnonzero(block == b)
                    held = [v[at].tobytes() for v in (x, ids, key, more, own)]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([v], pa.binary()) for v in held)], ["block", "x", "ids", "key", "more", "list"])

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, ids = _vectors(batch.column("vector"), width, kind), batch.column("query_id").to_numpy()
                wanted, most = np.zeros((len(x), len(marks)), dtype=bool), np.full(len(x), np.inf)
                for a in range(0, len(x), 256):
                    far = _walk((x[a : a + 256] - centre).astype(np.float32), near, links, how)
                    wanted[a : a + 256] = np.isfinite(far)
                    if len(marks) >= n:
                        # The landmarks are rows too: the n-th nearest row is no farther than the n-th of them.
                        at = np.argpartition(far, n - 1, axis=1)[:, :n]
                        apart = marks[at].astype(np.float64) - x[a : a + 256, None]
                        most[a : a + 256] = np.where(np.isfinite(np.take_along_axis(far, at, axis=1)).all(axis=1), (apart * apart).sum(axis=2).max(axis=1), np.inf)
                for b, own in enumerate(lists):
                    bits = np.packbits(wanted[:, own], axis=1)
                    some = np.flatnonzero(bits.any(axis=1))
                    held = [v[some].tobytes() for v in (x, ids, bits, most)]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([batch.column("turn")[0].as_py()], pa.int32()), *(pa.array([v], pa.binary()) for v in held)], ["block", "turn", "x", "ids", "bits", "most"])

        def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            joined = lambda column, k: np.frombuffer(b"".join(column.tolist()), dtype=k)
            x, ids, key, more, own = (joined(left[c], t) for c, t in (("x", kind), ("ids", np.int64), ("key", np.int64), ("more", bool), ("list", np.int32)))
            q, who, bits, most = (joined(right[c], t) for c, t in (("x", kind), ("ids", np.int64), ("bits", np.uint8), ("most", np.float64)))
            here = lists[int(left["block"].iloc[0])] if len(left) else np.zeros(0, dtype=int)
            if not len(who) or not len(ids):
                return pd.DataFrame({c: np.zeros(0, dtype=t) for c, t in (("query_id", np.int64), ("id", np.int64), ("key", np.int64), ("more", bool), ("d", np.float64))})
            wanted = np.unpackbits(bits.reshape(len(who), -1), axis=1, count=len(here)).view(bool)
            i, j, d, _ = _scan(x.reshape(-1, width), ids, own, q.reshape(-1, width), wanted, most, {at: marks[at] for at in here.tolist()}, n)
            return pd.DataFrame({"query_id": who[i], "id": ids[j], "key": key[j], "more": more[j], "d": np.sqrt(d)})

        dealt = self.rows.mapInArrow(deal, "block int, x binary, ids binary, key binary, more binary, list binary")
        dealt = dealt.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        # A batch of queries is of one turn: each partition is.
        bins = max(turns, -(-asked // 1000))
        queries = queries.withColumn("bin", F.pmod(F.xxhash64("query_id"), F.lit(bins)).cast("int"))
        queries = queries.withColumn("turn", F.pmod("bin", F.lit(turns)).cast("int"))
        sent = queries.groupBy("bin").applyInArrow(lambda t: pa.Table.from_batches(list(walk(t.combine_chunks().to_batches()))), "block int, turn int, x binary, ids binary, bits binary, most binary")
        found = dealt.groupBy("block", "turn").cogroup(sent.groupBy("block", "turn")).applyInPandas(compare, "query_id long, id long, key long, more boolean, d double")
        nearest = Window.partitionBy("query_id").orderBy("d", "id")
        found = keep(found.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= n).drop("nth"))
        # Copies: the k + 1 smallest ids of each node are enough, as one may be the query.
        first = Window.partitionBy("key").orderBy("vec_id")
        named = found.select("query_id", F.col("id").alias("vec_id"), F.col("d").alias("score"))
        if not found.where("more").isEmpty():
            copied = found.where("more")
            ids = self.raw.select(F.xxhash64("same").alias("key"), "vec_id").join(copied.select("key").distinct(), "key").distinct()
            ids = ids.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).drop("nth")
            named = named.union(copied.select("query_id", "key", "d").join(ids, "key").select("query_id", "vec_id", "d"))
        if exclude_own:
            named = named.where("query_id <> vec_id")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        named = named.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every(vectors: DataFrame, every: int = 100, k: int = 10, how: Graph | None = None, vector: str = "embedding") -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by ``every``, among all other rows.

    Vectors that are null, empty, all zero or hold a null or non-finite component
    take no part. Of vectors of different lengths the shorter counts as padded
    with zeros. Rows of a null vec_id and other columns are ignored.
    """
    index = Index(vectors, how, vector)
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col(vector).alias("vector"))
    return index.search(queries, k)
