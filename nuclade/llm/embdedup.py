"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Distinct vectors are dealt to blocks of at most about ``block`` rows; each task
takes one pair of blocks. A tile product of int8 vectors plus both vectors'
quantisation error bounds rules pairs out; only pairs that may reach the
threshold are computed again in double precision. A task returns counts of links
and a forest that joins what it linked, never the pairs themselves.

Scale: copies are one row with a multiplicity, so a hot vector costs nothing.
Blocks follow the nearest of a few pivots, and each has a centre and an angle;
pairs of blocks that no link can cross (by the triangle inequality on angles)
are never formed. What remains is the all-pairs product in tiles: memory of a
task is two blocks, and shuffled bytes are rows times the blocks that may hold
partners.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import components


@dataclass(frozen=True)
class Tiles:
    threshold: float = 0.95
    block: int = 4096
    tile: int = 1024
    pivots: int = 64
    seed: int = 3


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values (as float32, so that products are exact), scales, and norms of the error of each row.

    With x = s*q + e, |x.y - s*t*q.r| <= |e| + |f| + |e||f| for unit x, y; the
    float32 sums of int8 products are exact up to 1000 components.
    """
    scale = np.abs(unit).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(unit / scale[:, None])
    return q.astype(np.float32), scale, np.linalg.norm(unit - q * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows; long rows are added up in double precision."""
    if a.shape[1] <= 1000:
        return (a @ b.T).astype(np.float64)
    return sum((a[:, k : k + 1000] @ b[:, k : k + 1000].T).astype(np.float64) for k in range(0, a.shape[1], 1000))


def _unit(rows: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    # Scaled by powers of two, which changes no digit of a cosine, so that no square overflows or vanishes.
    out = np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, initial=0))[1][:, None])
    return out, np.linalg.norm(out, axis=1)


def _settled(root: np.ndarray) -> np.ndarray:
    """Each entry's root."""
    while (root[root] != root).any():
        root = root[root]
    return root


def _links(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, same: bool, how: Tiles) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of linked pairs, a tile at a time; within one block only i < j."""
    qx, sx, ex = quantise(x / nx[:, None])
    qy, sy, ey = (qx, sx, ex) if same else quantise(y / ny[:, None])
    for a in range(0, len(x), how.tile):
        for b in range(a if same else 0, len(y), how.tile):
            i, j = slice(a, a + how.tile), slice(b, b + how.tile)
            bound = _product(qx[i], qy[j])
            bound *= sx[i, None] * sy[None, j]
            bound += ex[i, None] + ey[None, j] + ex[i, None] * ey[None, j]
            p, q = np.nonzero(bound >= how.threshold - 1e-9)
            p, q = p + a, q + b
            if same:
                p, q = p[p < q], q[p < q]
            for k in range(0, len(p), 65536):
                u, v = p[k : k + 65536], q[k : k + 65536]
                sure = np.einsum("ij,ij->i", x[u], y[v]) / (nx[u] * ny[v]) >= how.threshold
                yield u[sure], v[sure]


def _place(rows: DataFrame, how: Tiles) -> tuple[DataFrame, DataFrame, int] | None:
    """Rows with a block, a row ``(block, i, j)`` of each block for each pair that links may cross, and the longest vector."""
    spark = rows.sparkSession
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return None
    sample = rows.select("vector").orderBy(F.xxhash64(F.lit(how.seed), "vec_id")).limit(min(how.pivots, max(1, n // how.block))).collect()
    points, norms = _unit([r.vector for r in sample], width)
    points /= norms[:, None]

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, nx = _unit(batch["vector"].tolist(), width)
                cosine = x @ points.T / nx[:, None]
                own = cosine.argmax(axis=1)
                yield batch.assign(pivot=own.astype(np.int32), angle=np.arccos(np.clip(np.take_along_axis(cosine, own[:, None], axis=1)[:, 0], -1, 1)))

    near = keep(rows.mapInPandas(nearest, "vec_id long, many long, vector array<double>, pivot int, angle double"))
    parts = {r.pivot: -(-r["count"] // how.block) for r in near.groupBy("pivot").count().collect()}
    first, total = {}, 0
    for p in sorted(parts):
        first[p] = total
        total += parts[p]
    of_pivot = spark.createDataFrame([(p, first[p], parts[p]) for p in parts], "pivot int, first long, parts long")
    placed = near.join(of_pivot, "pivot").withColumn("block", (F.col("first") + F.pmod(F.xxhash64(F.lit(how.seed + 1), "vec_id"), F.col("parts"))).cast("int"))
    # The angle of the row farthest from its pivot bounds a block.
    blocks = keep(placed.groupBy("pivot", "block").agg((F.max("angle") + 1e-6).alias("angle")))
    between = np.arccos(np.clip(points @ points.T, -1, 1))
    pivots = spark.createDataFrame([(p, q, float(between[p, q])) for p in parts for q in parts], "p int, q int, between double")
    side = lambda x, own: blocks.select(F.col("pivot").alias(own), F.col("block").alias(x), F.col("angle").alias(f"angle_{x}"))
    most = float(np.arccos(min(1.0, how.threshold)))
    pairs = side("i", "p").join(pivots, "p").join(side("j", "q"), "q").where("i <= j").where(F.col("between") - F.col("angle_i") - F.col("angle_j") <= most)
    return placed.drop("pivot", "angle", "first", "parts"), keep(pairs.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")), width


def near_duplicates(vectors: DataFrame, how: Tiles | None = None, vector: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each row of ``vectors(vec_id, <vector>)``.

    Vectors with a cosine of at least the threshold, in double precision, are
    linked. Vectors that are null, empty, all zero or hold a null, NaN or
    infinite component link with nothing. Of vectors of different lengths the
    shorter counts as padded with zeros. Rows that repeat a vec_id with one
    vector are copies of it; a null vec_id gets a null component and is kept.
    Other columns are ignored.
    """
    how = how or Tiles()
    raw = vectors.select("vec_id", F.col(vector).alias("vector"))
    fit = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    all_rows = keep(raw.withColumn("same", F.when(F.coalesce(fit, F.lit(False)) & F.col("vec_id").isNotNull(), F.md5(F.array_join(F.transform("vector", lambda x: x.cast("string")), ",").cast("binary")))))
    classes = all_rows.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"))
    classes = keep(classes)
    reps = all_rows.join(classes, "same").where("vec_id = rep").dropDuplicates(["vec_id", "same"]).select("vec_id", "many", F.col("vector").cast("array<double>").alias("vector"))
    # A vec_id with several vectors is one row for each of them.
    dealt = _place(keep(reps), how)
    if dealt is None:
        return all_rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    placed, seats, width = dealt

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        i, j = int(batch["i"].iloc[0]), int(batch["j"].iloc[0])
        batch = batch.sort_values("vec_id", kind="stable")
        left, right = batch[batch["block"] == i], batch[batch["block"] == j]
        if left.empty or right.empty:
            return pd.DataFrame({"u": [], "v": [], "n": []})
        x, nx = _unit(left["vector"].tolist(), width)
        y, ny = (x, nx) if i == j else _unit(right["vector"].tolist(), width)
        mx, my = left["many"].to_numpy(), right["many"].to_numpy()
        cx, cy = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
        shift = 0 if i == j else len(x)
        root = np.arange(len(x) + (0 if i == j else len(y)))
        for u, v in _links(x, nx, y, ny, i == j, how):
            np.add.at(cx, u, my[v])
            np.add.at(cy, v, mx[u])
            root = _settled(root)
            a, b = root[u], root[v + shift]
            # Only links between parts that nothing has joined yet are looked at one by one.
            for a, b in np.unique(np.stack([a, b], axis=1)[a != b], axis=0).tolist():
                while root[a] != a:
                    a = root[a] = root[root[a]]
                while root[b] != b:
                    b = root[b] = root[root[b]]
                root[max(a, b)] = min(a, b)
        root = _settled(root)
        ids = left["vec_id"].to_numpy() if i == j else np.concatenate([left["vec_id"].to_numpy(), right["vec_id"].to_numpy()])
        n = cx + cy if i == j else np.concatenate([cx, cy])
        some = n > 0
        return pd.DataFrame({"u": ids[some], "v": ids[root][some], "n": n[some]})

    # Each pair of blocks is a task's group; its rows stay under two blocks.
    dealt = placed.join(seats, "block").select("vec_id", "many", "vector", "block", "i", "j")
    found = keep(dealt.groupBy("i", "j").applyInPandas(run, "u long, v long, n long"))
    counts = found.groupBy("u").agg(F.sum("n").alias("n"))
    joined = components(found.select("u", "v"))
    return (
        all_rows.select("vec_id", "same")
        .join(classes, "same", "left")
        .join(counts.withColumnRenamed("u", "rep"), "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "vec_id",
            F.coalesce(F.col("n") + F.col("many") - 1, F.col("many") - 1, F.lit(0)).alias("n_links"),
            F.coalesce("component", "rep", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
