"""MinHash near-duplicates: universal minima, banding, verification, star components.

Scale: one pass in Python over the texts, whose output is a sketch of bounded
size a text; the bands are grouped by key with partial aggregates. Links are
found from each bucket's leaders first, so a bucket of n copies gives n pairs.
What is left between different components of a bucket is compared in signature
tiles of bounded size, and texts go only where signatures leave a pair open; a
forest of links leaves a tile, never its pairs.
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

from .common import drop, keep, trimmed
from .components import components
from .shingles import shingle_sets

#: Texts of a block in verification, and rows of texts in one task's group.
BLOCK, GROUP = 128, 1500
#: Shingles of a tile's side.
TILE = 1_200_000


@dataclass(frozen=True)
class MinHash:
    """Parameters. A pair at similarity s meets in a band with 1-(1-s**rows)**bands."""

    words: int = 5
    percent: int = 80
    rows: int = 5
    bands: int = 32
    seed: int = 7
    #: Standard deviations below the threshold at which a signature rules a pair out.
    sigmas: float = 4.5

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a, b = rng.integers(0, 2**63, (2, self.rows * self.bands), dtype=np.uint64)
        return a * np.uint64(2) + np.uint64(1), b

    def least_agreement(self) -> int:
        n, s = self.rows * self.bands, self.percent / 100
        return int(n * s - self.sigmas * (n * s * (1 - s)) ** 0.5)


def minima(sets: list[np.ndarray], how: MinHash) -> np.ndarray:
    """A row of minima for each non-empty set."""
    a, b = how.coefficients()
    out = np.empty((len(sets), len(a)), dtype=np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 15):
            size += len(sets[end])
            end += 1
        joined = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *(len(x) for x in sets[at : end - 1])])
        for k in range(len(a)):
            out[at:end, k] = np.minimum.reduceat((joined * a[k] + b[k]) >> np.uint64(8), starts)
        at = end
    return out


def _bands(low: np.ndarray, how: MinHash) -> np.ndarray:
    """A key of each band of each row; the band's number is part of it."""
    key = np.arange(how.bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(how.rows):
        key = (key ^ low[:, k :: how.rows]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketch(docs: DataFrame, how: MinHash) -> DataFrame:
    """``(doc_id, th, n_shingles, same, bands, signature)`` of each text; ``same`` is equal for equal sets, ``th`` is the text's."""
    names = ["doc_id", "th", "n_shingles", "same", "bands", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = list(shingle_sets(part.column("text").to_pylist(), how.words))
                full = [i for i, x in enumerate(sets) if len(x)]
                bands: list = [None] * len(sets)
                marks: list = [None] * len(sets)
                if full:
                    low = minima([sets[i] for i in full], how)
                    keys, short = _bands(low, how), (low >> np.uint64(5)).astype(np.uint8)
                    for row, i in enumerate(full):
                        bands[i], marks[i] = keys[row], short[row].tobytes()
                same = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                columns = [part.column("doc_id"), part.column("th"), pa.array([len(x) for x in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(trimmed(run), "doc_id long, th long, n_shingles long, same binary, bands array<long>, signature binary")


def _nodes(classes: DataFrame) -> tuple[DataFrame, bool]:
    """``classes(same, rep)`` with a number of its own for each, and whether that is always ``rep``.

    Only where one doc_id is the smallest of several classes (it has several
    texts) are these classes numbered by hash, again until no number is twice.
    """
    twins = keep(classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep", F.lit(True).alias("again")))
    named = classes.join(twins, "rep", "left").withColumn("node", F.when(F.col("again"), F.xxhash64("same")).otherwise(F.col("rep"))).drop("again")
    if twins.isEmpty():
        return classes.withColumn("node", F.col("rep")), True
    turn = 0
    while True:
        named = keep(named)
        clash = named.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node", F.lit(True).alias("again"))
        if clash.isEmpty():
            return named, False
        turn += 1
        named = named.join(clash, "node", "left").withColumn("node", F.when(F.col("again"), F.xxhash64("same", F.lit(turn))).otherwise(F.col("node"))).drop("again")


def _verify(pairs: DataFrame, texts: DataFrame, how: MinHash) -> DataFrame:
    """Links ``(u, v)`` among ``pairs(a, b, block_a, block_b)`` by the full sets of ``texts(node, text)``.

    Within a task a pair whose ends other links already join is left out, as it
    adds nothing to the components.
    """
    both = keep(pairs.select("a", "b", F.xxhash64("block_a", "block_b").alias("at")).distinct())
    needed = both.select("at", F.explode(F.array("a", "b")).alias("node")).distinct()
    bins = max(1, -(-needed.count() // GROUP))
    as_bin = F.pmod(F.col("at"), F.lit(bins)).alias("bin")
    needed = needed.select("node", as_bin).distinct().join(texts, "node")

    def run(links: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        sets = dict(zip(docs["node"].tolist(), shingle_sets(docs["text"].tolist(), how.words), strict=True))
        found, joined = [], Forest()
        for a, b in zip(links["a"].tolist(), links["b"].tolist(), strict=True):
            if joined.find(a) != joined.find(b) and alike(sets[a], sets[b], how.percent):
                found.append((a, b))
                joined.join(a, b)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    left = both.select("a", "b", as_bin).groupBy("bin")
    found = keep(left.cogroup(needed.groupBy("bin")).applyInPandas(run, "u long, v long"))
    drop(both)
    return found


class Forest:
    """Which of some numbers links have joined."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def _agree(pairs: DataFrame, sketches: DataFrame, how: MinHash) -> DataFrame:
    """The pairs that signatures don't rule out, with the blocks of their ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = how.least_agreement()
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), dtype=np.uint8).reshape(len(batch), -1) for c in ("sa", "sb"))
                yield batch.loc[(x == y).sum(axis=1) >= least, ["a", "b", "block_a", "block_b"]]

    side = lambda x: sketches.select(F.col("node").alias(x), F.col("signature").alias(f"s{x}"), F.col("block").alias(f"block_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "block_a", "block_b", "sa", "sb").mapInPandas(run, "a long, b long, block_a long, block_b long")


def _across(open_: DataFrame, reps: DataFrame, texts: DataFrame, how: MinHash) -> DataFrame:
    """Links ``(u, v)`` between different components among ``open_(node, low, c)``.

    ``low`` is the smallest node of a bucket, so nodes of one bucket share one; the
    largest component that shares it isn't compared with itself. All else is, in
    tiles of bounded size, first by signatures alone; texts go only to tiles in
    which they have a partner that signatures don't rule out, and full sets
    decide where no link of the tile has joined the two components yet.
    """
    members = keep(open_.join(reps.select("node", "n_shingles", "signature"), "node"))
    parts = members.groupBy("low", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    most = parts.groupBy("low").agg(F.max(F.struct("n", "c"))["c"].alias("major"))
    parts = parts.join(most, "low").withColumn("is_major", F.col("c") == F.col("major"))
    tiles = keep(parts.groupBy("low", "major").agg(*(F.ceil(F.coalesce(F.sum(F.when(F.col("is_major") == x, F.col("size"))), F.lit(0)) / TILE).alias(y) for x, y in ((True, "large"), (False, "small")))))
    dealt = members.join(tiles, "low").withColumn("is_major", F.col("c") == F.col("major"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_major"), F.col("large")).otherwise(F.col("small"))).cast("int")
    others = F.when(F.col("is_major"), F.transform(F.sequence(F.lit(0), F.col("small") - 1), lambda i: F.struct(i.cast("int").alias("i"), (-1 - own).alias("j"), F.lit(False).alias("left"))))
    inner = F.transform(F.sequence(F.lit(0), F.col("small") - 1), lambda i: F.struct(F.least(own, i.cast("int")).alias("i"), F.greatest(own, i.cast("int")).alias("j"), (own <= i).alias("left")))
    outer = F.transform(F.sequence(F.lit(1), F.col("large")), lambda j: F.struct(own.alias("i"), (-j).cast("int").alias("j"), F.lit(True).alias("left")))
    seats = dealt.withColumn("seat", F.explode(others.otherwise(F.concat(inner, outer)))).select("node", "c", "low", "n_shingles", "signature", "seat.*")
    bins = max(1, -(-(members.agg(F.sum("n_shingles")).first()[0] or 0) // TILE))
    seats = seats.withColumn("bin", F.pmod(F.xxhash64("low", "i", "j"), F.lit(bins)))
    least = how.least_agreement()

    def partners(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, tile in batch.groupby(["low", "i", "j"]):
            i, j, _ = _candidates(tile, least)
            out.append(tile.iloc[np.union1d(i, j)])
        return pd.concat(out)[["node", "c", "low", "n_shingles", "signature", "i", "j", "left"]]

    kinds = "node long, c long, low long, n_shingles long, signature binary, i int, j int, left boolean"
    met = keep(seats.groupBy("bin").applyInPandas(partners, kinds))
    bins = max(1, -(-(met.agg(F.sum("n_shingles")).first()[0] or 0) // (2 * TILE)))
    with_texts = met.drop("n_shingles").withColumn("bin", F.pmod(F.xxhash64("low", "i", "j"), F.lit(bins))).join(texts, "node")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        for _, tile in batch.groupby(["low", "i", "j"]):
            sets = list(shingle_sets(tile["text"].tolist(), how.words))
            ids, parts, joined = tile["node"].tolist(), tile["c"].tolist(), Forest()
            # Those that agree most come first.
            a, b, agree = _candidates(tile, least)
            for k in np.argsort(-agree, kind="stable").tolist():
                x, y = int(a[k]), int(b[k])
                if joined.find(parts[x]) != joined.find(parts[y]) and alike(sets[x], sets[y], how.percent):
                    found.append((ids[x], ids[y]))
                    joined.join(parts[x], parts[y])
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    found = keep(with_texts.groupBy("bin").applyInPandas(run, "u long, v long"))
    for x in (members, tiles, met):
        drop(x)
    return found


def _candidates(tile: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``(i, j)`` of a tile that are of different components and agree in so many minima, and how many these are."""
    marks = np.frombuffer(b"".join(tile["signature"]), dtype=np.uint8).reshape(len(tile), -1)
    part, left = tile["c"].to_numpy(), tile["left"].to_numpy(dtype=bool)
    square = tile["i"].iloc[0] == tile["j"].iloc[0]
    rows = np.arange(len(tile)) if square else np.flatnonzero(left)
    right = None if square else np.flatnonzero(~left)
    out = []
    for i in rows.tolist():
        others = np.arange(i + 1, len(tile)) if square else right
        others = others[part[others] != part[i]]
        agree = (marks[others] == marks[i]).sum(axis=1)
        good = np.flatnonzero(agree >= least)
        out.append((np.full(len(good), i), others[good], agree[good]))
    return tuple(np.concatenate([x[k] for x in out] or [np.zeros(0, dtype=np.int64)]) for k in range(3))


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sorted sets have 100 * |x & y| >= percent * |x | y|."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int(np.count_nonzero(y[at] == x))
    return 100 * common >= percent * (len(x) + len(y) - common)


def near_duplicates(docs: DataFrame, how: MinHash | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of each row of ``docs(doc_id, text)``.

    Documents with ``100 * |A & B| >= percent * |A | B|`` on their full shingle
    sets are linked; a component's id is its smallest doc_id. A null or empty
    text has an empty set and links with nothing. A text of fewer words than a
    shingle counts as one shingle. Rows that repeat a doc_id, with one text or
    several, are one document: they fall into one component and each keep their
    row. Rows of a null doc_id are returned with a null component and kept. Other
    columns of ``docs`` are ignored.
    """
    how = how or MinHash()
    docs = docs.select("doc_id", "text")
    all_rows = keep(sketch(docs, how))
    full = all_rows.where("n_shingles > 0 and doc_id is not null")
    classes, plain = _nodes(keep(full.groupBy("same").agg(F.min("doc_id").alias("rep"))))
    # A row of each class; copies of a class differ in their ids, copies of a row go first.
    once = full.dropDuplicates(["same", "doc_id"])
    reps = keep(once.join(classes.select(F.col("same").alias("s"), "rep", "node"), F.expr("same = s and doc_id = rep")).select("node", "doc_id", "th", "n_shingles", "bands", "signature"))
    keyed = reps.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1")
    shared = keep(keyed.join(shared, "key").select("key", "node", "low", "high"))
    # Texts of nodes that share a bucket. The list of them grows with the input, so both sides are dealt by key at every size.
    open_ = shared.select("node").distinct().join(reps.select("node", "doc_id", "th"), "node")
    one_each = docs.withColumn("th", F.xxhash64("text")).groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    texts = keep(one_each.join(open_.hint("merge"), ["doc_id", "th"]).select("node", "text"))
    #: Blocks: by the smallest leader a node has, split by hash where many share it.
    home = shared.groupBy("node").agg(F.min("low").alias("home"))
    sizes = home.groupBy("home").agg(F.count(F.lit(1)).alias("size"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)))
    sketches = keep(home.join(sizes, "home").select("node", block.alias("block")).join(reps.select("node", "signature"), "node"))

    leaders = shared.select(F.explode(F.array("low", "high")).alias("a"), F.col("node").alias("b")).where("a <> b")
    leaders = leaders.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = _verify(_agree(leaders, sketches, how), texts, how)
    drop(sketches)
    # Rows of one id are one document, whatever their texts.
    ids = full.groupBy("doc_id").agg(F.min("same").alias("a"), F.max("same").alias("b")).where("a <> b").select("doc_id")
    of_ids = full.select("doc_id", "same").join(ids, "doc_id").join(classes, "same").select("doc_id", "node").distinct()
    edges = edges.union(of_ids.join(of_ids.groupBy("doc_id").agg(F.min("node").alias("least")), "doc_id").select("node", "least"))
    found = components(edges)
    # Buckets whose members are in different components.
    named = shared.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    split = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("node").alias("low")).where("c0 <> c1").select("key", "low")
    more = _across(keep(named.join(split, "key").select("node", "low", "c").distinct()), reps, texts, how)
    if not more.isEmpty():
        found = components(edges.union(more))
    for x in (shared, texts, reps):
        drop(x)
    if not plain:
        centres = found.select(F.col("component").alias("node"), "component").distinct()
        joined = found.union(centres).join(classes, "node")
        found = joined.join(joined.groupBy("component").agg(F.min("rep").alias("first")), "component").select("node", F.col("first").alias("component"))

    result = (
        all_rows.select("doc_id", "n_shingles", "same")
        .join(classes, "same", "left")
        .join(found, "node", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    return result
