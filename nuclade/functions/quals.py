"""Kernels over quality strings: a batch of reads is one matrix of scores, so running sums are along its rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a matrix at most; bounds memory, not the length of a read.
CELLS = 1 << 21
#: Error probabilities by score, from the smallest score that a byte can give.
_LOW = -255
_ERROR = np.array([10.0 ** (-q / 10.0) for q in range(_LOW, 256)])


def errors(q: np.ndarray) -> np.ndarray:
    return _ERROR[q - _LOW]


def matrices(quals: pa.Array, offset: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """``(rows, scores, inside)`` of some reads at a time; a null quality is an empty one."""
    quals = quals.cast(pa.binary()).fill_null(b"")
    lens = np.diff(np.frombuffer(quals.buffers()[1], dtype=np.int32)[quals.offset : quals.offset + len(quals) + 1]).astype(np.int64)
    data = np.frombuffer(quals.buffers()[2] or b"", dtype=np.uint8)
    starts = np.frombuffer(quals.buffers()[1], dtype=np.int32)[quals.offset : quals.offset + len(quals)].astype(np.int64)
    at = 0
    while at < len(lens):
        end, width = at, 0
        while end < len(lens) and (end == at or max(width, lens[end]) * (end + 1 - at) <= CELLS):
            width = max(width, int(lens[end]))
            end += 1
        places = np.arange(width)[None]
        inside = places < lens[at:end, None]
        q = np.zeros(inside.shape, dtype=np.int64)
        q[inside] = data[(starts[at:end, None] + places)[inside]].astype(np.int64) - offset
        yield slice(at, end), q, inside
        at = end


def running(q: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Errors, running errors and running minima of scores along each read."""
    p = np.where(inside, errors(q), 0.0)
    return p, np.cumsum(p, axis=1), np.minimum.accumulate(q, axis=1) if q.shape[1] else q


def summed(reads: DataFrame, offset: int, columns: dict, kind: str) -> DataFrame:
    """Sums by position, ``(pos, <columns>)``, added up within batches before the shuffle.

    ``columns`` maps names to functions of ``(q, p, ee, low)``, matrices by read
    and position; positions that a read doesn't reach count as nothing.
    """
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, q, inside in matrices(batch.column(0), offset):
                p, ee, low = running(q, inside)
                sums = [np.where(inside, f(q, p, ee, low), 0).sum(axis=0) for f in columns.values()]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, q.shape[1] + 1, dtype=np.int32)), *(pa.array(x.astype(np.float64 if kind == "double" else np.int64)) for x in sums)], ["pos", *names])

    each = reads.select("qual").mapInArrow(run, f"pos int, {', '.join(f'{c} {kind}' for c in names)}")
    return each.groupBy("pos").agg(*[F.sum(c).alias(c) for c in names])


def scan(qual: Column, stops, low: int, offset: int) -> Column:
    """``struct(n, ee, low)``: symbols before the first at which ``stops(q, ee, n)`` holds, their expected error, and whether one scores below ``low``."""

    @F.pandas_udf("n int, ee double, low boolean")
    def run(quals: pd.Series) -> pd.DataFrame:
        n, total, poor = np.zeros(len(quals), dtype=np.int32), np.zeros(len(quals)), np.zeros(len(quals), dtype=bool)
        for rows, q, inside in matrices(pa.array(quals, pa.string()), offset):
            _, ee, _ = running(q, inside)
            going = np.logical_and.accumulate(inside & ~stops(q, ee, np.arange(1, q.shape[1] + 1)[None]), axis=1)
            n[rows] = going.sum(axis=1)
            if q.shape[1]:
                total[rows] = np.where(n[rows] > 0, np.take_along_axis(ee, np.maximum(n[rows, None] - 1, 0).astype(np.int64), axis=1)[:, 0], 0.0)
                poor[rows] = (going & (q < low)).any(axis=1)
        return pd.DataFrame({"n": n, "ee": total, "low": poor})

    return run(qual)


@cache
def _fold_tables(offset: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Error probabilities by symbol, the last for none, and the largest probability of each score above ``low``, ascending.

    Both are of the C library, as in the reference and SQL: a mean of equal
    errors is at the edge of a score, where other implementations of power and
    logarithm give another score.
    """
    errors_ = [0.75 if c - offset < 2 else math.pow(10.0, -(c - offset) / 10.0) for c in range(256)]
    edges = []
    for q in range(low + 1, high + 1):
        at = math.pow(10.0, -q / 10.0)
        while math.floor(-10.0 * math.log10(math.nextafter(at, 1e300))) >= q:
            at = math.nextafter(at, 1e300)
        while math.floor(-10.0 * math.log10(at)) < q:
            at = math.nextafter(at, 0.0)
        edges.append(at)
    return np.array([*errors_, np.nan]), np.array(edges[::-1])


def folded(sizes: np.ndarray, quals: pa.Array, offsets: np.ndarray, best: bool, offset: int, low: int, high: int) -> list[str | None]:
    """Qualities of each group of reads, folded one after the other; group i has the rows from ``offsets[i]`` to ``offsets[i + 1]``.

    A null quality makes its group's null. Groups are folded together, a step for
    all that have so many reads.
    """
    errors_, edges = _fold_tables(offset, low, high)
    null = np.append(0, np.cumsum(np.asarray(quals.is_null())))
    quals = quals.cast(pa.binary()).fill_null(b"")
    starts = np.frombuffer(quals.buffers()[1], dtype=np.int32)[quals.offset : quals.offset + len(quals) + 1].astype(np.int64)
    data, lens, count = np.frombuffer(quals.buffers()[2] or b"", dtype=np.uint8), np.diff(starts), np.diff(offsets)
    out: list[str | None] = [None] * len(count)
    known = np.flatnonzero((count > 0) & (null[offsets[1:]] == null[offsets[:-1]]))
    for g in known[count[known] == 1].tolist():
        out[g] = quals[int(offsets[g])].as_py().decode()
    several = known[count[known] > 1]
    width = np.array([lens[offsets[g] : offsets[g + 1]].max() for g in several.tolist()], dtype=np.int64)

    def symbols(rows: np.ndarray, wide: int) -> np.ndarray:
        places = np.arange(wide)[None]
        inside = places < lens[rows, None]
        found = np.full(inside.shape, 256, dtype=np.int16)
        found[inside] = data[(starts[rows, None] + places)[inside]]
        return found

    order = np.argsort(width, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and width[order[end]] * (end + 1 - at) <= CELLS:
            end += 1
        part = order[at:end]
        part = part[np.argsort(-count[several[part]], kind="stable")]
        own, wide = several[part], int(width[part].max())
        state, n = symbols(offsets[own], wide), sizes[offsets[own]].astype(np.float64)
        for step in range(1, int(count[own[0]])):
            live = int(np.searchsorted(-count[own], -step, side="left"))
            rows = offsets[own[:live]] + step
            x, m = symbols(rows, wide), sizes[rows].astype(np.float64)
            a, b = errors_[state[:live]], errors_[x]
            p = np.fmin(a, b) if best else (a * n[:live, None] + b * m[:, None]) / (n[:live] + m)[:, None]
            q = np.where(np.isnan(p), high, low + len(edges) - np.searchsorted(edges, p))
            state[:live] = np.where((state[:live] == 256) & (x == 256), 256, q + offset)
            n[:live] += m
        for g, row in zip(own, state, strict=True):
            out[g] = row[row < 256].astype(np.uint8).tobytes().decode("latin-1")
        at = end
    return out
