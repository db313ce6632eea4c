"""Suffix-array removal of repeated passages, sharded by content.

Every string of ``length`` bytes has one minimizer, the leftmost 32-byte piece
of least hash in it. Neighbouring strings that share theirs form a segment of at
most ``2 * length`` bytes, and equal strings have equal minimizers, so they are in
segments of one minimizer. Minimizers that occur once end here, which is nearly
all text that doesn't repeat. Segments of the others go to shards by minimizer;
each shard builds one suffix array by induced sorting and its permuted common
prefixes, and every start with a common prefix of ``length`` is a repeat.

Scale: equal segments are counted before they move and are repeats as they are,
so thousands of copies are one segment in one shard. A minimizer with more than
``Repeats.many`` different segments is split by the content around it; what is
still too many is counted string by string, with partial aggregates. Shards have
a bounded size. Texts are shuffled once; those with segments for shards are
written, and only they are read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, trimmed
from .sais import common_prefixes, suffix_array

#: Bytes of the piece that is a minimizer, and starts that are looked at together.
PIECE, STEP = 32, 1 << 19
_RNG = np.random.default_rng(77)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_SHORT = _RNG.integers(1, 2**32, 256, dtype=np.uint32)
_BASE = 0xD6E8FEB86659FD93
_TABLES: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Repeats:
    #: Bytes of the shortest passage that counts; 64 at least.
    length: int = 200
    #: Different segments of one minimizer that go to one shard.
    many: int = 2000
    #: Bytes of a shard's text, about; sorting it takes some 200 times as much memory.
    shard: int = 500_000


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _TABLES.get(name)
    if have is None or len(have) < n:
        have = np.full(n, base, dtype=np.uint64)
        have[0] = 1
        _TABLES[name] = have = np.multiply.accumulate(have)
    return have


class Sums:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        self.down = _powers("down", pow(_BASE, -1, 2**64), max(n, STEP + 4096))
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _powers("up", _BASE, max(n, STEP + 4096))[: n - 1], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (self.sums[b] - self.sums[a]) * self.down[a] ^ ((b - a).astype(np.uint64) << np.uint64(32))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _minimizers(data: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``length`` bytes, the place of its minimizer."""
    h = _SHORT[data]
    for k in (1, 2, 4, 8, 16):
        h = h[:-k] * np.uint32(0x85EBCA6B) + h[k:] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
    best = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    span, width = length - PIECE + 1, 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: -(span - width)], best[span - width :])
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(number of text, starts, lengths, offsets of minimizers, their hashes, hashes of segments)``."""
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> Iterator:
        data = np.frombuffer(b"".join(x[2] for x in group), dtype=np.uint8)
        sums, place = Sums(data), _minimizers(data, length)
        base = 0
        for number, begin, piece in group:
            own = place[base : base + len(piece) - length + 1]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            last = np.append(first[1:], len(own)) - 1
            a, b, m = base + first, base + last + length, own[first]
            yield number, begin + first, b - a, m - a, sums.of(m, m + PIECE), sums.of(a, b)
            base += len(piece)

    for number, data in enumerate(texts):
        for begin in range(0, len(data) - length + 1, STEP):
            piece = data[begin : begin + STEP + length - 1]
            if group and size + len(piece) > STEP + length:
                yield from flush()
                group, size = [], 0
            group.append((number, begin, piece))
            size += len(piece)
    if group:
        yield from flush()


def _segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """``(mh, sa, id, th, at, span, off)`` of each segment of each text."""
    names = ["mh", "sa", "id", "th", "at", "span", "off"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids, ths = (batch.column(c).to_numpy() for c in ("id", "th"))
            for k in range(0, batch.num_rows, 400):
                for number, at, span, off, mh, sa in _segments(_texts(batch.column("text").slice(k, 400)), length):
                    n = len(at)
                    yield mh.view(np.int64), sa.view(np.int64), np.full(n, ids[k + number]), np.full(n, ths[k + number]), at, span.astype(np.int16), off.astype(np.int16)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for x in run(batches):
            held.append(x)
            rows += len(x[0])
            if rows >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
                held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)

    return docs.select("id", "th", "text").mapInArrow(trimmed(gathered), "mh long, sa long, id long, th long, at long, span short, off short")


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _lists(column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Where each row's structs start, and the fields of all structs; a null list has none."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).tolist(), [x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten()]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(data: bytes, spans: list[tuple[int, int]]) -> tuple:
    """What is left of ``data`` without merged spans, as the columns of ``RESULT``."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept = b"".join([*kept, data[at:]])
    return len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")


def _shard(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Merged spans of each text that strings of ``length`` in other places of the shard repeat."""
    sizes = np.array([len(x) + 1 for x in texts])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # Symbols: 0 ends the shard, 1 ends a piece, a byte b is b + 2.
    s = np.frombuffer(b"\0".join(texts) + b"\0\0", dtype=np.uint8).astype(np.int32) + 2
    s[begins + sizes - 1] = 1
    s[-1] = 0
    room = np.zeros(len(s), dtype=np.int64)
    room[:-1] = np.repeat(begins + sizes - 1, sizes) - np.arange(len(s) - 1)
    order = suffix_array(s, 258)
    plcp, phi = common_prefixes(s, order, begins, room)
    mark = plcp >= length
    mark[phi[mark]] = True
    hits = np.flatnonzero(mark)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    owner = np.searchsorted(begins, hits, side="right") - 1
    first = np.flatnonzero((np.diff(hits, prepend=-2) > 1) | (np.diff(owner, prepend=-1) > 0))
    last = np.append(first[1:], len(hits)) - 1
    for k, a, b in zip(owner[first].tolist() if len(hits) else [], hits[first].tolist(), hits[last].tolist(), strict=False):
        out[k].append((a - int(begins[k]), b - int(begins[k]) + length))
    return out


def remove_repeats(docs: DataFrame, how: Repeats | None = None, carry: list[str] | None = None) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of each row of ``docs(doc_id, text)``.

    Each byte of a text that a string of ``how.length`` bytes covers which also
    starts elsewhere, in this or another row, is removed, in all places alike.
    ``kept`` is the rest as text, where characters that a cut splits are left
    out; the digest is of the rest's bytes. Null and empty texts have no bytes,
    and shorter ones than the length lose none. Repeated rows are texts of their
    own and so repeat each other. A null doc_id is an id. Other columns are
    ignored, but for those in ``carry``, which come back beside these.
    """
    how = how or Repeats()
    length = how.length
    carry = carry or []
    with_ = [f"with_{c}" for c in carry]
    # A row is known by its id and a hash of its text, which also says whether the id is null.
    docs = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text", F.xxhash64("text", F.col("doc_id").isNull()).alias("th"), *(F.col(c).alias(w) for c, w in zip(carry, with_, strict=True)))
    kept_cols = ["no_id", *with_]
    kinds_of = {f.name: f.dataType.simpleString() for f in docs.schema}
    every = keep(_segment_rows(docs, length))
    # Tables of their own, so that both sides of a join are dealt by its key and a hot key's rows can be split.
    shared = keep(every.groupBy("mh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mh"))
    rows = keep(every.join(shared, "mh"))
    drop(every)
    drop(shared)
    one = F.min(F.struct("id", "th", "at", "span", "off"))
    kinds = keep(rows.groupBy("mh", "sa").agg(F.count(F.lit(1)).alias("n"), one.alias("one")))
    different = keep(kinds.groupBy("mh").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    covered = rows.join(kinds.where("n > 1").select("mh", "sa"), ["mh", "sa"]).select("id", "th", "at", "span", F.lit(0).cast("short").alias("off"), F.lit(0).cast("long").alias("mh"), F.lit(0).alias("way"))
    compared = kinds.join(different, "mh").select("one.*", "mh", F.when(F.col("n") > 1, 2).otherwise(1).alias("way"), (F.col("kinds") > how.many).alias("hot"))
    compared = compared.select("id", "th", "at", "span", "off", "mh", (F.col("way") + F.when(F.col("hot"), 2).otherwise(0)).alias("way"))
    # way: 0 a repeat; 1 to be compared; 2 compared, and a repeat; 3 and 4 the same of a hot minimizer.
    # A set, as rows that repeat an id and a text have the same parts: a list is never longer than its text.
    own = covered.union(compared).groupBy("id", "th").agg(F.collect_set(F.struct("at", "span", "off", "mh", "way")).alias("parts"))
    left = docs.join(own, ["id", "th"], "left").select("id", "th", "text", "parts", *kept_cols)

    part = "array<struct<at:long,span:int,off:int,mh:long,way:int>>"
    result = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    carried = "".join(f", {w} {kinds_of[w]}" for w in kept_cols)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                now = batch.slice(k, 500)
                bounds, (at, span, off, mh, way) = _lists(now.column("parts"))
                spans, more, done, cut = [], [], [], []
                for data, a, b in zip(_texts(now.column("text")), bounds[:-1], bounds[1:], strict=True):
                    sure = np.flatnonzero(way[a:b] == 0) + a
                    spans.append(_merged(list(zip(at[sure].tolist(), (at[sure] + span[sure]).tolist(), strict=True))))
                    open_ = np.flatnonzero(way[a:b]) + a
                    more.append(list(zip(*(x[open_].tolist() for x in (at, span, off, mh, way)), strict=True)))
                    done.append(not len(open_))
                    cut.append((None,) * len(RESULT) if len(open_) else _cut(data, spans[-1]))
                text = now.column("text").take(pa.array([None if x else i for i, x in enumerate(done)], pa.int64()))
                yield _batch({"id": now.column("id"), "th": now.column("th"), "text": text, "spans": _structs(spans, ("a", "b")), "more": _structs(more, ("at", "span", "off", "mh", "way"), {"span": pa.int32(), "off": pa.int32(), "way": pa.int32()}), "done": pa.array(done), **_results(cut), **{w: now.column(w) for w in kept_cols}})

    met = keep(left.mapInArrow(trimmed(first), f"id long, th long, text string, spans array<struct<a:long,b:long>>, more {part}, done boolean, {result}{carried}"))
    for x in (rows, kinds, different):
        drop(x)
    open_ = met.where("not done").select("id", "th", "text", "spans", "more", *kept_cols)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments with their bytes; those of hot minimizers cut to stretches of 32 starts, keyed by what these share."""
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                now = batch.slice(k, 200)
                bounds, fields = _lists(now.column("more"))
                every = list(zip(*(x.tolist() for x in fields), strict=True))
                out = []
                for id_, th, data, a, b in zip(now.column("id").to_pylist(), now.column("th").to_pylist(), _texts(now.column("text")), bounds[:-1], bounds[1:], strict=True):
                    for at, span, off, mh, way in every[a:b]:
                        if way < 3:
                            out.append((mh, id_, th, at, data[at : at + span], way == 2))
                            continue
                        # The start's distance before the minimizer, in stretches.
                        for band in range(-(-length // PIECE)):
                            lo, hi = max(at, at + off - PIECE * (band + 1) + 1), min(at + span - length, at + off - PIECE * band)
                            if lo <= hi:
                                core = data[at + off - PIECE * band : at + off - PIECE * (band + 1) + 1 + length]
                                key = hashlib.blake2b(core + bytes([band]), digest_size=8).digest()
                                out.append((int.from_bytes(key, "little", signed=True), id_, th, lo, data[lo : hi + length], way == 4))
                yield _rows(out, ("key", "id", "th", "at", "piece", "known"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()))

    cut = keep(open_.mapInArrow(trimmed(pieces), "key long, id long, th long, at long, piece binary, known boolean"))
    sizes = cut.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = cut.agg(F.sum(F.length("piece"))).first()[0] or 0
    shards = max(1, -(-total // how.shard))
    keyed = cut.join(sizes, "key")
    small = keyed.where(F.col("n") <= how.many).where("n > 1").select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "id", "th", "at", "piece", "known")

    def sort(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        found = _shard(batch["piece"].tolist(), length)
        for id_, th, at, known, spans in zip(batch["id"], batch["th"], batch["at"], batch["known"], found, strict=True):
            if not known:
                out += [(id_, th, at + a, at + b) for a, b in spans]
        return pd.DataFrame(out, columns=["id", "th", "a", "b"], dtype="int64")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                now, out = batch.slice(k, 500), []
                for id_, th, at, piece in zip(*(now.column(c).to_pylist() for c in ("id", "th", "at", "piece")), strict=True):
                    for i in range(len(piece) - length + 1):
                        out.append((hashlib.blake2b(piece[i : i + length], digest_size=16).digest(), id_, th, at + i))
                yield _rows(out, ("digest", "id", "th", "a"), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))

    # Minimizers whose text around them is the same still more often: string by string.
    single = keyed.where(F.col("n") > how.many).select("id", "th", "at", "piece").mapInArrow(trimmed(strings), "digest binary, id long, th long, a long")
    twice = single.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    single = single.join(twice, "digest").select("id", "th", "a", (F.col("a") + length).alias("b"))
    found = small.groupBy("shard").applyInPandas(sort, "id long, th long, a long, b long").union(single)
    found = found.groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("found"))
    rest = open_.join(found, ["id", "th"], "left").select("id", "text", "spans", "found", *kept_cols)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                now = batch.slice(k, 500)
                one, two = (_lists(now.column(c)) for c in ("spans", "found"))
                cut = []
                for i, data in enumerate(_texts(now.column("text"))):
                    spans = [x for bounds, (a, b) in (one, two) for x in zip(a[bounds[i] : bounds[i + 1]].tolist(), b[bounds[i] : bounds[i + 1]].tolist(), strict=True)]
                    cut.append(_cut(data, _merged(spans)))
                yield _batch({"id": now.column("id"), **_results(cut), **{w: now.column(w) for w in kept_cols}})

    closed = met.where("done").select("id", *RESULT, *kept_cols)
    both = closed.union(rest.mapInArrow(trimmed(last), f"id long, {result}{carried}"))
    return both.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), *RESULT, *(F.col(w).alias(c) for c, w in zip(carry, with_, strict=True)))


RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _rows(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def _results(cut: list[tuple]) -> dict:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return {c: pa.array([x[i] for x in cut], k) for i, (c, k) in enumerate(zip(RESULT, kinds, strict=True))}


def _structs(lists: list[list[tuple]], names: tuple, kinds: dict | None = None) -> pa.Array:
    """A list of structs for each row."""
    flat = [x for own in lists for x in own]
    fields = [pa.array([x[i] for x in flat], (kinds or {}).get(c, pa.int64())) for i, c in enumerate(names)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, list(names)))
