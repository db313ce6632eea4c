"""SentencePiece encoding and decoding with the N best segmentations.

A text's lattice has a node at each character and an edge for each piece. It
falls apart at places that no piece of the vocabulary spans (before a word's
blank, around line ends), so the best paths of all distinct chunks of a batch
are found at once: forward Viterbi scores, backward ones, and from both the cost
of each chunk's second-best path. Only the N-1 chunks whose second paths cost
least can differ in the N best segmentations of a text; those are searched by
A* from the back of their lattices, where the forward Viterbi score is the exact
cost of what is left.

Scale: one pass over the texts without any shuffle. The model file is read on
the driver and its pieces, of fixed size, go along with the function.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Chunks of up to so many characters are laid side by side, so many at once; for longer ones the same is done by position.
WIDE, ROWS = 64, 12_000
#: Searches kept between batches, and their characters; texts' characters in one batch, which bound what a worker holds.
CACHE, HELD, BATCH = 100_000, 1 << 21, 1 << 19
LOW = -1e30
_SPREAD = 0x9E3779B97F4A7C15


@dataclass
class Vocabulary:
    """Pieces with scores; a character without a piece is unknown and becomes its UTF-8 bytes."""

    pieces: list[str]
    scores: list[float]
    #: Ids of normal pieces, and of the 256 bytes (or of the unknown piece, 256 times).
    normal: list[int]
    bytes_: list[int]
    unknown: int
    by_text: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.by_text = {self.pieces[i]: i for i in self.normal}
        self.longest = max(map(len, self.by_text), default=1)
        #: What pieces start with, and what they end with.
        self.heads = {p[:k] for p in self.by_text for k in range(1, len(p))}
        self.tails = {p[k:] for p in self.by_text for k in range(1, len(p))}
        self.unknown_score = min((self.scores[i] for i in self.normal), default=0.0) - 10
        blank_inside = any(BLANK in p.lstrip(BLANK) for p in self.by_text)
        line_inside = any("\n" in p and len(p) > 1 for p in self.by_text)
        self.at_blanks, self.at_lines = not blank_inside, not line_inside
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for text, i in self.by_text.items():
            at = 0
            for c in text:
                key = (at, ord(c))
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                at = nodes[key]
            ends[at] = i
        # Open addressing: a slot holds a node and a character, and where they lead.
        self.shift = 64 - max(8, (4 * len(nodes)).bit_length())
        self.keys = np.full((1 << (64 - self.shift)) + 64, -1, dtype=np.int64)
        self.to = np.full(len(self.keys), -1, dtype=np.int64)
        self.probes = 1
        for (node, c), child in nodes.items():
            key = node << 21 | c
            at = (key * _SPREAD & (1 << 64) - 1) >> self.shift
            probe = 0
            while self.keys[at + probe] >= 0:
                probe += 1
            self.keys[at + probe], self.to[at + probe] = key, child
            self.probes = max(self.probes, probe + 1)
        self.ends = np.array(ends, dtype=np.int32)
        self.values = np.append(np.array(self.scores), [self.unknown_score, LOW])
        self.text_of = [p.encode() for p in self.pieces]
        for b, i in enumerate(self.bytes_):
            if i != self.unknown:
                self.text_of[i] = bytes([b])

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))]
        bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], normal, bytes_, sp.unk_id())

    def cuts(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Starts of chunks: of texts, and where no piece spans a blank's or a line's edge."""
        cut = np.zeros(len(points) + 1, dtype=bool)
        cut[begins] = True
        if self.at_blanks:
            blank = points == ord(BLANK)
            cut[1:-1] |= blank[1:] & ~blank[:-1]
        if self.at_lines:
            line = points == 10
            cut[:-1] |= line
            cut[1:] |= line
        return np.flatnonzero(cut[:-1])

    def spell(self, char: str) -> list[int]:
        return [self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are put together, blanks restored, the first one dropped."""
        text = b"".join([self.text_of[i] for i in ids]).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text

    # ------------------------------------------------------------- one chunk

    def edges(self, chunk: str, start: int) -> list[tuple[int, int, float]]:
        """``(length, piece or -1, score)`` of the edges from a position, shortest first."""
        own = []
        for end in range(start + 1, len(chunk) + 1):
            i = self.by_text.get(text := chunk[start:end], -1)
            if i >= 0 or end == start + 1:
                own.append((end - start, i, self.scores[i] if i >= 0 else self.unknown_score))
            if text not in self.heads:
                break
        return own

    def forward(self, chunk: str) -> tuple[list[float], list[int]]:
        """Viterbi scores by position, and the length of the last piece, the longest of equally good ones."""
        ahead, step = [0.0] + [LOW] * len(chunk), [0] * (len(chunk) + 1)
        for i in range(len(chunk)):
            so_far = ahead[i]
            for k, _, score in self.edges(chunk, i):
                if so_far + score > ahead[i + k]:
                    ahead[i + k], step[i + k] = so_far + score, k
        return ahead, step

    def line(self, chunk: str) -> tuple[list[int], float, float]:
        """Ids of the best path, its score, and the gap to the second-best score."""
        ahead, step = self.forward(chunk)
        behind = [LOW] * len(chunk) + [0.0]
        taken, at = [0] * len(chunk), len(chunk)
        while at:
            taken[at - step[at]] = step[at]
            at -= step[at]
        ids: list[int] = []
        second = 2 * LOW
        for i in range(len(chunk) - 1, -1, -1):
            for k, piece, score in self.edges(chunk, i):
                rest = score + behind[i + k]
                behind[i] = max(behind[i], rest)
                if taken[i] != k:
                    second = max(second, ahead[i] + rest)
                else:
                    ids += [piece] if piece >= 0 else self.spell(chunk[i])[::-1]
        return ids[::-1], ahead[-1], ahead[-1] - second if second > LOW / 2 else math.inf

    def search(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first, by backward A* under forward Viterbi scores.

        A position is expanded at most n times, as no later way to it can be one
        of the n best. Of equally good states that nearest to the start comes
        first, so that the first segmentation is that of :meth:`line`.
        """
        ahead, _ = self.forward(chunk)
        heap: list = [(-ahead[-1], len(chunk), 0, 0.0, None)]
        made, found, times = 1, [], Counter()
        while heap and len(found) < n:
            _, at, _, done, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    (start, i), path = path
                    ids += [i] if i >= 0 else self.spell(chunk[start])
                found.append((done, tuple(ids)))
                continue
            times[at] += 1
            if times[at] > n:
                continue
            for start in range(at - 1, -1, -1):
                i = self.by_text.get(text := chunk[start:at], -1)
                if i >= 0 or start == at - 1:
                    score = done + (self.scores[i] if i >= 0 else self.unknown_score)
                    heapq.heappush(heap, (-(score + ahead[start]), start, made, score, ((start, i), path)))
                    made += 1
                if text not in self.tails:
                    break
        return found

    # ------------------------------------------------------------ many chunks

    def _step(self, node: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Children of trie nodes, -1 for none."""
        key = node << 21 | points
        at = ((key.view(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(self.shift)).view(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.to[at], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            here = at[open_] + probe
            found = self.keys[here]
            hit = found == key[open_]
            out[open_[hit]] = self.to[here[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def best(self, points: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> Paths:
        """The best path of each chunk ``points[start : start + len]``."""
        out = Paths(len(starts))
        for i in np.flatnonzero(lens > WIDE).tolist():
            chunk = points[starts[i] : starts[i] + lens[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            ids, score, gap = self.line(chunk)
            out.put(np.array([i]), np.array(ids, dtype=np.int64), np.array([len(ids)]), np.array([score]), np.array([gap]))
        order = np.argsort(lens, kind="stable")
        order = order[lens[order] <= WIDE]
        at = 0
        while at < len(order):
            rows = max(200, ROWS * 8 // max(8, int(lens[order[at]]) + 2))
            part = order[at : at + rows]
            part = part[lens[part] <= lens[part[0]] + 3]
            out.put(part, *self._best(points, starts[part], lens[part]))
            at += len(part)
        return out.done()

    def _best(self, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids one after the other, their counts, scores, and gaps to the second-best scores."""
        m, w = len(lens), int(lens.max())
        # Positions come before chunks in all arrays, so that each step is over neighbours.
        points = flat[np.minimum(starts[None] + np.arange(w)[:, None], len(flat) - 1)].astype(np.int64)
        here = np.arange(w)[:, None] < lens[None]
        longest = min(self.longest, w)
        none, unknown = len(self.values) - 1, len(self.values) - 2
        edge = np.full((longest, w, m), none, dtype=np.int32)
        present = np.zeros((longest, w), dtype=bool)
        row, col = np.nonzero(here)
        node = np.zeros(len(row), dtype=np.int64)
        for k in range(longest):
            to = self._step(node, points[row + k, col])
            hit = to >= 0
            row, col, node = row[hit], col[hit], to[hit]
            piece = self.ends[node]
            whole = piece >= 0
            edge[k, row[whole], col[whole]] = piece[whole]
            present[k, row[whole]] = True
            inside = row + k + 1 < lens[col]
            row, col, node = row[inside], col[inside], node[inside]
        edge[0][(edge[0] == none) & here] = unknown
        present[0] = True
        value = self.values[edge]
        ahead = np.full((w + 1, m), LOW)
        ahead[0] = 0
        step = np.zeros((w + 1, m), dtype=np.int8)
        for j in range(1, w + 1):
            for k in range(min(longest, j), 0, -1):
                if present[k - 1, j - k]:
                    new = ahead[j - k] + value[k - 1, j - k]
                    np.putmask(step[j], new > ahead[j], k)
                    np.maximum(ahead[j], new, out=ahead[j])
        behind = np.full((w + 1, m), LOW)
        behind[lens, np.arange(m)] = 0
        for i in range(w - 1, -1, -1):
            for k in range(1, min(longest, w - i) + 1):
                if present[k - 1, i]:
                    np.maximum(behind[i], value[k - 1, i] + behind[i + k], out=behind[i])
        total = behind[0].copy()
        at, ids = lens.copy(), []
        live = np.arange(m)
        while len(live):
            k = step[at[live], live].astype(np.int64)
            start = at[live] - k
            got = np.full(m, -1, dtype=np.int64)
            got[live] = edge[k - 1, start, live]
            lost = live[got[live] == unknown]
            got[lost] = -2 - points[at[lost] - 1, lost]
            ids.append(got)
            value[k - 1, start, live] = 2 * LOW
            at[live] = start
            live = live[start > 0]
        second = np.full(m, 2 * LOW)
        for k in range(1, longest + 1):
            for i in np.flatnonzero(present[k - 1, : w + 1 - k]).tolist():
                np.maximum(second, ahead[i] + value[k - 1, i] + behind[i + k], out=second)
        gap = np.where(second > LOW / 2, total - second, np.inf)
        path = np.array(ids, dtype=np.int64).T[:, ::-1]
        some = path != -1
        tokens, counts = path[some], some.sum(axis=1)
        if (tokens < 0).any():
            owner = np.repeat(np.arange(m), counts)
            spelled = {x: self.spell(chr(-2 - x)) for x in np.unique(tokens[tokens < 0]).tolist()}
            size = np.ones(len(tokens), dtype=np.int64)
            for x, own in spelled.items():
                size[tokens == x] = len(own)
            first = np.cumsum(size) - size
            wide = np.repeat(tokens, size)
            for x, own in spelled.items():
                for k, i in enumerate(own):
                    wide[first[tokens == x] + k] = i
            tokens, counts = wide, np.bincount(np.repeat(owner, size), minlength=m)
        return tokens, counts, total, gap


class Paths:
    """Best paths of chunks: ids of chunk i are ``ids[first[i] : first[i] + count[i]]``."""

    def __init__(self, n: int) -> None:
        self.first, self.count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.score, self.gap = np.zeros(n), np.zeros(n)
        self.held: list[np.ndarray] = []
        self.size = 0

    def put(self, which: np.ndarray, tokens: np.ndarray, counts: np.ndarray, score: np.ndarray, gap: np.ndarray) -> None:
        self.first[which] = self.size + np.cumsum(counts) - counts
        self.count[which], self.score[which], self.gap[which] = counts, score, gap
        self.held.append(tokens.astype(np.int32))
        self.size += len(tokens)

    def done(self) -> Paths:
        self.ids = np.concatenate(self.held) if self.held else np.zeros(0, dtype=np.int32)
        return self


def combine(options: list[list[tuple]], n: int) -> list[tuple[float, int, tuple[int, ...]]]:
    """The n best ``(cost, change of length, choice)`` of one ``(cost, change, ...)`` from each list, sorted by cost."""
    start = (0,) * len(options)
    heap = [(0.0, start)]
    seen, out = {start}, []
    while heap and len(out) < n:
        cost, pick = heapq.heappop(heap)
        out.append((cost, sum(o[k][1] for o, k in zip(options, pick, strict=True)), pick))
        for i, k in enumerate(pick):
            if k + 1 < len(options[i]):
                new = (*pick[:i], k + 1, *pick[i + 1 :])
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (cost - options[i][k][0] + options[i][k + 1][0], new))
    return out


class Encoder:
    """Encodes batches of texts; keeps the searches of some chunks, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, n: int) -> None:
        self.v, self.n = vocabulary, n
        self.more: dict[str, list[tuple[float, int, np.ndarray]]] = {}
        self.held = 0

    def encode(self, texts: list) -> Iterator[tuple[np.ndarray, list[tuple[float, int]]]]:
        """``(ids, [(score, number of ids) of the n best])`` of each text, in order."""
        for paths, best in self.segment(texts, 1):
            yield paths[0], best

    def segment(self, texts: list, whole: int | None = None) -> Iterator[tuple[list[np.ndarray], list[tuple[float, int]]]]:
        """``([ids of the n best], [(score, number of ids) of the n best])`` of each text, in order; ids of the ``whole`` best only."""
        marked = ["" if not x else BLANK + x.replace(" ", BLANK) for x in texts]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begins = np.cumsum([0, *map(len, marked)])
        starts = self.v.cuts(points, begins)
        lens = np.diff(starts, append=len(points))
        which, inverse = np.unique(_hashes(points, starts, lens), return_index=True, return_inverse=True)[1:]
        paths = self.v.best(points, starts[which], lens[which])
        bounds = np.searchsorted(starts, begins)
        count, gaps = paths.count[inverse], paths.gap[inverse]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = paths.ids[np.repeat(paths.first[inverse] - ends[:-1], count) + np.arange(ends[-1])]
        scores = np.concatenate([[0], np.cumsum(paths.score[inverse])])
        if len(self.more) > CACHE or self.held > HELD:
            self.more, self.held = {}, 0
        for t, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            cost, options, spots = gaps[a:b], [], []
            k = min(self.n - 1, b - a)
            for i in np.sort(np.argpartition(cost, k - 1)[:k]).tolist() if k else []:
                if cost[i] < np.inf:
                    begin = int(starts[a + i] - begins[t])
                    options.append(self._options(marked[t][begin : begin + int(lens[a + i])]))
                    spots.append((int(ends[a + i] - ends[a]), int(ends[a + i + 1] - ends[a])))
            n, score, own = int(ends[b] - ends[a]), float(scores[b] - scores[a]), ids[ends[a] : ends[b]]
            best = combine(options, self.n)
            yield [_replaced(own, options, spots, pick) for _, _, pick in best[:whole]], [(score - c, n + d) for c, d, _ in best]

    def _options(self, chunk: str) -> list[tuple[float, int, np.ndarray]]:
        """Cost against the best, change of length, and ids, of the n best paths of a chunk."""
        if chunk not in self.more:
            best = self.v.search(chunk, self.n)
            self.more[chunk] = [(best[0][0] - s, len(x) - len(best[0][1]), np.array(x, dtype=np.int32)) for s, x in best]
            self.held += len(chunk)
        return self.more[chunk]


def _replaced(ids: np.ndarray, options: list[list[tuple[float, int, np.ndarray]]], spots: list[tuple[int, int]], pick: tuple[int, ...]) -> np.ndarray:
    """``ids`` with those of the chosen paths in the chunks' places, where it isn't the best one."""
    out, at = [], 0
    for own, (begin, end), k in zip(options, spots, pick, strict=True):
        if k:
            out += [ids[at:begin], own[k][2]]
            at = end
    return np.concatenate([*out, ids[at:]]) if out else ids


_RNG = np.random.default_rng(9)
_LOW, _HIGH = (_RNG.integers(1, 2**63, n, dtype=np.uint64) for n in (4096, 1024))
_BASE = 0xA0761D6478BD642F
_POWERS: list[np.ndarray] = []


def _hashes(points: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A hash of each chunk."""
    if len(_POWERS) == 0 or len(_POWERS[0]) <= len(points):
        both = np.ones((2, max(BATCH, len(points)) + 1), dtype=np.uint64)
        both[0, 1:], both[1, 1:] = _BASE, pow(_BASE, -1, 2**64)
        _POWERS[:] = [np.multiply.accumulate(x) for x in both]
    up, down = _POWERS
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((_LOW[points & 4095] + _HIGH[points >> 12]) * up[: len(points)], out=sums[1:])
    return (sums[starts + lens] - sums[starts]) * down[starts] ^ (lens.astype(np.uint64) << np.uint64(48))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """An array of lists of 32-bit integers."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *rows]).astype(np.int32, copy=False)))


def encode(docs: DataFrame, vocabulary: Vocabulary, n: int = 4, with_ids: bool = True, with_paths: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_md5, score, n_best, exact[, ids])`` of each row of ``docs(doc_id, text)``.

    ``n_best`` has score and number of ids of the n best segmentations of the
    whole text, best first, and ``with_paths`` the ids of each; ``ids`` are the
    best one's and ``ids_md5`` is of them as little-endian 32-bit numbers. ``exact`` says whether decoding the ids
    gives the text again, which fails only for texts that hold the blank's own
    mark or unpaired surrogates. Null and empty texts have no ids, score 0, and
    are exact. Repeated rows are each encoded. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, n)
        for batch in batches:
            at, sizes = 0, pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            while at < batch.num_rows:
                end, size = at, 0
                while end < batch.num_rows and (end == at or size + sizes[end] <= BATCH):
                    size += sizes[end]
                    end += 1
                part, out = batch.slice(at, end - at), []
                texts = part.column("text").to_pylist()
                for text, (paths, best) in zip(texts, encoder.segment(texts, None if with_paths else 1), strict=True):
                    ids = paths[0]
                    out.append((len(ids), hashlib.md5(ids.astype("<i4").tobytes()).hexdigest(), best[0][0], best, vocabulary.decode(ids.tolist()) == (text or ""), paths))
                *columns, best, exact, paths = zip(*out, strict=True)
                columns = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                each = [x for own in best for x in own]
                parts = [pa.array([s for s, _ in each], pa.float64()), pa.array([k for _, k in each], pa.int64())]
                parts += [_lists([x for own in paths for x in own])] * with_paths
                ends = pa.array(np.cumsum([0, *map(len, best)]), pa.int32())
                columns += [pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields)), pa.array(exact, pa.bool_())]
                columns += [_lists([own[0] for own in paths])] * with_ids
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)
                at = end

    path = "score:double,n_tokens:long" + ",ids:array<int>" * with_paths
    schema = f"doc_id long, n_tokens long, ids_md5 string, score double, n_best array<struct<{path}>>, exact boolean" + ", ids array<int>" * with_ids
    names = ["doc_id", "n_tokens", "ids_md5", "score", "n_best", "exact"] + ["ids"] * with_ids
    fields, kinds = ["score", "n_tokens"] + ["ids"] * with_paths, [pa.int64(), pa.string(), pa.float64()]
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(doc_id, text)`` of each row of ``encoded(doc_id, ids)``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
