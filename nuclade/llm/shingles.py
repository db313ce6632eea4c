"""Word-shingle sets as sorted 64-bit hashes, in NumPy over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240131)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text that are hashed at once; bounds memory, not the length of a text.
STEP = 1 << 20


def _powers(base: int, n: int, name: str) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, STEP + 4096)
        have = np.ones(size, dtype=np.uint64)
        have[1:] = np.uint64(base)
        _POWERS[name] = have = np.multiply.accumulate(have)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of lower-cased bytes that end in a blank."""
    solid = ~_SPACE[data]
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    sums = _BYTE[data]
    sums *= _powers(_BASE, len(data), "up")
    np.cumsum(sums, out=sums)
    total = sums[ends - 1].copy()
    total[starts > 0] -= sums[starts[starts > 0] - 1]
    total *= _powers(_INVERSE, len(data), "down")[starts]
    return starts, _mix(total ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def _join_words(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words."""
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = _mix(total + hashes[k : len(hashes) - n + 1 + k] + np.uint64(0x632BE59BD9B4E019))
    return total


def shingle_sets(texts: list, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word runs of each text.

    Case is folded for A-Z only. A text with fewer words gives its whole sequence
    as one shingle; a null text or one without words gives an empty array.
    """
    group: list[bytes] = []
    size = 0
    for text in [*texts, ...]:
        data = b"" if text is None or text is ... else text.encode("utf-8", "surrogatepass")
        if group and (text is ... or size + len(data) > STEP):
            yield from _sets(group, words)
            group, size = [], 0
        group.append(data)
        size += len(data) + 1


def _sets(group: list[bytes], words: int) -> Iterator[np.ndarray]:
    blob = _LOWER[np.frombuffer(b" ".join(group) + b" ", dtype=np.uint8)]
    starts, hashes = _word_hashes(blob)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in group)]))
    runs = _join_words(hashes, words) if len(hashes) >= words else None
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(runs[a : b - words + 1])
        elif b > a:
            yield _join_words(hashes[a:b], b - a)
        else:
            yield np.zeros(0, dtype=np.uint64)
