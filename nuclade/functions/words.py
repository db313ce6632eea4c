"""Words of sequences as integers, two bits a symbol, and how many of them sequences share."""

from __future__ import annotations

import numpy as np
import pandas as pd

_CODE = np.full(256, 4, dtype=np.int64)
for _i, _s in enumerate(("A", "C", "G", "TU")):
    _CODE[[ord(x) for x in _s]] = _i
#: Targets that are counted at once.
CHUNK = 200


def distinct(seqs: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(sequence, word)`` of the distinct words of k upper-case A, C, G, T or U (as T) of each sequence, sorted."""
    joined = "\n".join([*seqs, ""]).encode("latin-1", "replace")
    code = _CODE[np.frombuffer(joined, dtype=np.uint8)]
    if len(code) < k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(seqs)), [len(x) + 1 for x in seqs])
    n = len(code) - k + 1
    word, good = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for j in range(k):
        word = word << 2 | code[j : j + n] & 3
        good &= code[j : j + n] < 4
    both = np.sort(owner[:n][good] << 2 * k | word[good])
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both >> 2 * k, both & (1 << 2 * k) - 1


def shared(queries: pd.DataFrame, targets: pd.DataFrame, k: int, least: int, top: int | None) -> pd.DataFrame:
    """``(q, t, shared, t_len)`` of rows ``(q, seq)`` and ``(t, seq)`` with ``least`` words in common, or all of a query that has fewer.

    With ``top``, only so many targets of a query: most words first, then the
    shortest, then the smallest ``t``.
    """
    none = pd.DataFrame({"q": [], "t": [], "shared": [], "t_len": []}, dtype="int64")
    qi, qw = distinct(queries["seq"].tolist(), k)
    ti, tw = distinct(targets["seq"].tolist(), k)
    known = np.sort(qw)
    known = known[np.append(True, known[1:] != known[:-1])] if len(known) else known
    if not len(known) or not len(tw):
        return none
    has = np.zeros((len(known), len(queries)), dtype=np.uint8)
    has[np.searchsorted(known, qw), qi] = 1
    need = np.minimum(least, np.bincount(qi, minlength=len(queries)))
    need[need == 0] = 1 << 30
    row = np.minimum(np.searchsorted(known, tw), len(known) - 1)
    met = known[row] == tw
    ti, row = ti[met], row[met]
    own, first = np.unique(ti, return_index=True)
    ends = np.append(first, len(ti))
    out = []
    for a in range(0, len(own), CHUNK):
        b = min(a + CHUNK, len(own))
        counts = np.add.reduceat(has[row[ends[a] : ends[b]]], first[a:b] - first[a], axis=0, dtype=np.int32)
        t, q = np.nonzero(counts >= need)
        out.append((q, own[a:b][t], counts[t, q]))
    q, t, n = (np.concatenate([x[i] for x in out]) for i in range(3))
    lens = targets["seq"].str.len().to_numpy(dtype=np.int64)
    found = pd.DataFrame({"q": queries["q"].to_numpy()[q], "t": targets["t"].to_numpy()[t], "shared": n.astype(np.int64), "t_len": lens[t]})
    if top is not None:
        found = found.sort_values(["q", "shared", "t_len", "t"], ascending=[True, False, True, True], kind="stable")
        found = found[found.groupby("q").cumcount() < top]
    return found
