"""Column-wise construction of a collection's Burrows-Wheeler transform with common prefixes.

All strings of a collection grow leftwards together: round r inserts the suffix
of length r of every string that has one. The symbol before a suffix, counted
up to its row, gives the row of the next longer suffix; its common prefixes
with the rows around it are one more than the least common prefix between the
two rows they come from. Beyond ``MEMORY`` rows the columns live in files of a
shared folder, which each round reads and writes anew, in row order.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np

#: Rows up to which the columns stay in memory.
MEMORY = 40_000_000
#: The symbol of a string's start, a byte that UTF-8 does not use; such rows stand last in an order by symbol.
END = 255


class Columns:
    """Row-aligned arrays; new generations replace old ones, in files where they are large."""

    def __init__(self, memory: int = MEMORY, folder: str | None = None) -> None:
        self.memory, self.parent, self.folder, self.made = memory, folder, None, 0

    def merge(self, old: np.ndarray, new: np.ndarray, at: np.ndarray, stay: np.ndarray) -> np.ndarray:
        """``old`` with ``new`` at rows ``at`` of the result; ``stay`` marks the other rows."""
        out = self._empty(len(stay), old.dtype)
        out[stay] = old
        out[at] = new
        return out

    def _empty(self, n: int, kind: np.dtype) -> np.ndarray:
        if n <= self.memory or self.parent is None:
            return np.empty(n, kind)
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(dir=self.parent)
        self.made += 1
        path = Path(self.folder.name, f"{self.made % 16}.bin")
        path.unlink(missing_ok=True)
        return np.memmap(path, kind, "w+", shape=(n,))

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()


def least_between(lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(lcp[lo + 1 .. hi]) for each pair; the work is the sum of the distances."""
    if not len(lo):
        return np.zeros(0, lcp.dtype)
    order = np.argsort(-lo)  # falling starts: nothing between queries is read
    ends = hi[order] + 1
    idx = np.empty(2 * len(lo), np.int64)
    idx[::2], idx[1::2] = lo[order] + 1, ends
    padded = np.append(lcp, lcp.dtype.type(0))
    out = np.empty(len(lo), lcp.dtype)
    out[order] = np.minimum.reduceat(padded, idx)[::2]
    return out


def collection(strings: list[bytes], memory: int = MEMORY, folder: str | None = None) -> tuple[np.ndarray, ...]:
    """BWT, LCP, string number and suffix length of every suffix, in lexicographic order.

    Equal suffixes of different strings are in the order of their strings. The
    empty suffixes come first. Without a ``folder`` the columns stay in memory.
    """
    m = len(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(lengths)

    def symbol(which: np.ndarray, r: int) -> np.ndarray:
        """The symbol before the suffix of length ``r``."""
        out = np.full(len(which), END, np.uint8)
        has = lengths[which] > r
        out[has] = flat[ends[which[has]] - r - 1]
        return out

    longest = int(lengths.max(initial=0))
    short = np.int16 if longest < 1 << 15 else np.int32
    store = Columns(memory, folder)
    who = np.arange(m, dtype=np.int32)
    bwt, lcp, of, size = symbol(who, 0), np.zeros(m, short), who.copy(), np.zeros(m, short)
    rows = np.arange(m)  # of the suffixes inserted last
    try:
        for r in range(1, longest + 1):
            rows = rows[bwt[rows] != END]
            by_symbol = np.argsort(bwt, kind="stable")
            # the rows inserted last, by symbol and then by row: the order of the longer suffixes
            c = bwt[rows]
            seq = np.argsort(c, kind="stable")
            c, rows = c[seq], rows[seq]
            sections = np.r_[0, np.cumsum(np.bincount(bwt, minlength=256))]
            heads = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            mine = np.empty(len(rows), np.int64)
            for lo, hi in zip(heads, np.r_[heads[1:], len(rows)]):
                a, z = sections[c[lo]], sections[c[lo] + 1]
                mine[lo:hi] = a + np.searchsorted(by_symbol[a:z], rows[lo:hi])
            # all suffixes of the next list: the empty ones, then one for each symbol but END
            at = mine + m

            p = by_symbol[np.maximum(mine - 1, 0)]
            has_p = (mine > 0) & (bwt[p] == c)
            q = by_symbol[np.minimum(mine + 1, len(by_symbol) - 1)]
            has_q = (mine + 1 < len(by_symbol)) & (bwt[q] == c)
            own = np.zeros(len(at), short)
            own[has_p] = least_between(lcp, p[has_p], rows[has_p]) + 1
            nxt = least_between(lcp, rows[has_q], q[has_q]) + 1

            fresh = np.zeros(len(bwt) + len(at), bool)
            fresh[at] = True
            stay = ~fresh
            whose = of[rows]
            bwt = store.merge(bwt, symbol(whose, r), at, stay)
            lcp = store.merge(lcp, own, at, stay)
            lcp[at[has_q] + 1] = nxt
            of = store.merge(of, whose, at, stay)
            size = store.merge(size, np.full(len(at), r, short), at, stay)
            rows = at
        return tuple(np.array(x) for x in (bwt, lcp, of, size))
    finally:
        store.close()
