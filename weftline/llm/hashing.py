"""64-bit hashes of characters, windows and token runs, over whole numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd, so that they have inverses modulo 2**64 and windows need no division; the second for 128 bits in all.
BASE, OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Windows:
    """Hashes of all windows of a given length of one text; build once, ask for several lengths."""

    def __init__(self, text: str, base: int = BASE):
        points = code_points(text)
        self.n = len(points)
        terms = mix(points.astype(np.uint64) + np.uint64(1)) * _powers(base, self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.undo = _powers(pow(base, -1, 1 << 64), self.n + 1)

    def of(self, length: int) -> np.ndarray:
        count = max(0, self.n - length + 1)
        return mix((self.sums[length : length + count] - self.sums[:count]) * self.undo[:count])


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest value of each ``width`` consecutive ones, in time independent of the width."""
    fold = np.minimum if least else np.maximum
    n = len(x)
    if n < width:
        return x[:0]
    blocks = -(-n // width)
    fill = np.iinfo(np.uint64).max if least else 0
    grid = np.full(blocks * width, fill, np.uint64)
    grid[:n] = x
    grid = grid.reshape(blocks, width)
    ahead = fold.accumulate(grid, axis=1).ravel()
    behind = fold.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(behind[: n - width + 1], ahead[width - 1 : n])


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some ``width`` consecutive ones (all places of a tie)."""
    least = sliding(hashes, width, True)
    if not len(least):
        return np.zeros(0, np.int64)
    pad = np.zeros(width - 1, np.uint64)
    best = sliding(np.concatenate([pad, least, pad]), width, False)
    return np.flatnonzero(best == hashes)


class Tokens:
    """Hashes of runs of consecutive tokens; token hashes are remembered within a task."""

    def __init__(self, limit: int = 200_000):
        self.seen: dict[str, int] = {}
        self.limit = limit

    def runs(self, tokens: list[str], length: int) -> np.ndarray:
        """Sorted distinct hashes of the runs of ``length`` tokens, as signed longs."""
        if len(tokens) < length:
            return np.zeros(0, np.int64)
        if len(self.seen) > self.limit:
            self.seen.clear()
        seen = self.seen
        codes = np.empty(len(tokens), np.uint64)
        for i, t in enumerate(tokens):
            h = seen.get(t)
            if h is None:
                h = seen[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
            codes[i] = h
        n = len(tokens) - length + 1
        out = np.zeros(n, np.uint64)
        for k in range(length):
            out = mix(out * np.uint64(BASE) + codes[k : k + n])
        return np.unique(out.view(np.int64))
