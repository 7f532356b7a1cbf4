"""A screen in short numbers before distances are worked out: pairs that are surely too far are ruled out, all others measured.

A score per pair, larger for nearer ones, comes from one product of single-precision matrices (from sums of 16-bit whole
numbers for manhattan). Bounds are lowered by the largest error that such a score can have, so no pair is lost; what is left
is measured in double precision from the vectors themselves, alike wherever a pair is met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Rows of queries and of the bank whose scores are worked out at once: 4 MB that stay in the processor's cache.
TILE_Q, TILE_B = 256, 4096
#: Of more pairs than this share of a tile those that are surely near are counted without being measured.
DENSE = 0.05
#: Components beyond this are not squared in single precision.
LARGEST = 1e15


def measured(q: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """The distances of the pairs (i, j)."""
    out = np.empty(len(i))
    for lo in range(0, len(i), 8192):
        at = slice(lo, lo + 8192)
        x, y = q[i[at]], b[j[at]]
        if metric in ("dot", "cosine"):
            d = -(x * y).sum(1)
            if metric == "cosine":
                d = 1 + d / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            out[at] = d
        else:
            x -= y
            out[at] = np.abs(x, out=x).sum(1) if metric == "manhattan" else np.sqrt(np.square(x, out=x).sum(1))
    return out


def fits(q: np.ndarray, b: np.ndarray, metric: str) -> bool:
    """Whether scores are finite: no vector is zero for cosine, no component large or missing."""
    for x in (q, b):
        top = np.abs(x).max(initial=0.0)
        if not top < LARGEST or (metric == "cosine" and len(x) and not np.einsum("ij,ij->i", x, x).min() > 1e-30):
            return False
    return True


class Screen:
    """Scores of queries and a bank that fit."""

    def __init__(self, q: np.ndarray, b: np.ndarray, metric: str):
        self.metric, d = metric, q.shape[1]
        if metric in ("euclidean", "manhattan") and len(b):
            centre = b.mean(0)
            q, b = q - centre, b - centre
        elif metric == "cosine":
            q, b = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] for x in (q, b))
        if metric == "manhattan":
            top = max(np.abs(q).max(initial=0.0), np.abs(b).max(initial=0.0), 1e-300)
            self.step = top / max(1, 32000 // (2 * d))
            self.q, self.b = (np.ascontiguousarray(np.rint(x / self.step).astype(np.int16).T) for x in (q, b))
            self.error = np.full(len(q), 1.001 * (d + 1.0))  # a difference is off by one at most
            return
        long_q, long_b = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (q, b))
        most = float(long_b.max(initial=0.0))
        self.half_q = 0.5 * long_q**2
        self.error = (d + 4) * 2.0**-23 * (long_q * most + most * most + self.half_q) + 1e-300
        if metric == "euclidean":
            q, b = np.hstack([q, np.ones((len(q), 1))]), np.hstack([b, -0.5 * (long_b**2)[:, None]])
        self.q, self.b = np.ascontiguousarray(q, np.float32), np.ascontiguousarray(b.T, np.float32)

    def scores(self, lo: int, at: int) -> np.ndarray:
        """Of the queries from lo on and the bank's rows from at on, a tile's rows of either."""
        if self.metric != "manhattan":
            return self.q[lo : lo + TILE_Q] @ self.b[:, at : at + TILE_B]
        x, y = self.q[:, lo : lo + TILE_Q], self.b[:, at : at + TILE_B]
        out = np.zeros((x.shape[1], y.shape[1]), np.int16)
        for row in range(0, len(out), 16):
            part = out[row : row + 16]
            apart = np.empty_like(part)
            for j in range(len(x)):
                np.subtract(x[j, row : row + 16, None], y[j, None], out=apart)
                np.abs(apart, out=apart)
                np.subtract(part, apart, out=part)
        return out

    def least(self, lo: int, limit: np.ndarray) -> np.ndarray:
        """Per query from lo on a score that all pairs reach whose distance is at most the limit."""
        at = slice(lo, lo + len(limit))
        if self.metric == "manhattan":
            return np.maximum(-32768, np.floor(np.maximum(-(2.0**31), -limit / self.step - self.error[at]))).astype(np.int16)
        bound = self.half_q[at] - 0.5 * limit * limit if self.metric == "euclidean" else -limit if self.metric == "dot" else 1 - limit
        return np.nextafter((bound - self.error[at] - 2.0**-22 * np.abs(bound)).astype(np.float32), np.float32(-np.inf))

    def between(self, lo: int, limit: np.ndarray, more: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """For euclidean distances, per query from lo on: a score that all pairs within the limit reach, and one beyond which
        all pairs are nearer than the limit. more: the largest square whose half is added to scores."""
        at = slice(lo, lo + len(limit))
        bound = self.half_q[at] - 0.5 * limit * limit
        slack = 2 * self.error[at] + 2.0**-20 * (np.abs(bound) + more)
        return (bound - slack).astype(np.float32), (bound + slack).astype(np.float32)

    def best(self, lo: int, scores: np.ndarray, k: int) -> np.ndarray:
        """Per query a score that all of its k nearest rows of the tile reach."""
        n = scores.shape[1]
        kth = np.partition(scores, n - k, axis=1)[:, n - k].astype(np.float64) - 2 * self.error[lo : lo + len(scores)]
        return np.maximum(-32768, np.floor(kth)).astype(np.int16) if self.metric == "manhattan" else np.nextafter((kth - 2.0**-22 * np.abs(kth)).astype(np.float32), np.float32(-np.inf))


def hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of few true values: whole words of eight are passed over."""
    flat = mask.reshape(-1)
    words = len(flat) // 8
    at = np.flatnonzero(flat[: words * 8].view(np.uint64))
    at = (at[:, None] * 8 + np.arange(8)).reshape(-1)
    at = np.concatenate([at[flat[at]], words * 8 + np.flatnonzero(flat[words * 8 :])])
    return np.divmod(at, max(1, mask.shape[1]))


def tiles(n_q: int, n_b: int) -> Iterator[tuple[int, int]]:
    """The first rows of each tile; the bank's move fastest."""
    return ((lo, at) for lo in range(0, n_q, TILE_Q) for at in range(0, n_b, TILE_B))
