"""Density detectors on feature vectors: Gaussian mixtures with a BIC sweep, kernel density, linear one-class margin.

Fits take all rows, in passes that add up sums (see passes). Only the starting points of mixtures come from a bounded sample
(``SEED_ROWS``, smallest id hashes). Scores are one pass over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typica.operators import blocks
from typica.operators.blocks import Fold, fold_pairs, scan, small
from typica.operators.cells import fold_near
from typica.operators.passes import Rows, as_rows
from typica.storage import write_out


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """(n, K): log weight plus log density."""
        out = np.empty((len(x), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            out[:, k] = np.log(max(w, 1e-300)) - 0.5 * ((z * z).sum(0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(root)).sum()
        return out

    def log_density(self, x: np.ndarray) -> np.ndarray:
        p = self.log_parts(x)
        top = p.max(1)
        return top + np.log(np.exp(p - top[:, None]).sum(1))

    def raw_density(self, x: np.ndarray) -> np.ndarray:
        """log of the weighted exponentials without determinants or normalisers."""
        total = sum(w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.pinv(c), x - m)) for w, m, c in zip(self.weights, self.means, self.covariances, strict=True))
        return np.log(total + 1e-45)


def seeds(x: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """k rows; each next one is drawn by its squared distance to those before."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(x)))]
    far = ((x - x[at[0]]) ** 2).sum(1)
    for _ in range(k - 1):
        at.append(int(rng.choice(len(x), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(x))))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def _em_sums(model: Mixture | np.ndarray, x: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """Log likelihood, and per component the sums of shares, of rows and of their products about origin. model: a mixture,
    or starting rows, to the nearest of which a row belongs."""
    if isinstance(model, Mixture):
        p = model.log_parts(x)
        top = p.max(1, keepdims=True)
        e = np.exp(p - top)
        r = e / e.sum(1, keepdims=True)
        fit = float((top[:, 0] + np.log(e.sum(1))).sum())
    else:
        r = np.eye(len(model))[np.argmin(((x[:, None] - model[None]) ** 2).sum(-1), 1)] if len(x) else np.zeros((0, len(model)))
        fit = 0.0
    g = x - origin
    return np.concatenate(([fit], r.sum(0), (r.T @ g).ravel(), np.einsum("nk,ni,nj->kij", r, g, g, optimize=True).ravel()))


def _em_model(s: np.ndarray, k: int, d: int, kind: str, ridge: float, origin: np.ndarray) -> Mixture:
    size = s[1 : 1 + k] + 1e-10
    means = s[1 + k : 1 + k + k * d].reshape(k, d) / size[:, None]
    cov = s[1 + k + k * d :].reshape(k, d, d) / size[:, None, None] - means[:, :, None] * means[:, None, :]
    if kind == "tied":
        cov = np.broadcast_to(np.einsum("k,kij->ij", size / size.sum(), cov), (k, d, d))
    elif kind == "diag":
        cov = np.stack([np.diag(np.diag(c)) for c in cov])
    elif kind == "spherical":
        cov = np.stack([np.eye(d) * np.diag(c).mean() for c in cov])
    elif kind != "full":
        raise ValueError(f"covariance {kind!r}")
    return Mixture(size / size.sum(), means + origin, _positive(cov, ridge))


def _positive(cov: np.ndarray, ridge: float) -> np.ndarray:
    """The covariances with ridge added, once negative rounding errors of their eigenvalues are cut off."""
    values, vectors = np.linalg.eigh((cov + np.swapaxes(cov, 1, 2)) / 2)
    return np.einsum("kij,kj,klj->kil", vectors, np.maximum(values, 0.0) + ridge, vectors)


def fit_mixtures(rows: np.ndarray | DataFrame | Rows, sizes: list[int], kind: str = "full", *, rounds: int = 100, tolerance: float = 1e-3, ridge: float = 1e-6, seed: int = 42) -> list[tuple[Mixture, float]]:
    """A mixture and its log likelihood for every size, by EM over all rows. A pass serves all sizes that still move.

    kind: full, tied, diag or spherical.
    """
    with as_rows(rows) as rows:
        some, origin, d = rows.some(), rows.moments()[0], rows.d
        models: list[Mixture | np.ndarray] = [seeds(some, k, seed) for k in sizes]
        before, moving, last = [-np.inf] * len(sizes), list(range(len(sizes))), [0.0] * len(sizes)
        for t in range(rounds + 1):
            now = [models[i] for i in moving]
            cuts = np.cumsum([0, *(1 + sizes[i] * (1 + d + d * d) for i in moving)])
            sums = rows.sums(lambda x, now=now: np.concatenate([_em_sums(m, x, origin) for m in now]))
            still = []
            for i, lo, hi in zip(moving, cuts, cuts[1:], strict=False):
                s, fit = sums[lo:hi], float(sums[lo]) / rows.n
                if t:
                    last[i] = float(s[0])
                    if abs(fit - before[i]) < tolerance or t == rounds:
                        continue
                    before[i] = fit
                models[i] = _em_model(s, sizes[i], d, kind, ridge, origin)
                still.append(i)
            moving = still
            if not moving:
                break
        return list(zip(models, last, strict=True))


def fit_mixture(rows: np.ndarray | DataFrame | Rows, k: int, kind: str = "full", **options) -> Mixture:
    return fit_mixtures(rows, [k], kind, **options)[0][0]


def n_parameters(k: int, d: int, kind: str) -> int:
    cov = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[kind]
    return cov + k * d + k - 1


def best_mixture(rows: np.ndarray | DataFrame | Rows, sizes: tuple[int, ...] = (1, 2, 4, 8, 16, 32, 64), kind: str = "full") -> Mixture:
    """The size of the lowest BIC among those that the rows allow."""
    with as_rows(rows) as rows:
        fits = fit_mixtures(rows, [k for k in sizes if k <= rows.n], kind)
        bic = [-2 * fit + n_parameters(len(m.weights), rows.d, kind) * np.log(rows.n) for m, fit in fits]
        return fits[int(np.argmin(bic))][0]


def mixture_score(rows: DataFrame, model: Mixture, *, raw: bool = False) -> DataFrame:
    def work(block, _, v, __):
        return {"score": block.raw_density(v) if raw else block.log_density(v)}

    return scan(rows, model, work, [("score", "double")])


@dataclass
class Kernel:
    """points: a matrix, or a DataFrame (id, v) of any size."""

    points: tuple[np.ndarray, np.ndarray] | DataFrame  # different points and how often each occurs, or a written table (id, v, w)
    n: int
    inverse_root: np.ndarray
    log_norm: float


def different(rows: Rows) -> tuple[np.ndarray, np.ndarray] | DataFrame:
    """Equal rows once, with their number: what sums over rows need."""
    if rows.frame is None:
        return np.unique(rows.x, axis=0, return_counts=True)
    return write_out(rows.frame.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("w")).select(F.xxhash64("v").alias("id"), "v", "w"), "points")


def fit_kernel(x: np.ndarray | DataFrame) -> Kernel:
    """Scott's bandwidth on the unbiased covariance of all rows."""
    with as_rows(x) as rows:
        d, h = rows.d, rows.n ** (-1.0 / (rows.d + 4))
        root = np.linalg.cholesky(np.atleast_2d(rows.moments()[1]) * h * h + 1e-6 * np.eye(d))
        return Kernel(different(rows), rows.n, np.linalg.inv(root), float(-0.5 * d * np.log(2 * np.pi) - np.log(np.diag(root)).sum()))


#: Pairs whose kernels a worker holds: 4 MB.
SUMMED = 500_000


def gaussian_sums(rows: DataFrame, points: tuple[np.ndarray, np.ndarray] | DataFrame, log_top: float, ignored: float) -> DataFrame:
    """(id, total): sums of w * exp(log_top - d^2 / 2) over all points, d the euclidean distance.

    Of a table of points those are left out whose kernel is at most ``ignored``; cells that are too far as a whole are not
    sent to a block of rows. What is left out adds up to at most ``ignored`` times the sum of all w.
    """

    def step(state: dict, q: list, b: list) -> dict:
        v, own, w, size = q[1], b[1], b[2], max(1, SUMMED // max(1, len(b[1])))
        squares = (own * own).sum(1)
        for lo in range(0, len(v), size):
            part = v[lo : lo + size]
            d2 = (part * part).sum(1)[:, None] + squares[None]
            d2 -= 2 * part @ own.T
            np.maximum(0, d2, out=d2)
            d2 *= -0.5
            d2 += log_top
            state["total"][lo : lo + size] += np.exp(d2, out=d2) @ w
        return state

    fold = Fold(lambda k: {"total": np.zeros(k)}, step, lambda s: s, [("total", "double")], lambda: {"total": F.sum("total")})
    given = rows.select("id", "v")
    if not isinstance(points, DataFrame):
        held = pa.table({"id": np.arange(len(points[0])), "v": pa.array(list(points[0]), pa.list_(pa.float64())), "w": np.asarray(points[1], np.float64)})
        if held.num_rows <= blocks.BANK_ROWS:
            return fold_pairs(given, given, fold, held=held).select("id", "total")
        points = rows.sparkSession.createDataFrame(held)
    points = points.select("id", "v", "w")
    held = small(points, blocks.BANK_ROWS)
    if held is not None:
        return fold_pairs(given, points, fold, held=held).select("id", "total")
    reach = F.lit(float(np.sqrt(max(0.0, 2 * (log_top - np.log(ignored))))))
    return fold_near(given, points, fold, limits=(reach, reach)).select("id", "total")


#: What a density may be off by where points are left out: a score is ln(density + 1e-10), so it is off by 1e-7 at most.
IGNORED = 1e-17


def kernel_score(rows: DataFrame, model: Kernel) -> DataFrame:
    """log(density + 1e-10). Equal points are one with their number; far points that could change no score by 1e-7 are left
    out; all others are summed."""
    whitened = lambda d: scan(d, model.inverse_root.T, lambda root, _, v, more: {"v": list(v @ root)} | ({"w": more[0]} if more else {}), [("v", "array<double>"), ("w", "double")][: len(d.columns) - 1])
    points = whitened(model.points.select("id", "v", "w")) if isinstance(model.points, DataFrame) else (model.points[0] @ model.inverse_root.T, model.points[1])
    found = gaussian_sums(whitened(rows.select("id", "v")), points, model.log_norm, IGNORED)
    return found.select("id", F.ln(F.col("total") / model.n + 1e-10).alias("score"))


#: Ranges of a margin's values by which a pass finds its low end.
BINS = 1024


def _low_ends(rows: Rows, ws: list[np.ndarray], nus: list[float], reach: float) -> list[tuple[np.ndarray, float, float]]:
    """Per w the mean row of the nu share with the lowest w.x, the mean of w.x over it, and the value up to which it goes.

    One pass counts rows and adds them up by ranges of w.x; of the range at the edge every row counts with an equal part.
    """
    d, tops = rows.d, [max(1e-12, float(np.linalg.norm(w)) * reach) for w in ws]

    def work(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ws), BINS, 1 + d))
        for k, (w, top) in enumerate(zip(ws, tops, strict=True)):
            at = np.clip(((x @ w + top) * (BINS / (2 * top))).astype(np.int64), 0, BINS - 1)
            out[k, :, 0] = np.bincount(at, minlength=BINS)
            for j in range(d):
                out[k, :, 1 + j] = np.bincount(at, x[:, j], BINS)
        return out.ravel()

    found = []
    for s, w, nu, top in zip(rows.sums(work).reshape(len(ws), BINS, 1 + d), ws, nus, tops, strict=True):
        want, n = nu * rows.n, s[:, 0]
        before = np.concatenate(([0.0], np.cumsum(n)[:-1]))
        part = np.clip(np.divide(want - before, n, out=np.zeros(BINS), where=n > 0), 0.0, 1.0)
        edge = int(np.flatnonzero(part > 0)[-1])
        mean = (s[:, 1:] * part[:, None]).sum(0) / want
        found.append((mean, float(mean @ w), (edge + part[edge]) * 2 * top / BINS - top))
    return found


def fit_one_classes(rows: np.ndarray | DataFrame | Rows, nus: tuple[float, ...], *, rounds: int = 200, tolerance: float = 1e-6) -> list[tuple[np.ndarray, float]]:
    """Linear one-class margins (w, rho) at the optimum of 0.5 |w|^2 - rho + mean(max(0, rho - w.x)) / nu.

    The optimal w is the shortest vector in the hull of all means of nu shares of the rows. Wolfe's algorithm finds it: the
    mean of the share with the lowest w.x joins the corners, and w moves to the shortest vector between them, until no share
    lies lower. A pass over the rows serves all nus that still move; nothing is drawn at random.
    """
    with as_rows(rows) as rows:
        mean, reach = rows.moments()[0], float(np.sqrt(_largest(rows)))
        ws: list[np.ndarray] = [mean.copy() for _ in nus]
        corners: list[np.ndarray] = [np.empty((0, rows.d)) for _ in nus]
        weights: list[np.ndarray] = [np.empty(0) for _ in nus]
        moving = list(range(len(nus)))
        for _ in range(rounds):
            still = []
            for i, (v, low, _) in zip(moving, _low_ends(rows, [ws[i] for i in moving], [nus[i] for i in moving], reach), strict=True):
                if len(corners[i]) and ws[i] @ ws[i] - low <= tolerance * max(1.0, ws[i] @ ws[i]):
                    continue
                size = len(corners[i])
                corners[i], weights[i] = shortest(np.vstack([corners[i], v]), np.append(weights[i], 0.0 if size else 1.0))
                ws[i] = weights[i] @ corners[i]
                still.append(i)
            moving = still
            if not moving:
                break
        return [(w, rho) for w, (_, _, rho) in zip(ws, _low_ends(rows, ws, list(nus), reach), strict=True)]


def _largest(rows: Rows) -> float:
    """The largest squared length of a row, rounded up to a power of two, from counts per power."""
    n = rows.sums(lambda x: np.bincount(np.clip(np.frexp((x * x).sum(1))[1] + 512, 0, 1535), minlength=1536).astype(np.float64))
    return 2.0 ** (int(np.flatnonzero(n)[-1]) - 512) if n.any() else 1.0


def shortest(corners: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corners, and their weights, that the shortest vector of their hull lies between; the last corner is new."""
    while True:
        k = len(corners)
        system = np.block([[corners @ corners.T, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
        free = np.linalg.lstsq(system, np.append(np.zeros(k), 1.0), rcond=None)[0][:k]
        if (free > 1e-12).all():
            return corners, free / free.sum()
        down = free <= 1e-12
        gap = np.where(down, weights - free, 1.0)
        step = float(np.min(np.where(down, weights / np.maximum(gap, 1e-300), 1.0)))
        weights = np.maximum(0.0, weights + min(1.0, step) * (free - weights))
        keep = weights > 1e-12
        if keep.all():
            keep[int(np.argmin(np.where(down, weights, np.inf)))] = False
        if not keep.any():
            keep[-1], weights[-1] = True, 1.0
        corners, weights = corners[keep], weights[keep] / weights[keep].sum()


def fit_one_class(x: np.ndarray | DataFrame | Rows, nu: float) -> tuple[np.ndarray, float]:
    return fit_one_classes(x, (nu,))[0]


def best_one_class(x: np.ndarray | DataFrame | Rows, nus: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2, 0.5)) -> tuple[np.ndarray, float]:
    """The nu that accepts most training rows, the first of equals."""
    with as_rows(x) as rows:
        fits = fit_one_classes(rows, nus)
        accepted = rows.sums(lambda m: np.array([(m @ w - r >= 0).sum() for w, r in fits], np.float64))
        return fits[int(np.argmax(accepted))]


def one_class_score(rows: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    def work(block, _, v, __):
        return {"score": v @ block[0] - block[1]}

    return scan(rows, model, work, [("score", "double")])


def reduction(x: np.ndarray | DataFrame | Rows, how: str, dim: int, labels: np.ndarray | None = None, classes: list[DataFrame] | None = None) -> np.ndarray:
    """(d, dim) directions: none, pca, or lda (padded with zeros); applied without centring. lda takes labels of a matrix, or
    classes as DataFrames (id, v) instead of x."""
    if how == "lda" and (labels is not None or classes is not None):
        groups = [Rows(x[labels == y]) for y in np.unique(labels)] if classes is None else [Rows(c) for c in classes]
        found = [(g.n, *g.moments()) for g in groups]
        for g in groups:
            g.done()
        d, total = groups[0].d, sum(n for n, _, _ in found)
        centre = sum(n * m for n, m, _ in found) / total
        within = sum((n - 1) * c for n, _, c in found)
        between = sum(n * np.outer(m - centre, m - centre) for n, m, _ in found)
        values, vectors = np.linalg.eig(np.linalg.pinv(within) @ between)
        keep = np.argsort(-values.real)[: min(dim, len(groups) - 1)]
        out = np.zeros((d, dim))
        out[:, : len(keep)] = vectors[:, keep].real
        return out
    with as_rows(x) as rows:
        if how == "none":
            return np.eye(rows.d)
        if how == "pca":
            _, vectors = np.linalg.eigh(rows.moments()[1])
            return np.ascontiguousarray(vectors[:, ::-1][:, :dim])
        raise ValueError(f"reduction {how!r}")


def project(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """(id, v): v times directions."""

    def work(block, _, v, __):
        return {"v": list(v @ block)}

    return scan(rows, directions, work, [("v", "array<double>")])
