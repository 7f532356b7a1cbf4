"""One-class margins with a Gaussian kernel: the dual is solved over working sets, kernel rows are worked out by executors.

The problem is that of a one-class support vector machine: weights a of the training rows with 0 <= a <= 1 and sum nu * n
that minimise a'Ka / 2. Equal rows are one with their number as the upper bound. A round takes the rows that violate the
optimality conditions most, some hundreds, solves the problem for them alone, and adds their kernel columns to all gradients.
Weights start in the rows that lie apart from a sample: most bounds are right from the start, so a few rounds are enough
however many rows there are. From equal weights every row would have to pass through a working set. The optimum is one.

Where most rows end between their bounds (vectors without structure), working sets alone would need thousands of rounds. After
the first rounds every third one then moves all weights at once: towards the optimum, within the bounds, of a model of a'Ka
that is exact along past steps and for the kernel's constant and linear part. Such a round costs one product with the whole
kernel matrix, whose tiles are dealt to the executors and never kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typica.operators.blocks import matrix
from typica.operators.density import different, gaussian_sums
from typica.operators.passes import Rows, as_rows, sample
from typica.storage import discard, numbered, write_out

#: Rows of each kind in a working set, and rounds at most.
WORKING, ROUNDS = 512, 1000
#: Rows of the sample, and ranges of its kernel sums by which a table's rows get their starting weights; they change no result.
START, RANGES = 2048, 16_384
#: Rows whose kernel values a worker has at once.
AT_ONCE = 2000
#: Rounds of working sets before the first that moves all weights, and between two such; past steps that these know.
ALONE, BETWEEN, PAST = 8, 2, 30
#: Rows to a side of a tile of the kernel matrix: 2 MB; rows from which its tiles are dealt to the executors.
TILE, DEALT = 512, 4096
#: Rows of which the driver holds weights and gradients.
HELD = 50_000
#: Kernel values that are left out of sums over tables.
IGNORED = 1e-17


@dataclass
class KernelMargin:
    """f(x) = sum of a * exp(-gamma |x - v|^2) over the support vectors, minus rho; 0 or more is typical."""

    support: tuple[np.ndarray, np.ndarray] | DataFrame
    gamma: float
    rho: float
    nu: float
    gap: float  # by how much the optimality conditions were violated at last


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d2 = np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)
    d2[d2 < 1e-12 * (1 + (a * a).sum(1).max(initial=0))] = 0
    return np.exp(-gamma * d2)


def scale_gamma(rows: Rows) -> float:
    """One over the dimensions times the variance of all components."""
    mean, cov = rows.moments()
    spread = float((np.diag(np.atleast_2d(cov)) * (rows.n - 1) / rows.n + (mean - mean.mean()) ** 2).mean())
    return 1.0 / (rows.d * spread) if spread > 0 else 1.0


def solve_part(k: np.ndarray, a: np.ndarray, cap: np.ndarray, g: np.ndarray, tolerance: float, most: int = 100_000) -> np.ndarray:
    """The weights at the optimum over the rows of k (a kernel matrix) alone, their sum kept: the most violating pair, again and again."""
    a, g = a.copy(), g.copy()
    for _ in range(most):
        i, j = int(np.where(a < cap, g, np.inf).argmin()), int(np.where(a > 0, g, -np.inf).argmax())
        if not (a[i] < cap[i] and a[j] > 0) or g[j] - g[i] <= tolerance:
            break
        step = min((g[j] - g[i]) / max(2 - 2 * k[i, j], 1e-12), cap[i] - a[i], a[j])
        a[i], a[j] = (cap[i] if step == cap[i] - a[i] else a[i] + step), (0.0 if step == a[j] else a[j] - step)
        g += step * (k[i] - k[j])
    return a


def tiles(n: int) -> list[tuple[int, int]]:
    """The first rows of both sides of each tile on or above the diagonal of a matrix of n rows."""
    return [(lo, at) for lo in range(0, n, TILE) for at in range(lo, n, TILE)]


def bent(v: np.ndarray, gamma: float) -> np.ndarray:
    """v with two more columns: the product of two rows, with these columns of one swapped, is -gamma times their squared distance."""
    return np.concatenate([v * np.sqrt(2 * gamma), -gamma * (v * v).sum(1)[:, None], np.ones((len(v), 1))], 1)


def kernel_tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernel values of few bent rows, worked out in place."""
    k = a @ np.concatenate([b[:, :-2], b[:, :-3:-1]], 1).T
    return np.exp(np.minimum(k, 0, out=k), out=k)


def product(rows: np.ndarray, p: np.ndarray, some: list[tuple[int, int]]) -> np.ndarray:
    """The part of the kernel matrix of bent rows times p that comes from some tiles and those opposite them."""
    out = np.zeros(len(rows))
    for lo, at in some:
        i, j = slice(lo, lo + TILE), slice(at, at + TILE)
        k = kernel_tile(rows[i], rows[j])
        out[i] += k @ p[j]
        if lo != at:
            out[j] += p[i] @ k
    return out


def bounded(u: np.ndarray, sign: np.ndarray, own: np.ndarray, g: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The step p with low <= p <= high and a sum of 0 that minimises p'Bp / 2 + g'p, B = u diag(sign) u' + diag(own).

    Given q = diag(sign) u'p each weight's step follows from its bounds and the sum; Newton's steps find the q that agrees.
    """

    def respond(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slope = g + u @ q
        least, most = float((slope + low * own).min()), float((slope + high * own).max())
        rho = (least + most) / 2
        for _ in range(200):  # Newton's steps for the sum, halves of the range where they leave it
            p = (rho - slope) / own
            free = (p > low) & (p < high)
            p = np.clip(p, low, high)
            over, rate = p.sum(), (1 / own[free]).sum()
            if abs(over) <= 1e-13 * np.abs(p).sum() or most - least <= 1e-15 * max(abs(least), abs(most)):
                break
            least, most = (least, rho) if over > 0 else (rho, most)
            rho = rho - over / rate if rate > 0 and least < rho - over / rate < most else (least + most) / 2
        return p, free, u.T @ p - sign * q

    q = np.zeros(len(sign))
    p, free, off = respond(q)
    for _ in range(30):
        size = np.linalg.norm(off)
        if size <= 1e-7 * np.linalg.norm(q):
            break
        w = u[free]
        sums, rate = w.T @ (1 / own[free]), (1 / own[free]).sum()
        w /= np.sqrt(own[free, None])
        move = np.linalg.lstsq(w.T @ w - np.outer(sums, sums) / max(rate, 1e-300) + np.diag(sign), off, rcond=None)[0]
        for part in (1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125):
            p, free, less = respond(q + part * move)
            if np.linalg.norm(less) < size:
                break
        q, off = q + part * move, less
    return p


class Held:
    """Weights and gradients on the driver. spark: where products with the kernel matrix of many rows are worked out."""

    def __init__(self, points: tuple[np.ndarray, np.ndarray], nu: float, gamma: float, spark: SparkSession | None = None):
        self.v, self.cap, self.gamma, self.bent = points[0], points[1].astype(np.float64), gamma, bent(points[0], gamma)
        self.spark, self.sent, self.model = spark, None, None
        self.steps, self.bends = np.zeros((len(self.v), 0)), np.zeros((len(self.v), 0))
        some = self.v[:: -(-len(self.v) // START) or 1]
        order = np.argsort(self._sums(some, np.ones(len(some))), kind="stable")
        before = np.cumsum(self.cap[order]) - self.cap[order]
        self.a = np.zeros(len(self.v))
        self.a[order] = np.clip(nu * self.cap.sum() - before, 0.0, self.cap[order])
        self.g = self._sums(self.v[self.a > 0], self.a[self.a > 0])

    def _sums(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        out, theirs = np.zeros(len(self.v)), bent(at, self.gamma)
        for lo in range(0, len(self.v), TILE):
            i = slice(lo, lo + TILE)
            for k in range(0, len(at), TILE):
                out[i] += kernel_tile(self.bent[i], theirs[k : k + TILE]) @ w[k : k + TILE]
        return out

    def worst(self, n: int) -> tuple[np.ndarray, ...]:
        up, down = np.where(self.a < self.cap, self.g, np.inf), np.where(self.a > 0, self.g, -np.inf)
        low, high = np.argsort(up, kind="stable")[:n], np.argsort(-down, kind="stable")[:n]
        rows = np.unique(np.concatenate([low[np.isfinite(up[low])], high[np.isfinite(down[high])]]))
        return rows, self.v[rows], self.cap[rows], self.a[rows], self.g[rows]

    def add(self, rows: np.ndarray, v: np.ndarray, a: np.ndarray, change: np.ndarray) -> None:
        self.a[rows] = a
        self.g += self._sums(v, change)

    def _times(self, p: np.ndarray) -> np.ndarray:
        """The kernel matrix times p."""
        if self.spark is None or len(p) < DEALT:
            return product(self.bent, p, tiles(len(p)))
        context = self.spark.sparkContext
        self.sent = self.sent or context.broadcast(self.bent)
        own, now, tasks = self.sent, context.broadcast(p), 4 * context.defaultParallelism

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for task in b.column(0).to_pylist():
                    part = product(own.value, now.value, tiles(len(now.value))[task::tasks])
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.list_(pa.float64()))], ["x"])

        out = np.zeros(len(p))
        for row in self.spark.range(0, tasks, 1, tasks).mapInArrow(run, "x array<double>").toArrow().column(0):  # tasks times HELD values at most
            out += row.values.to_numpy()
        now.destroy()
        return out

    def whole(self) -> bool:
        """Move all weights at once; whether that was possible.

        The model of the kernel matrix is its constant and linear part about the mean, the rest of its diagonal, and what
        past steps (whose products with the matrix, bends, are known) correct in it; the step is as long as the true matrix asks.
        """
        if self.model is None:
            z = (self.v - np.average(self.v, axis=0, weights=self.cap)) * np.sqrt(2 * self.gamma)
            half = (z * z).sum(1) / 2
            w = np.exp(-half)[:, None]
            self.model = np.concatenate([w, w * z], 1), np.maximum(1 - w[:, 0] ** 2 * (1 + 2 * half), 1e-3)
        (u, own), past = self.model, self.steps.shape[1]
        sign = np.repeat([1.0, -1.0], [u.shape[1] + past, past])
        if past:
            first = u @ (u.T @ self.steps) + own[:, None] * self.steps
            root = np.linalg.cholesky(self.steps.T @ first)
            u = np.concatenate([u, self.bends, first @ np.linalg.inv(root).T], 1)
        p = bounded(u, sign, own, self.g - self.g.mean(), -self.a, self.cap - self.a)
        if not self.g @ p < 0:  # rounding has spoilt the past steps
            self.steps, self.bends = self.steps[:, :0], self.bends[:, :0]
            return past > 0 and self.whole()
        bend = self._times(p)
        length = min(1.0, -(self.g @ p) / max(p @ bend, 1e-300))
        ends = [(p <= -self.a) & (length == 1), (p >= self.cap - self.a) & (length == 1)]
        self.a, self.g = np.select(ends, [0.0, self.cap], np.clip(self.a + length * p, 0.0, self.cap)), self.g + length * bend
        size = p @ bend
        for _ in range(2):
            along = self.bends.T @ p
            p, bend = p - self.steps @ along, bend - self.bends @ along
        if p @ bend > 1e-10 * size > 0:  # else it was a sum of past steps
            root = np.sqrt(p @ bend)
            self.steps, self.bends = (np.concatenate([past, new[:, None] / root], 1)[:, -PAST:] for past, new in ((self.steps, p), (self.bends, bend)))
        return True

    def support(self) -> tuple[np.ndarray, np.ndarray]:
        return self.v[self.a > 0], self.a[self.a > 0]

    def done(self) -> None:
        if self.sent is not None:
            self.sent.destroy()


class Spread:
    """Weights and gradients in a table (row, v, cap, a, g), written anew in every round."""

    def __init__(self, points: DataFrame, nu: float, gamma: float):
        self.gamma = gamma
        own = numbered(points.select("v", F.col("w").alias("cap")), "id")
        stretched = own.select("id", scaled("v", gamma).alias("v"))
        some = sample(stretched, START)
        apart = write_out(own.join(gaussian_sums(stretched, (some, np.ones(len(some))), 0.0, IGNORED), "id"), "margin-order")
        low, high, n = apart.agg(F.min("total"), F.max("total"), F.sum("cap")).first()
        place = F.least(F.floor((F.col("total") - low) * (RANGES / max(high - low, 1e-300))), F.lit(RANGES - 1)).cast("int")
        ranges = apart.groupBy(place.alias("place")).agg(F.sum("cap").alias("n")).toPandas().sort_values("place")  # RANGES rows at most
        before = ranges["n"].cumsum() - ranges["n"]
        edge = int((before < nu * n).sum()) - 1  # the range at the edge gets what is left, in proportion
        last, share = int(ranges["place"].iloc[edge]), float(min(1.0, (nu * n - before.iloc[edge]) / ranges["n"].iloc[edge]))
        begun = write_out(apart.select("id", "v", "cap", F.when(place < last, F.col("cap")).when(place == last, F.col("cap") * share).otherwise(0.0).alias("a")), "margin-start")
        sums = gaussian_sums(begun.select("id", scaled("v", gamma).alias("v")), begun.where("a > 0").select("id", scaled("v", gamma).alias("v"), F.col("a").alias("w")), 0.0, IGNORED)
        self.table = write_out(begun.join(sums, "id").select(F.col("id").alias("row"), "v", "cap", "a", F.col("total").alias("g")), "margin")
        discard(own, apart, begun)

    def worst(self, n: int) -> tuple[np.ndarray, ...]:
        both = self.table.where("a < cap").orderBy("g", "row").limit(n).unionByName(self.table.where("a > 0").orderBy(F.desc("g"), "row").limit(n))
        t = both.dropDuplicates(["row"]).toArrow().combine_chunks()  # two times n rows at most
        return t["row"].to_numpy(), matrix(t["v"].combine_chunks()), t["cap"].to_numpy(), t["a"].to_numpy(), t["g"].to_numpy()

    def add(self, rows: np.ndarray, v: np.ndarray, a: np.ndarray, change: np.ndarray) -> None:
        gamma, order = self.gamma, np.argsort(rows)
        sent = self.table.sparkSession.sparkContext.broadcast((rows[order], a[order], v, change))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, now, at, by = sent.value
            for b in batches:
                if b.num_rows:
                    row, old, g = b.column(0).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy()
                    place = np.minimum(np.searchsorted(own, row), len(own) - 1)
                    x = matrix(b.column(1))
                    more = np.concatenate([kernel(x[lo : lo + AT_ONCE], at, gamma) @ by for lo in range(0, len(x), AT_ONCE)])
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.where(own[place] == row, now[place], old)), pa.array(g + more)], b.schema.names)

        before, self.table = self.table, write_out(self.table.mapInArrow(run, "row bigint, v array<double>, cap double, a double, g double"), "margin")
        discard(before)

    def whole(self) -> bool:
        """Weights in a table move by working sets alone."""
        return False

    def support(self) -> DataFrame:
        return write_out(self.table.where("a > 0").select(F.col("row").alias("id"), "v", F.col("a").alias("w")), "support")

    def done(self) -> None:
        discard(self.table)


def scaled(v: str, gamma: float):
    """Vectors whose half squared distance is gamma times that of v."""
    return F.transform(v, lambda x: x * F.lit(float(np.sqrt(2 * gamma))))


def fit_kernel_margin(x: np.ndarray | DataFrame | Rows, nu: float, *, gamma: float | None = None, tolerance: float = 1e-9, rounds: int = ROUNDS, working: int | None = None) -> KernelMargin:
    """The margin at the optimum: no pair of rows violates the conditions by more than tolerance times nu * n.

    Up to HELD different rows the driver keeps weights and gradients; more stay in a written table, and the driver gets the
    rows of the working set alone. Nothing is drawn at random.
    """
    with as_rows(x) as rows:
        gamma = scale_gamma(rows) if gamma is None else gamma
        points, n = different(rows), rows.n
    if isinstance(points, DataFrame) and points.count() <= HELD:
        t = points.select("v", "w").toArrow()
        held = matrix(t["v"].combine_chunks()), t["w"].to_numpy()
        discard(points)
        points = held
    state = Spread(points, nu, gamma) if isinstance(points, DataFrame) else Held(points, nu, gamma, rows.spark)
    enough, gap, rho = tolerance * nu * n, np.inf, 0.0
    for k in range(rounds + 1):
        own, v, cap, a, g = state.worst(working or WORKING)
        low, high = g[a < cap].min(initial=np.inf), g[a > 0].max(initial=-np.inf)
        gap = max(0.0, high - low) if np.isfinite(low) else 0.0
        rho = (low + high) / 2 if np.isfinite(low) else high
        if gap <= enough or k == rounds:
            break
        if k >= ALONE and (k - ALONE) % (BETWEEN + 1) == 0 and state.whole():
            continue
        new = solve_part(kernel(v, v, gamma), a, cap, g, enough / 10)
        state.add(own, v, new, new - a)
    support = state.support()
    state.done()
    return KernelMargin(support, gamma, float(rho), nu, float(gap))


def kernel_margin_score(rows: DataFrame, model: KernelMargin) -> DataFrame:
    """(id, score): f of each row."""
    stretched = rows.select("id", scaled("v", model.gamma).alias("v"))
    if isinstance(model.support, DataFrame):
        points = model.support.select("id", scaled("v", model.gamma).alias("v"), "w")
    else:
        points = model.support[0] * np.sqrt(2 * model.gamma), model.support[1]
    return gaussian_sums(stretched, points, 0.0, IGNORED).select("id", (F.col("total") - model.rho).alias("score"))


def best_kernel_margin(x: DataFrame | Rows, nus: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2, 0.5)) -> KernelMargin:
    """The nu whose margin accepts most training rows, the first of equals; rows on the margin are accepted."""
    with as_rows(x) as rows:
        best, most = None, -1.0
        for nu in nus:
            model = fit_kernel_margin(rows, nu)
            edge = -max(1e-9, 1e-8 * nu * rows.n)
            frame = rows.frame if rows.frame is not None else None
            if frame is not None:
                accepted = kernel_margin_score(frame, model).agg(F.avg((F.col("score") >= edge).cast("double"))).first()[0]
            else:
                v, w = model.support
                accepted = np.mean(np.concatenate([kernel(rows.x[lo : lo + 1000], v, model.gamma) @ w - model.rho >= edge for lo in range(0, rows.n, 1000)]))
            if accepted > most:
                best, most = model, accepted
        return best
