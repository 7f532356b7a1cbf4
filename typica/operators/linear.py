"""Detectors from linear statistics and a binary margin. Scores are higher for in-distribution rows.

Fits collect sufficient statistics only: counts, sums and second moments of at most the vector length squared, added up by
Spark. Rows are (id, v) with v array<double>.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typica.functions import vectors as V
from typica.operators.blocks import matrix, scan
from typica.operators.passes import Rows
from typica.operators.neighbours import k_smallest
from typica.operators.order import percentiles, places
from typica.plans import metrics


@dataclass
class Moments:
    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def covariance(self, unbiased: bool = False, ridge: float = 0.0) -> np.ndarray:
        return self.scatter / (self.n - 1 if unbiased else self.n) + ridge * np.eye(len(self.mean))

    def about(self, centre: np.ndarray) -> np.ndarray:
        """Second moments about another centre, per row."""
        gap = self.mean - centre
        return self.scatter / self.n + np.outer(gap, gap)


def moments(rows: DataFrame, weight: str | None = None) -> Moments:
    """One pass: each task adds up its rows about its own first row, Spark adds the tasks' sums entry by entry."""
    cols = rows.select("v", *([F.col(weight).cast("double")] if weight else []))
    anchor = rows.select("v").first()
    if anchor is None:
        raise ValueError("no rows to fit")
    origin = np.array(anchor[0], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(origin)
        out = np.zeros(1 + d + d * d)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0)) - origin
                w = b.column(1).to_numpy(zero_copy_only=False) if weight else np.ones(len(x))
                out += np.concatenate(([w.sum()], w @ x, ((x * w[:, None]).T @ x).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], ["at", "x"])

    sums = cols.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros(sums.num_rows)
    flat[sums.column("at").to_numpy()] = sums.column("x").to_numpy()
    d, n = len(origin), flat[0]
    mean = flat[1 : d + 1] / n
    return Moments(n, mean + origin, flat[d + 1 :].reshape(d, d) - n * np.outer(mean, mean))


def quadratic(rows: DataFrame, terms: list[tuple[float, np.ndarray, np.ndarray]]) -> DataFrame:
    """(id, score): the sum of factor * (v - centre)' P (v - centre) over terms (factor, centre, P)."""

    def work(block, _, v, __):
        return {"score": sum(f * np.einsum("ij,jk,ik->i", v - c, p, v - c) for f, c, p in block)}

    return scan(rows, terms, work, [("score", "double")])


def mahalanobis(rows: DataFrame, fit: DataFrame) -> DataFrame:
    m = moments(fit)
    return quadratic(rows, [(-1.0, m.mean, np.linalg.pinv(m.covariance()))])


def relative_mahalanobis(rows: DataFrame, fit: DataFrame, background: DataFrame, *, unbiased: bool = False, ridge: float = 0.0) -> DataFrame:
    """Minus the distance to the class plus the distance to the background."""
    a, b = moments(fit), moments(background)
    return quadratic(rows, [(-1.0, a.mean, np.linalg.pinv(a.covariance(unbiased, ridge))), (1.0, b.mean, np.linalg.pinv(b.covariance(unbiased, ridge)))])


def relative_mahalanobis_pairs(rows: DataFrame, fit: DataFrame, background: DataFrame, method: str = "rmd_combined") -> DataFrame:
    """For rows of two vectors (id, v_in, v_out): rmd_input, rmd_output, the mean of both (rmd_combined), or the logistic
    margin of fit against background on one side (binary_input, binary_output)."""

    def side(c: str) -> DataFrame:
        pick = lambda d: d.select("id", F.col(c).alias("v"))
        if method.startswith("binary_"):
            return margin_score(pick(rows), logistic_margin(pick(fit), pick(background)))
        return relative_mahalanobis(pick(rows), pick(fit), pick(background), unbiased=True, ridge=1e-6)

    if method not in ("rmd_input", "rmd_output", "rmd_combined", "binary_input", "binary_output"):
        raise ValueError(f"method {method!r}")
    if method != "rmd_combined":
        return side("v_in" if method.endswith("_input") else "v_out")
    both = side("v_in").join(side("v_out").withColumnRenamed("score", "other"), "id")
    return both.select("id", ((F.col("score") + F.col("other")) / 2).alias("score"))


# ---- a binary margin l = v . w + b, positive for in-distribution rows


@dataclass
class Margin:
    w: np.ndarray
    b: float

    def of(self, v: Column) -> Column:
        return V.dot(v, V.constant(self.w)) + F.lit(self.b)


def mean_margin(fit: DataFrame, background: DataFrame) -> Margin:
    """The margin halfway between the two means, in their direction."""
    a, b = moments(fit).mean, moments(background).mean
    return Margin(a - b, float(-((a - b) * (a + b) / 2).sum()))


def logistic_margin(fit: DataFrame, background: DataFrame, *, weight: float = 1.0, c: float = 1.0, rounds: int = 50) -> Margin:
    """L2-regularised logistic regression, intercept free, at its optimum; background rows weigh weight (repeated corpora).

    Newton's method over sums: every pass over the rows adds up the gradient, the curvature (vector length squared) and the
    loss, so the fit does not depend on how the rows are dealt out.
    """
    sides = [(Rows(fit), 1.0, 1.0), (Rows(background), 0.0, float(weight))]
    d = sides[0][0].d
    p, last, step = np.zeros(d + 1), np.inf, np.zeros(d + 1)

    def sums(y: float, wt: float, at: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        def work(x: np.ndarray) -> np.ndarray:
            v = np.hstack([x, np.ones((len(x), 1))])
            z = v @ at
            q = 1 / (1 + np.exp(-z))
            loss = np.logaddexp(0.0, -z if y else z).sum()
            return wt * np.concatenate(([loss], v.T @ (q - y), ((v * (q * (1 - q))[:, None]).T @ v).ravel()))

        return work

    for _ in range(rounds):
        s = sum(rows.sums(sums(y, wt, p)) for rows, y, wt in sides)
        loss = s[0] + p[:-1] @ p[:-1] / (2 * c)
        if loss > last + 1e-12 * abs(last):  # too far: half of the way back
            step /= 2
            p = p - step
            if np.abs(step).max() < 1e-14:
                break
            continue
        last = loss
        grad = s[1 : d + 2] + np.append(p[:-1], 0.0) / c
        curve = s[d + 2 :].reshape(d + 1, d + 1) + np.diag(np.append(np.full(d, 1 / c), 1e-12))
        if np.abs(grad).max() < 1e-10 * max(1.0, sides[0][0].n):
            break
        step = -np.linalg.solve(curve, grad)
        p = p + step
    for rows, _, _ in sides:
        rows.done()
    return Margin(p[:-1], float(p[-1]))


def margin_score(rows: DataFrame, m: Margin) -> DataFrame:
    return rows.select("id", m.of(F.col("v")).alias("score"))


def energy(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    return rows.select("id", V.energy(F.col("v"), temperature).alias("score"))


def boundary_distance(rows: DataFrame, fit: DataFrame, m: Margin, *, by_mean: bool = True) -> DataFrame:
    """Minus the distance to the decision boundary over the distance to the fitted mean (or the vector's length)."""
    v = F.col("v")
    far = V.euclid(v, V.constant(moments(fit).mean)) if by_mean else V.norm(v)
    return rows.select("id", (-(F.abs(m.of(v)) / F.lit(float(np.linalg.norm(m.w)))) / F.greatest(far, F.lit(1e-8))).alias("score"))


def every_other(rows: DataFrame) -> DataFrame:
    """Rows at even places (from 0) in order of id."""
    return places(rows, "id").where("place % 2 = 1").drop("place")


def rectified(rows: DataFrame, fit: DataFrame, m: Margin, percent: float = 90.0) -> DataFrame:
    """Activations cut at a percentile of all those of every other fitted row, then log(2 cosh l)."""
    t = percentiles(every_other(fit).select(F.explode("v").alias("x")), [percent / 100], "x")[0]
    return rows.select("id", V.log_2cosh(m.of(V.clipped(F.col("v"), float(t)))).alias("score"))


def guided_neighbours(rows: DataFrame, fit: DataFrame, m: Margin, *, share: float = 1.0, k: int = 100, use_min: bool = False) -> DataFrame:
    """Top-k similarity to the first share of the bank, both guided by the margin."""
    first = fit if share == 1 else places(fit, "id").where(F.col("place") <= int(fit.count() * share)).drop("place")
    unit = lambda d: d.select("id", V.normalised(F.col("v")).alias("u"), V.log_2cosh(m.of(F.col("v"))).alias("g"))
    bank = unit(first).select("id", F.transform("u", lambda x: x * F.col("g")).alias("v"))
    mine = unit(rows)
    near = k_smallest(mine.select("id", F.col("u").alias("v")), bank, k, "dot")
    sim = -(F.element_at("d", -1)) if use_min else -(F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d"))
    return near.join(mine.select("id", "g"), "id").select("id", (sim * F.col("g")).alias("score"))


def adaptive_scale(rows: DataFrame, fit: DataFrame, m: Margin, *, percent: tuple[float, float] = (90.0, 99.0), k1: float = 10.0, k2: float = 5.0, weight: float = 10.0, share: float = 0.05) -> DataFrame:
    """The margin scaled by how a row's top activations move under a small push.

    The loss gradient is -sigmoid(-l) w for rows with l > 0 and zero for others, so the pushed dimensions are those of the
    smallest weights and the same for all rows that are pushed.
    """
    d = len(m.w)
    push = np.zeros(d)
    least = np.argsort(np.abs(m.w), kind="stable")[: int(d * share)]
    push[least] = -0.1 * np.sign(m.w[least])
    n1, n2 = int(d * k1 / 100), int(d * k2 / 100)

    def moved(r: DataFrame) -> DataFrame:
        v = F.col("v")
        r = r.select("id", "v", m.of(v).alias("l"))
        pushed = F.when(F.col("l") > 0, F.zip_with(v, V.constant(push), lambda x, p: x + p)).otherwise(v)
        r = r.withColumn("p", pushed).withColumn("top", V.largest_places(v, max(n1, n2)))
        at = lambda c, n, f: V.total(F.transform(F.slice("top", 1, n), lambda i: f(c, i)))
        relu = at(F.col("p"), n1, lambda c, i: F.greatest(F.get(c, i), F.lit(0.0))) if n1 else F.lit(0.0)
        shift = at(F.col("p"), n2, lambda c, i: F.abs(F.get(c, i) - F.get(v, i))) if n2 else F.lit(0.0)
        return r.select("id", "l", (relu + weight * shift).alias("q"))

    train, own = moved(fit).select("q"), moved(rows)
    both = train.select(F.col("q").alias("score"), F.lit(1).alias("is_id")).unionByName(own.select(F.col("q").alias("score"), F.lit(0).alias("is_id")))
    above = metrics.curve(both).select(F.col("score").alias("q"), (1 - F.try_divide("tp0", "P")).alias("ecdf"))  # share of training values up to q
    found = own.select("id", "q").join(above, "q").select("id", "ecdf")
    p = percent[0] + (1 - F.col("ecdf")) * (percent[1] - percent[0])
    return own.join(found, "id").select("id", V.log_2cosh(F.col("l") * (p / 100.0)).alias("score"))


def weibull(tail: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """(shape, scale) of greatest likelihood for positive values; equal values have an endless shape and are its scale."""
    x = np.maximum(np.asarray(tail, np.float64), 1e-12)
    if not len(x) or x.max() - x.min() < 1e-12 * x.max():
        return np.inf, float(x.max(initial=0.0))
    log, top = np.log(x), np.log(x.max())
    lo, hi = 1e-3, 1e6

    def slope(k: float) -> float:
        e = np.exp(k * (log - top))
        return float((e * log).sum() / e.sum() - 1 / k - log.mean())

    for _ in range(rounds):  # slope rises with the shape
        mid = np.sqrt(lo * hi)
        lo, hi = (mid, hi) if slope(mid) < 0 else (lo, mid)
    k = float(np.sqrt(lo * hi))
    return k, float(np.exp(top + np.log(np.exp(k * (log - top)).mean()) / k))


DISTANCES: dict[str, Callable[[Column, Column, float], Column]] = {
    "euclidean": lambda a, b, w: V.euclid(a, b),
    "cosine": lambda a, b, w: V.cosine_distance(a, b),
    "eucos": lambda a, b, w: V.eucos(a, b, w),
}


def open_max(rows: DataFrame, fit: DataFrame, background: DataFrame, m: Margin, *, tail: int = 20, distance: str = "euclidean", eu_weight: float = 0.5, tail_fit: str = "mean") -> DataFrame:
    """The larger known-class probability after the tails of each class' distances take their share.

    Two classes: background (0) and in-distribution (1); a class's mean activation is over its correctly classified rows.
    distance: euclidean, cosine or eucos (their weighted sum). tail_fit: of the tail largest distances a class takes the mean
    as the scale of an exponential law (mean), or a Weibull law of greatest likelihood (weibull). A class without such rows
    has the mean (0.9, 0.1) towards itself.
    """
    if distance not in DISTANCES or tail_fit not in ("mean", "weibull"):
        raise ValueError(f"distance {distance!r}, tail {tail_fit!r}")
    prob = lambda d: d.select((1 / (1 + F.exp(-m.of(F.col("v"))))).alias("p"))
    sides = [prob(background).where("p <= 0.5"), prob(fit).where("p > 0.5")]
    far = lambda p, mean: DISTANCES[distance](F.array(1 - p, p), V.constant(mean), eu_weight)
    models = []
    for k, rows_k in enumerate(sides):
        n, mean_p = rows_k.agg(F.count(F.lit(1)), F.avg("p")).first()
        mean = [0.9 - 0.8 * k, 0.1 + 0.8 * k] if not n else [1 - mean_p, mean_p]
        top = np.array([r["d"] for r in rows_k.select(far(F.col("p"), mean).alias("d")).orderBy(F.desc("d")).limit(tail).collect()])  # tail rows
        models.append((mean, weibull(top) if tail_fit == "weibull" else (1.0, float(top.mean()) if len(top) else 0.0)))
    own = rows.select("id", (1 / (1 + F.exp(-m.of(F.col("v"))))).alias("p"))
    p = [1 - F.col("p"), F.col("p")]
    first = [F.col("p") < 0.5, F.col("p") >= 0.5]
    cut = []
    for k, (mean, (shape, scale)) in enumerate(models):
        d = far(F.col("p"), mean)
        beyond = (d >= scale).cast("double") if shape == np.inf else 1 - F.exp(-F.pow(F.greatest(d, F.lit(0.0)) / scale, F.lit(shape))) if scale > 0 else F.lit(0.0)
        w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), beyond))
        cut.append(p[k] * (1 - w * F.when(first[k], 1.0).otherwise(0.5)))
    e = [F.exp(c) for c in cut]
    unknown = F.exp((p[0] - cut[0]) + (p[1] - cut[1]))
    return own.select("id", (F.greatest(*e) / (e[0] + e[1] + unknown)).alias("score"))


def virtual_logit(rows: DataFrame, fit: DataFrame, m: Margin, *, dim: int) -> DataFrame:
    """The margin less the scaled residual outside the first dim principal directions about u = -pinv(w) b."""
    if not 0 < dim < len(m.w):
        raise ValueError(f"dim must be between 1 and {len(m.w) - 1}")
    u = -m.w * m.b / float(m.w @ m.w)
    fitted = moments(fit)
    _, vectors = np.linalg.eigh(fitted.about(u))
    null = np.ascontiguousarray(vectors[:, ::-1][:, dim:])

    def work(block, _, v, __):
        w, b, c, ns = block
        return {"l": v @ w + b, "r": np.linalg.norm((v - c) @ ns, axis=1)}

    out = [("l", "double"), ("r", "double")]
    mean_l, mean_r = scan(fit.select("id", "v"), (m.w, m.b, u, null), work, out).agg(F.avg("l"), F.avg("r")).first()
    alpha = mean_l / mean_r
    return scan(rows.select("id", "v"), (m.w, m.b, u, null), work, out).select("id", (F.col("l") - alpha * F.col("r")).alias("score"))
