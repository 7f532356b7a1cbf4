"""Neighbours, topology and detectors against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from typica.functions import vectors as V
from typica.operators import blocks, density, linear, neighbours
from typica.operators.topology import model_features, topology
from typica.plans.detector import DETECTORS, METHODS, Detector, TypicalityDetector, chosen

RNG = np.random.default_rng(0)
X = RNG.normal(size=(60, 6))
Y = np.vstack([RNG.normal(size=(38, 6)) + 0.4, X[:1], X[:1]])  # two rows that the bank has


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.fixture(scope="module")
def bank(spark):
    return frame(spark, X).cache()


@pytest.fixture(scope="module")
def rows(spark):
    return frame(spark, Y, 1000).cache()


def got(df, *columns):
    return np.array([[r[c] for c in columns] for r in sorted(df.collect(), key=lambda r: r["id"])])


def euclid(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


def pairwise(a, b, metric):
    if metric == "euclidean":
        return euclid(a, b)
    if metric == "manhattan":
        return np.abs(a[:, None] - b[None]).sum(-1)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return 1 - unit(a) @ unit(b).T if metric == "cosine" else -(a @ b.T)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine", "dot"])
@pytest.mark.parametrize("bank_rows", [50_000, 7])
def test_k_smallest(bank, rows, metric, bank_rows, monkeypatch):
    monkeypatch.setattr(blocks, "BANK_ROWS", bank_rows)
    near = neighbours.k_smallest(rows, bank, 4, metric, with_ids=True)
    d = pairwise(Y, X, metric)
    want = np.sort(d, axis=1)[:, :4]
    assert np.array([r.d for r in near.orderBy("id").collect()]) == pytest.approx(want, abs=1e-9)
    for r in near.collect():
        assert [d[r.id - 1000, i] for i in r.ids] == pytest.approx(r.d, abs=1e-9)


def test_k_beyond_the_bank_and_empty_bank(bank, rows):
    assert all(len(r.d) == 60 for r in neighbours.k_smallest(rows, bank, 100).collect())
    assert all(r.d == [] for r in neighbours.k_smallest(rows, bank.limit(0), 3).collect())
    assert neighbours.k_smallest(rows.limit(0), bank, 3).count() == 0


def brute_topology(q, r, k):
    rad_r, rad_q = (np.sort(euclid(m, m), axis=1)[:, min(k, len(m) - 1)] for m in (r, q))
    d = euclid(q, r)
    return np.stack([(d < rad_q[:, None]).mean(1), (d < rad_r[None]).sum(1) / k, (d < rad_r[None]).any(1), d.min(1) < rad_q], 1)


@pytest.mark.parametrize("bank_rows", [50_000, 9])
def test_topology(bank, rows, bank_rows, monkeypatch):
    monkeypatch.setattr(blocks, "BANK_ROWS", bank_rows)
    t = topology(rows, bank, 5)
    f = got(t, "recall", "density", "precision", "coverage")
    assert f == pytest.approx(brute_topology(Y, X, 5), abs=1e-12)
    assert set(f[:, 2]) <= {0, 1} and set(f[:, 3]) <= {0, 1} and ((f[:, 2] == 1) == (f[:, 1] > 0)).all()
    assert got(topology(rows.repartition(5), bank.repartition(3), 5), "density") == pytest.approx(f[:, 1:2])


def test_model_features_are_in_order_of_names(bank, rows):
    half = lambda d: d.select("id", F.slice("v", 1, 3).alias("v"))
    f = model_features({"b": half(rows), "a": rows}, {"b": half(bank), "a": bank}).orderBy("id").collect()
    assert np.array([r.f for r in f]) == pytest.approx(np.hstack([brute_topology(Y, X, 5), brute_topology(Y[:, :3], X[:, :3], 5)]))


def test_moments_and_distances(bank, rows):
    m = linear.moments(bank.repartition(4))
    assert m.mean == pytest.approx(X.mean(0)) and m.covariance() == pytest.approx(np.cov(X.T, bias=True)) and m.covariance(True) == pytest.approx(np.cov(X.T))
    p, g = np.linalg.pinv(np.cov(X.T, bias=True)), Y - X.mean(0)
    md = np.einsum("ij,jk,ik->i", g, p, g)
    assert got(linear.mahalanobis(rows, bank), "score")[:, 0] == pytest.approx(-md)
    c = X[:30]
    pc, gc = np.linalg.pinv(np.cov(c.T, bias=True)), Y - c.mean(0)
    assert got(linear.relative_mahalanobis(rows, bank.where("id < 30"), bank), "score")[:, 0] == pytest.approx(md - np.einsum("ij,jk,ik->i", gc, pc, gc))


def test_weighted_moments(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 50.0), (2, [3.0, 5.0], 1.0)], "id long, v array<double>, w double")
    x = np.array([[1.0, 2.0]] * 50 + [[3.0, 5.0]])
    m = linear.moments(df, "w")
    assert m.n == 51 and m.mean == pytest.approx(x.mean(0)) and m.covariance() == pytest.approx(np.cov(x.T, bias=True))


def test_virtual_logit(bank, rows):
    m = linear.Margin(np.arange(1.0, 7.0), 0.3)
    u = -m.w * m.b / (m.w @ m.w)
    values, vectors = np.linalg.eigh((X - u).T @ (X - u) / len(X))
    ns = vectors[:, np.argsort(-values)][:, 2:]
    r = lambda z: np.linalg.norm((z - u) @ ns, axis=1)
    alpha = (X @ m.w + m.b).mean() / r(X).mean()
    assert got(linear.virtual_logit(rows, bank, m, dim=2), "score")[:, 0] == pytest.approx(Y @ m.w + m.b - alpha * r(Y))
    with pytest.raises(ValueError):
        linear.virtual_logit(rows, bank, m, dim=6)


def test_logistic_margin_is_at_its_optimum(bank, rows):
    m = linear.logistic_margin(bank, rows, weight=2.0)
    p = lambda z: 1 / (1 + np.exp(-(z @ m.w + m.b)))
    grad_w = m.w + X.T @ (p(X) - 1) + 2 * Y.T @ p(Y)
    assert np.abs(grad_w).max() < 0.05 and abs((p(X) - 1).sum() + 2 * p(Y).sum()) < 0.05


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, -4.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    r = df.select(V.dot(a, b).alias("dot"), V.norm(a).alias("norm"), V.euclid(a, b).alias("eu"), V.manhattan(a, b).alias("ma"), V.eucos(a, b).alias("ec"), V.log_sum_exp(a).alias("lse"), V.energy(a, 2.0).alias("en"), V.log_2cosh(a[1]).alias("l2"), V.largest_places(F.array(*map(F.lit, (1.0, 3.0, 3.0))), 2).alias("top"), V.cosine_distance(a, z).alias("zero"), V.normalised(z).alias("n")).first()
    assert (r["dot"], r["norm"], r["ma"], r["top"], r["zero"], r["n"]) == (-1.0, 5.0, 7.0, [1, 2], None, [0.0, 0.0])
    cos = 1 + 1 / (5 * np.sqrt(2))
    assert (r["eu"], r["ec"], r["lse"], r["en"], r["l2"]) == pytest.approx((np.sqrt(29), 0.5 * np.sqrt(29) + cos, np.log(np.exp(3) + np.exp(-4)), -2 * np.log(np.exp(1.5) + np.exp(-2)), np.log(np.exp(4) + np.exp(-4))))


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_mixtures(spark, rows, kind):
    x = np.vstack([RNG.normal(size=(200, 2)), RNG.normal(size=(200, 2)) + 8])
    m = density.fit_mixture(x, 2, kind)
    assert sorted(np.round(m.means.mean(1))) == [0, 8] and m.weights == pytest.approx([0.5, 0.5], abs=0.02)
    direct = sum(w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(c), x - mu)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for w, mu, c in zip(m.weights, m.means, m.covariances, strict=True))
    assert m.log_density(x) == pytest.approx(np.log(direct))
    assert got(density.mixture_score(frame(spark, x[:20]), m), "score")[:, 0] == pytest.approx(m.log_density(x[:20]))
    assert len(density.best_mixture(x, kind=kind).weights) >= 2


def test_kernel_density(spark):
    x, q = RNG.normal(size=(80, 3)), RNG.normal(size=(10, 3))
    c = np.cov(x.T) * (80 ** (-1 / 7)) ** 2 + 1e-6 * np.eye(3)
    g = q[:, None] - x[None]
    k = np.exp(-0.5 * np.einsum("abi,ij,abj->ab", g, np.linalg.inv(c), g)) / np.sqrt(np.linalg.det(2 * np.pi * c))
    assert got(density.kernel_score(frame(spark, q), density.fit_kernel(x)), "score")[:, 0] == pytest.approx(np.log(k.mean(1) + 1e-10))


def test_one_class_and_reductions():
    x = RNG.normal(size=(200, 3)) + 5
    w, rho = density.best_one_class(x)
    assert ((x @ w - rho) > 0).mean() > 0.5
    assert density.reduction(x, "none", 3) == pytest.approx(np.eye(3)) and density.reduction(x, "pca", 2).shape == (3, 2)
    lda = density.reduction(np.vstack([x, x + [9, 0, 0]]), "lda", 2, np.repeat([0, 1], 200))
    assert abs(lda[0, 0]) > abs(lda[1:, 0]).max() and not lda[:, 1].any()
    with pytest.raises(ValueError):
        density.reduction(x, "tsne", 2)


@pytest.mark.parametrize("name", sorted(DETECTORS))
def test_every_detector(bank, rows, name):
    margin = {"margin": linear.Margin(-np.ones(6), 1.0)} if name in ("fdbd", "react", "nnguide", "adascale", "openmax", "vim") else {}
    d = Detector(name, **margin, **({"dim": 3} if name == "vim" else {"k": 2} if name in ("knn", "gmm") else {}))
    with pytest.raises(RuntimeError):
        d.postprocess(rows)
    s = d.setup(bank, rows).postprocess(rows).collect()
    assert len(s) == 40 and all(np.isfinite(r.score) for r in s)
    assert {r.pred for r in d.predict(rows).collect()} <= {1, -1}
    assert all(0 <= r.proba <= 1 for r in d.predict_proba(rows).collect())


@pytest.mark.parametrize("method", ["gmm", "kde", "ocsvm"])
def test_core_detector(spark, method):
    good, bad = RNG.normal(size=(160, 4)), RNG.normal(size=(30, 4)) + 6
    d = TypicalityDetector(method)
    with pytest.raises(RuntimeError):
        d.scores({"m": frame(spark, good)})
    d.fit({"m": frame(spark, good[:120])})
    r = d.evaluate({"m": frame(spark, good[120:], 5000)}, {"m": frame(spark, bad, 9000)}).first()
    assert r.auroc > 0.9 and 0 <= r.fpr95 <= 1
    assert {x.pred for x in d.predict({"m": frame(spark, good[120:], 5000)}).collect()} <= {1, -1}


def test_equal_features_are_scored_once_and_from_a_table(spark, monkeypatch):
    """Scores of equal features differed in their last digits by where a row stood; workers of both steps stood side by side."""
    seen = []

    def score(rows, _):
        seen.append((rows.count(), rows.select("v").distinct().count(), "MapInArrow" in rows._jdf.queryExecution().toString()))
        return rows.select("id", F.rand().alias("score"))

    monkeypatch.setitem(METHODS, "drawn", (lambda features: None, score))
    d = TypicalityDetector("drawn", half="id % 2 = 0").fit({"m": frame(spark, X.repeat(2, axis=0)), "n": frame(spark, X[:, :2].repeat(2, axis=0))})
    batch = {"m": frame(spark, Y, 1000), "n": frame(spark, Y[:, :2], 1000)}
    v = {r.id: tuple(r.f) for r in model_features(batch, d.reference, 5).collect()}
    scores = d.scores(batch).collect()
    of = {v[r.id]: r.score for r in scores}
    assert sorted(r.id for r in scores) == sorted(v) and len(of) < len(v) and all(of[v[r.id]] == r.score for r in scores)
    assert len(seen) == 2 and all(n == different and not pairs for n, different, pairs in seen)


def test_method_lists():
    assert chosen(" KNN, vim,core_gmm ") == ["knn", "vim", "core_gmm"]
    with pytest.raises(ValueError):
        chosen("knn,magic")
    with pytest.raises(ValueError):
        TypicalityDetector("magic")
