"""The ways for tables beyond one block give what the small ones give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from typica.functions import text as T
from typica.functions import vectors as V
from typica.operators import blocks, density, linear, neighbours, order, passes
from typica.operators.topology import topology
from typica.plans import detector, metrics
from typica.sources import cache, corpora
from typica.streaming import guard

RNG = np.random.default_rng(3)


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], "id long, v array<double>")


def test_repeated_ids_keep_their_rows(spark, monkeypatch):
    """Two queries of one id are two rows, whatever the size of a block."""
    q, b = RNG.normal(size=(6, 3)), RNG.normal(size=(20, 3))
    queries, bank = frame(spark, q, [1, 1, 2, 3, 3, 3]), frame(spark, b)
    want = sorted(np.sort(np.sqrt(((q[:, None] - b[None]) ** 2).sum(-1)), axis=1)[:, :3].round(9).tolist())
    t = []
    for size in (50_000, 4):
        monkeypatch.setattr(blocks, "BANK_ROWS", size)
        got = neighbours.k_smallest(queries, bank, 3).collect()
        assert sorted(np.round(r.d, 9).tolist() for r in got) == want and sorted(r.id for r in got) == [1, 1, 2, 3, 3, 3]
        t.append(sorted(tuple(r) for r in topology(queries, bank, 2).collect()))
    assert t[0] == t[1] and len(t[0]) == 6


@pytest.fixture(params=[50_000, 10])
def held(request, monkeypatch):
    monkeypatch.setattr(passes, "HELD_ROWS", request.param)
    monkeypatch.setattr(blocks, "BANK_ROWS", request.param * 4)
    return request.param


def test_fits_on_the_driver_and_on_the_executors(spark, held):
    x = np.abs(RNG.normal(size=(120, 3))) + np.repeat([[0.0], [6.0]], 60, axis=0)
    rows = frame(spark, x)
    r = passes.Rows(rows)
    assert (r.frame is None) == (held > 100) and r.n == 120
    mean, cov = r.moments()
    assert mean == pytest.approx(x.mean(0)) and cov == pytest.approx(np.cov(x.T))
    r.done()
    assert density.reduction(rows, "pca", 2) == pytest.approx(density.reduction(x, "pca", 2))
    margin, other = linear.logistic_margin(frame(spark, x[:60]), frame(spark, x[60:])), linear.logistic_margin(frame(spark, x[:60]).repartition(5), frame(spark, x[60:]))
    assert margin.w == pytest.approx(other.w, abs=1e-8)
    scores = sorted(x.score for x in density.kernel_score(rows, density.fit_kernel(rows)).collect())
    own = np.cov(x.T) * (120 ** (-1 / 7)) ** 2 + 1e-6 * np.eye(3)
    g = x[:, None] - x[None]
    k = np.exp(-0.5 * np.einsum("abi,ij,abj->ab", g, np.linalg.inv(own), g)) / np.sqrt(np.linalg.det(2 * np.pi * own))
    assert scores == pytest.approx(np.sort(np.log(k.mean(1) + 1e-10)))


def test_mixture_of_many_rows(spark, monkeypatch):
    x = np.vstack([RNG.normal(size=(60, 2)), RNG.normal(size=(60, 2)) + 9])
    near = density.fit_mixture(x, 2)
    monkeypatch.setattr(passes, "HELD_ROWS", 10)
    far = density.fit_mixture(frame(spark, x), 2, rounds=20)
    assert np.sort(far.means[:, 0]) == pytest.approx(np.sort(near.means[:, 0]), abs=1e-2) and np.sort(far.weights) == pytest.approx([0.5, 0.5], abs=1e-2)


def loss(w, rho, x, nu):
    return 0.5 * w @ w - rho + np.maximum(0, rho - x @ w).mean() / nu


@pytest.mark.parametrize("nu", [0.05, 0.2, 0.5])
def test_one_class_margin_is_at_its_optimum(nu):
    """No step in any direction from it lowers the loss by more than the ranges of its low end allow."""
    x = np.abs(RNG.normal(size=(300, 4))) + RNG.random((300, 4))
    w, rho = density.fit_one_class(x, nu)
    best = loss(w, rho, x, nu)
    for _ in range(400):
        step = RNG.normal(size=5) * 10.0 ** RNG.uniform(-4, 0)
        assert loss(w + step[:4], rho + step[4], x, nu) >= best - 2e-3
    again, _ = density.fit_one_class(x[RNG.permutation(300)], nu)
    assert np.corrcoef(np.argsort(np.argsort(x @ w)), np.argsort(np.argsort(x @ again)))[0, 1] > 0.999


def test_weibull_tails():
    shape, scale = linear.weibull(RNG.weibull(2.5, 20_000) * 3)
    assert shape == pytest.approx(2.5, rel=0.05) and scale == pytest.approx(3, rel=0.05)
    assert linear.weibull(np.array([0.5, 0.5])) == (np.inf, 0.5)


@pytest.mark.parametrize("distance", ["euclidean", "cosine", "eucos"])
def test_open_max_by_hand(spark, distance):
    x, y = RNG.normal(size=(40, 3)) + 1, RNG.normal(size=(30, 3)) - 1
    m = linear.Margin(np.array([1.0, 0.5, 0.2]), 0.1)
    p = lambda z: 1 / (1 + np.exp(-(z @ m.w + m.b)))

    def far(q, mean):
        a, b = np.stack([1 - q, q], -1), np.array(mean)
        eu, cos = np.linalg.norm(a - b, axis=-1), 1 - (a @ b) / np.linalg.norm(a, axis=-1) / np.linalg.norm(b)
        return {"euclidean": eu, "cosine": cos, "eucos": 0.5 * eu + cos}[distance]

    models = []
    for own in (p(y)[p(y) <= 0.5], p(x)[p(x) > 0.5]):
        mean = [1 - own.mean(), own.mean()]
        models.append((mean, linear.weibull(np.sort(far(own, mean))[::-1][:10])))
    q = p(np.vstack([x, y]))
    cut = []
    for k, (mean, (shape, scale)) in enumerate(models):
        w = 1 - np.exp(-((far(q, mean) / scale) ** shape))
        cut.append((q if k else 1 - q) * (1 - w * np.where((q >= 0.5) == bool(k), 1.0, 0.5)))
    want = np.maximum(np.exp(cut[0]), np.exp(cut[1])) / (np.exp(cut[0]) + np.exp(cut[1]) + np.exp(1 - cut[0] - cut[1]))
    got = linear.open_max(frame(spark, np.vstack([x, y])), frame(spark, x), frame(spark, y), m, tail=10, distance=distance, tail_fit="weibull")
    assert [r.score for r in got.orderBy("id").collect()] == pytest.approx(want, abs=1e-9)


def test_percentiles_and_places_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(order, "RANGE_ROWS", 40)
    x = np.concatenate((RNG.normal(size=300), np.full(200, 0.5), [7.0] * 3))
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "score double").repartition(3)
    shares = [0.0, 0.05, 0.31, 0.5, 0.77, 0.999, 1.0]
    assert order.percentiles(rows, shares) == pytest.approx(np.quantile(x, shares))
    assert order.percentiles(rows.limit(0), [0.5]) == [None]
    flat = spark.createDataFrame([(1.0,)] * 300 + [(2.0 + i,) for i in range(4)], "score double")
    assert order.percentiles(flat, [0.5, 0.999]) == pytest.approx(np.quantile([1.0] * 300 + [2.0, 3, 4, 5], [0.5, 0.999]))
    placed = order.places(spark.createDataFrame([((i * 37) % 501, i) for i in range(501)] + [(None, -1)], "k long, x long"), "k")
    assert [r.place for r in placed.orderBy(F.col("k").asc_nulls_first()).collect()] == list(range(1, 503))
    monkeypatch.setattr(order, "RANGE_ROWS", 3)
    many = order.places(spark.createDataFrame([((i * 37) % 501,) for i in range(501)], "k long"), "k", ranges=120)
    assert [r.place for r in many.orderBy("k").collect()] == list(range(1, 502))


def test_curves_of_groups_in_ranges(spark, monkeypatch):
    rows = spark.createDataFrame([(g, float(RNG.integers(0, 40)), int(RNG.integers(0, 2))) for g in ("a", "b", None) for _ in range(150)], "g string, score double, is_id int").cache()
    rows.count()
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    one = {r.g: tuple(r) for r in metrics.by_group(rows, ["g"]).collect()}
    monkeypatch.setattr(order, "RANGE_ROWS", 10)
    cut = {r.g: tuple(r) for r in metrics.by_group(rows, ["g"]).collect()}
    assert set(one) == set(cut) and all(one[g][1:] == pytest.approx(cut[g][1:]) for g in one)
    alone = metrics.all_metrics(rows.where("g = 'a'")).first()
    assert (alone.auroc, alone.auprc, alone.f1) == pytest.approx(one["a"][1:])
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached


def test_texts_features_and_names(spark):
    df = spark.createDataFrame([("one  two\tthree four", [3.0, 4.0])], "t string, v array<double>")
    t, v = F.col("t"), F.col("v")
    r = df.select(T.cut(t, 5).alias("cut"), T.cut(t, 50).alias("whole"), T.fitted(t, 1701, margin=200).alias("fit"), T.first_tokens(t, 2).alias("two"), V.feature(v, "norm").alias("n"), V.feature(v, "normalized").alias("u"), V.feature(v, "raw").alias("raw")).first()
    assert (r.cut, r.whole, r.fit, r.two) == ("one  ...", "one  two\tthree four", "one ...", "one  two")
    assert (r.n, r.u, r.raw) == ([5.0], [0.6, 0.8], [3.0, 4.0])
    assert corpora.routed(" PolyGuard_Finance_Input ") == ("polyguard", "finance_input") and corpora.routed("polyguard") == ("polyguard", "social_media")
    assert corpora.routed("polyguard_code_x") == ("polyguard", "code") and corpora.routed("RTP_LX_de") == ("rtp_lx", "de") and corpora.routed("xsafety") == ("xsafety", None)
    with pytest.raises(ValueError):
        corpora.routed("nothing")


def test_retries_and_score_table(spark, tmp_path):
    waits, tries = [], []

    def call(rows):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return rows

    assert cache.retried(call, 3, 0.5, waits.append)("rows") == "rows" and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        cache.retried(lambda r: (_ for _ in ()).throw(OSError()), 1, 0.1, waits.append)(1)
    path, asked = str(tmp_path / "scores"), []
    spark.createDataFrame([], cache.SCORES).write.parquet(path)

    def score(rows):
        asked.append(sorted(r.text for r in rows.collect()))
        return rows.select("key", F.length("text").alias("score"))

    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a")], "id long, text string")
    for _ in range(2):
        assert {(r.id, r.score) for r in cache.scored(texts, "m", score, path).collect()} == {(1, 1.0), (2, 2.0), (3, 1.0)}
    assert asked == [["a", "bb"], []]


def test_own_detector(spark):
    detector.register(" Length ", lambda r, f, b, **o: r.select("id", F.size("v").cast("double").alias("score")))
    rows = frame(spark, np.ones((3, 4)))
    assert {r.score for r in detector.Detector("length").setup(rows, rows).postprocess(rows).collect()} == {4.0}
    detector.DETECTORS.pop("length")


def words(n):
    return " ".join(["w"] * n)


def test_guard_fails_open_and_tries_again(spark):
    came = spark.createDataFrame([(i, words(25), None, i) for i in range(12)], "req_id long, text string, finish_reason string, seq long")

    def broken(rows):
        raise OSError("no model")

    new, actions = guard.step(spark.createDataFrame([], guard.STATE), came, broken)
    assert {(r.pred, r.action, r.error) for r in actions.collect()} == {(None, "go", "OSError: no model")} and actions.count() == 12
    assert {r.last_predicted_at for r in new.collect()} == {0}


def test_guard_scores_a_batch_once_and_fills_from_history(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    kind = "req_id long, text string, finish_reason string, seq long"
    calls = spark.sparkContext.accumulator(0)

    def score(rows):
        return rows.select("req_id", F.lit(1).alias("pred")).mapInArrow(lambda bs: (calls.add(b.num_rows) or b for b in bs), "req_id bigint, pred int")

    q = guard.run(spark.readStream.schema(kind).parquet(str(source)), score, str(tmp_path / "out"), least=3, history=2)
    for n, rows in enumerate(([(i, words(25), "stop", i) for i in range(4)], [(9, words(30), None, 9)], [(9, words(60), None, 10)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source))
        q.processAllAvailable()
    q.stop()
    actions = spark.read.parquet(str(tmp_path / "out" / "actions")).collect()
    assert sorted((r.batch, r.req_id) for r in actions) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (1, 9), (2, 2), (2, 3), (2, 9)]
    assert calls.value == 10
    assert {p.name for p in (tmp_path / "out" / "state").iterdir()} == {"1", "2"}


@pytest.mark.parametrize("name", ["knn", "cider"])
def test_all_pairs_are_compared_once_for_decisions(spark, monkeypatch, name):
    """The median and the rows that it decides about read the same scores; the pairs were compared three times."""
    n = spark.sparkContext.accumulator(0)
    real = detector.DETECTORS[name]

    def counted(r, f, b, **o):
        def run(batches):
            for x in batches:
                n.add(x.num_rows)
                yield x

        return real(r, f, b, **o).mapInArrow(run, "id long, score double")

    monkeypatch.setitem(detector.DETECTORS, name, counted)
    q, b = RNG.normal(size=(30, 3)), RNG.normal(size=(40, 3))
    d = detector.Detector(name, k=2).setup(frame(spark, b), frame(spark, b))
    got = d.predict(frame(spark, q)).collect()
    assert len(got) == 30 and sum(r.pred == 1 for r in got) == 15 and n.value == 30
