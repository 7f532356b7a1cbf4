"""The metric index: same results as all pairs, fewer pairs; kernels and margins over tables as over matrices."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from typica.operators import blocks, cells, density, kernel_margin, neighbours, passes, screen, topology
from typica.operators.passes import Rows

RNG = np.random.default_rng(12)
MIDS = 8 * RNG.normal(size=(10, 6))


def clustered(n, spread=0.3):
    x = MIDS[np.arange(n) % 10] + spread * RNG.normal(size=(n, 6))
    x[5], x[15] = x[25], x[25]
    return x


X, Y = clustered(600), clustered(240)


def frame(spark, x, more=None, parts=4):
    rows = [(int(i), list(map(float, v)), *(() if more is None else (float(more[i]),))) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, v array<double>" + ("" if more is None else ", radius double")).repartition(parts)


@pytest.fixture
def seen(monkeypatch):
    """Small blocks; what was decided about pairs of cells, and how many rows of the bank were sent."""
    monkeypatch.setattr(blocks, "BANK_ROWS", 50)
    found, decide, send = {"pairs": [], "sent": []}, cells.decided, cells._sent

    def decided(*args):
        found["pairs"].append(decide(*args))
        return found["pairs"][-1]

    def sent(*args):
        out = send(*args).persist()
        found["sent"].append(out.select(F.col("task")).count())
        return out

    monkeypatch.setattr(cells, "decided", decided)
    monkeypatch.setattr(cells, "_sent", sent)
    return found


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine", "dot"])
def test_neighbours_by_cells(spark, seen, metric):
    got = neighbours.k_smallest(frame(spark, Y), frame(spark, X), 4, metric, with_ids=True)
    d = blocks.distances(Y, X, metric)
    for r in got.collect():
        order = np.lexsort((np.arange(600), d[r.id]))[:4]
        assert r.d == pytest.approx(d[r.id][order], abs=1e-9) and sorted(r.ids) == pytest.approx(sorted(order))
    pairs = seen["pairs"][0]
    if metric != "dot":
        assert pairs.skipped > 0.5 * pairs.compare.shape[1] * 20
        assert seen["sent"][0] < 0.5 * len(X) * len(pairs.compare)  # all pairs would send the bank to every block


def test_range_counts_by_cells(spark, seen):
    near = RNG.random(240)
    radius_q, radius_b = np.where(np.arange(240) < 120, 0.5 + near, 60.0), np.where(np.arange(600) % 50 == 0, 5.0, 0.4)
    got = topology.range_counts(frame(spark, Y, radius_q), frame(spark, X, radius_b), 600).collect()
    d = blocks.distances(Y, X, "euclidean")
    for r in got:
        assert (r.in_query, r.in_ref) == ((d[r.id] < radius_q[r.id]).sum(), (d[r.id] < radius_b).sum())
    assert len(got) == 240 and seen["pairs"][0].skipped > 0


def test_cells_within_all_balls_are_counted_as_a_whole(spark, seen):
    radius = np.full(600, 100.0)
    got = topology.range_counts(frame(spark, Y, radius[:240]), frame(spark, X, radius), 600).collect()
    assert {(r.in_query, r.in_ref) for r in got} == {(600, 600)} and len(got) == 240
    assert not seen["pairs"][0].compare.any() and seen["sent"] == [0]


def test_topology_by_cells(spark, seen):
    few = topology.topology(frame(spark, Y), frame(spark, X), 3).collect()
    d, own, theirs = blocks.distances(Y, X, "euclidean"), *(np.sort(blocks.distances(z, z, "euclidean"), 1)[:, 3] for z in (Y, X))
    for r in few:
        a, b = (d[r.id] < own[r.id]).sum(), (d[r.id] < theirs).sum()
        assert (r.recall, r.density, r.precision, r.coverage) == pytest.approx((a / 600, b / 3, float(b > 0), float(a > 0)))
    assert len(few) == 240 and topology.topology(frame(spark, Y[:0]), frame(spark, X), 3).collect() == []


def test_kernel_sums_leave_far_points_out(spark, seen, monkeypatch):
    x = np.round(np.concatenate([X, X, X + 300]), 2)
    q = np.round(np.concatenate([Y[:60], Y[:60] + 300]), 2)
    whole = density.fit_kernel(x)
    assert len(whole.points[0]) < 1250 and whole.points[1].sum() == len(x)
    scores = {r.id: r.score for r in density.kernel_score(frame(spark, q), whole).collect()}
    monkeypatch.setattr("typica.operators.passes.HELD_ROWS", 100)
    table = density.fit_kernel(frame(spark, x))
    assert table.points.count() == len(whole.points[0])
    got = {r.id: r.score for r in density.kernel_score(frame(spark, q), table).collect()}
    z, p = q @ table.inverse_root.T, x @ table.inverse_root.T
    plain = np.log(np.exp(table.log_norm - 0.5 * blocks.distances(z, p, "euclidean") ** 2).mean(1) + 1e-10)
    assert [got[i] for i in range(120)] == pytest.approx(plain.tolist(), abs=1e-6) and [scores[i] for i in range(120)] == pytest.approx(plain.tolist(), abs=1e-6)
    # where kernels are narrow beside the data, most points are not even sent
    points = frame(spark, 4 * X, np.ones(600)).withColumnRenamed("radius", "w")
    sums = {r.id: r.total for r in density.gaussian_sums(frame(spark, 4 * Y), points, 0.0, 1e-17).collect()}
    d2 = blocks.distances(4 * Y, 4 * X, "euclidean") ** 2
    assert [sums[i] for i in range(240)] == pytest.approx(np.exp(-0.5 * d2).sum(1).tolist(), abs=600e-17, rel=1e-9)
    assert seen["sent"][-1] < 0.4 * len(X) * len(seen["pairs"][-1].compare)


def conditions(x, a, margin):
    """By how much the weights a of all rows violate the optimality conditions."""
    g = kernel_margin.kernel(x, x, margin.gamma) @ a
    return g[a > 0].max() - g[a < 1].min()


@pytest.mark.parametrize("nu", [0.05, 0.5])
def test_margins_are_optimal_on_the_driver_and_in_tables(spark, monkeypatch, nu):
    x = np.round(X[:300, :3], 1)  # with repeats
    monkeypatch.setattr(kernel_margin, "WORKING", 24)
    held = kernel_margin.fit_kernel_margin(x, nu)
    v, w = held.support
    times = {tuple(r): n for r, n in zip(*np.unique(x, axis=0, return_counts=True), strict=True)}
    share = {tuple(r): s / times[tuple(r)] for r, s in zip(v, w, strict=True)}
    a = np.array([share.get(tuple(r), 0.0) for r in x])
    assert a.sum() == pytest.approx(nu * 300) and a.max() <= 1 + 1e-9 and conditions(x, np.where(a > 1 - 1e-9, 1.0, a), held) < 1e-5
    below = kernel_margin.kernel(x, v, held.gamma) @ w - held.rho < -1e-6
    assert below.mean() <= nu <= (kernel_margin.kernel(x, v, held.gamma) @ w - held.rho < 1e-6).mean()
    if nu == 0.05:
        monkeypatch.setattr("typica.operators.passes.HELD_ROWS", 100)
        monkeypatch.setattr(kernel_margin, "HELD", 100)
        spread = kernel_margin.fit_kernel_margin(frame(spark, x), nu, tolerance=1e-8)
        assert spread.gamma == pytest.approx(held.gamma) and spread.rho == pytest.approx(held.rho, rel=1e-6)
        one, other = ({r.id: r.score for r in kernel_margin.kernel_margin_score(frame(spark, Y[:40, :3]), m).collect()} for m in (held, spread))
        assert one == pytest.approx(other, abs=1e-5)


def test_few_rounds_and_few_rows_on_the_driver_are_enough(spark, monkeypatch):
    x, moved = np.random.default_rng(5).normal(size=(2000, 4)), []
    monkeypatch.setattr(kernel_margin, "WORKING", 48)
    held = kernel_margin.fit_kernel_margin(x, 0.1, rounds=8)
    assert held.gap <= 1e-9 * 0.1 * 2000 and held.support[1].sum() == pytest.approx(200)
    monkeypatch.setattr("typica.operators.passes.HELD_ROWS", 100)
    monkeypatch.setattr(kernel_margin, "HELD", 100)
    worst = kernel_margin.Spread.worst
    monkeypatch.setattr(kernel_margin.Spread, "worst", lambda self, n: moved.append(worst(self, n)) or moved[-1])
    spread = kernel_margin.fit_kernel_margin(frame(spark, x), 0.1, tolerance=1e-8, rounds=8)
    assert spread.gap <= 1e-8 * 0.1 * 2000 and spread.rho == pytest.approx(held.rho, abs=1e-5)
    assert spread.support.agg(F.sum("w")).first()[0] == pytest.approx(200) and sum(len(m[0]) for m in moved) < 600


def test_margins_of_rows_without_structure_need_few_rounds(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(1500, 24))  # most weights end between their bounds
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1400:] = x[:100] + 1e-3 * x[100:200]  # near copies
    x[1300:1310] = x[:10]
    monkeypatch.setattr(kernel_margin, "WORKING", 48)
    held = kernel_margin.fit_kernel_margin(x, 0.1, rounds=90)
    v, w = held.support
    assert held.gap <= 1e-9 * 0.1 * 1500 and w.sum() == pytest.approx(150, abs=1e-8) and w.min() > 0
    times = {tuple(r): n for r, n in zip(*np.unique(x, axis=0, return_counts=True), strict=True)}
    share = {tuple(r): s / times[tuple(r)] for r, s in zip(v, w, strict=True)}
    assert max(share.values()) <= 1 and conditions(x, np.array([share.get(tuple(r), 0.0) for r in x]), held) < 3e-7
    monkeypatch.setattr(kernel_margin, "DEALT", 100)
    monkeypatch.setattr(kernel_margin, "TILE", 128)
    dealt = kernel_margin.fit_kernel_margin(frame(spark, x), 0.1, rounds=90)
    assert dealt.gap <= 1e-9 * 0.1 * 1500 and dealt.rho == pytest.approx(held.rho, abs=1e-6)
    one, other = ({r.id: r.score for r in kernel_margin.kernel_margin_score(frame(spark, x[:40] + 0.1), m).collect()} for m in (held, dealt))
    assert one == pytest.approx(other, abs=1e-6)


def test_products_by_tiles_are_those_of_the_whole_kernel(monkeypatch):
    monkeypatch.setattr(kernel_margin, "TILE", 37)
    x, p = X[:150, :5], Y[:150, 0]
    parts = [kernel_margin.product(kernel_margin.bent(x, 0.7), p, kernel_margin.tiles(150)[k::3]) for k in range(3)]
    assert sum(parts) == pytest.approx(kernel_margin.kernel(x, x, 0.7) @ p, abs=1e-10)


def test_the_nu_that_accepts_most(spark):
    best = kernel_margin.best_kernel_margin(Rows(X[:120]))
    assert best.nu == 0.01 and best.gap <= 1e-9 * 0.01 * 120


def test_how_far_a_neighbour_can_be_takes_little_memory():
    """2048 rows, all cells and a hundred rows of each were held at once, over 3 GB a worker."""
    pivots, rows = RNG.normal(size=(1024, 8)), RNG.normal(size=(2048, 8))
    r, near = blocks.distances(rows, pivots, "euclidean"), np.sort(RNG.random((1024, 100)), axis=1)
    near[::2] = np.inf
    tracemalloc.start()
    got = cells.reaches(r, near, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    full = np.partition((r[:50, :, None] + near).reshape(50, -1), 99, axis=1)[:, 99]
    assert peak < 64e6 and (got[:50] >= full - 1e-12).all() and (got[:50] <= full + 0.5).all()
    few = np.full((1024, 100), np.inf)
    few[:, 0] = 0.0  # a row a cell: the nearest cells hold too few
    assert cells.reaches(r[:9], few, 100) == pytest.approx(np.sort(r[:9], axis=1)[:, 99]) and np.isinf(cells.reaches(r[:9], few[:, :1], 2000)).all()


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine", "dot"])
def test_the_screen_loses_no_neighbour(metric):
    """Batches of any size, repeats, an offset that short numbers can't resolve; as all distances have it."""
    x = np.concatenate([RNG.normal(size=(5200, 6)), RNG.normal(size=(3, 6)).repeat(40, axis=0)]) + 300.0
    q, fold = x[::17], neighbours.nearest(7, metric, True)
    state = fold.start(len(q))
    for lo, hi in ((0, 3), (3, 12), (12, 5000), (5000, len(x))):
        state = fold.step(state, [None, q], [np.arange(lo, hi), x[lo:hi]])
    want = np.sort(blocks.distances(q, x, metric), axis=1)[:, :7]
    assert state["d"] == pytest.approx(want, abs=2e-5 if metric == "euclidean" else 1e-8)
    at, near = np.indices(state["ids"].shape)[0].ravel(), state["ids"].ravel()
    assert screen.measured(q, x, at, near, metric) == pytest.approx(state["d"].ravel(), abs=1e-12)


def peak(work) -> tuple[object, float]:
    """What work gives, and the most MB that it had beside what was there."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("name", ["euclidean", "cosine", "dot", "manhattan", "counts"])
def test_a_block_of_queries_takes_little_beside_itself(name):
    """A worker holds a large block of queries; a step may not copy it whole for each batch of the bank."""
    rng = np.random.default_rng(3)
    few = 4 if name == "manhattan" else 64
    v, bank = rng.standard_normal((40_000 if name != "manhattan" else 9_000, few)), rng.standard_normal((9_000, few))
    q, b = [np.arange(len(v)), v, np.full(len(v), 8.0)], [np.arange(len(bank)), bank, np.full(len(bank), 8.5)]
    fold = topology._counts() if name == "counts" else neighbours.nearest(4, name, False)
    found, mb = peak(lambda: blocks.stepped(fold, fold.start(len(v)), q, b))
    some = rng.choice(len(v), 50, replace=False)
    d = blocks.distances(v[some], bank, "euclidean" if name == "counts" else name)
    if name == "counts":
        assert found["in_query"][some].tolist() == (d < 8.0).sum(1).tolist()
        assert found["in_ref"][some].tolist() == (d < 8.5).sum(1).tolist()
    else:
        np.testing.assert_allclose(found["d"][some], np.sort(d, 1)[:, :4], atol=1e-9)
    assert mb < 20  # all queries at once took 25 (dot) to 53


def test_steps_write_all_rows_and_an_empty_bank_changes_nothing():
    fold, v = neighbours.nearest(3, "euclidean", True), np.arange(20_000.0)[:, None]
    state = fold.start(len(v))
    assert blocks.stepped(fold, state, [np.arange(len(v)), v], [np.arange(0), np.empty((0, 1))]) is state
    found = blocks.stepped(fold, state, [np.arange(len(v)), v], [np.arange(len(v)) + 7, v])
    assert (found["d"][1:-1] == [0, 1, 1]).all()
    assert (found["ids"][1:-1] == np.arange(1, len(v) - 1)[:, None] + 7 + np.array([0, -1, 1])).all()


def test_kernels_are_summed_a_few_megabytes_at_a_time(spark, monkeypatch):
    folds, rng = [], np.random.default_rng(5)
    monkeypatch.setattr(density, "fold_pairs", lambda q, b, fold, **o: folds.append(fold) or q.withColumn("total", q["id"]))
    v, own, w = rng.standard_normal((3_000, 4)), rng.standard_normal((2_000, 4)), rng.random(2_000)
    density.gaussian_sums(spark.createDataFrame([(1, [0.0] * 4)], "id long, v array<double>"), (own, w), 0.3, 1e-17)
    found, mb = peak(lambda: folds[0].step(folds[0].start(len(v)), [np.arange(len(v)), v], [np.arange(len(own)), own, w]))
    d2 = ((v[:, None] - own[None]) ** 2).sum(-1)
    np.testing.assert_allclose(found["total"], np.exp(0.3 - 0.5 * d2) @ w, rtol=1e-9)
    assert mb < 16  # three whole matrices of 32 MB before


def test_passes_take_few_rows_at_once(spark):
    rows = passes.Rows(spark.range(20_000).selectExpr("id", "array(cast(id as double)) v").coalesce(1), most=10)
    most = passes.PASS_ROWS
    n, total, larger = rows.sums(lambda x: np.array([len(x), x.sum(), float(len(x) > most)]))
    rows.done()
    assert (n, total, larger) == (20_000, 20_000 * 19_999 / 2, 0)


def test_fits_do_not_depend_on_the_order_of_rows(spark):
    rows = frame(spark, X, parts=1)
    one, two = (density.fit_mixture(rows.orderBy(F.xxhash64("id", F.lit(k))), 4) for k in range(2))
    assert one.means.tolist() == two.means.tolist() and one.covariances.tolist() == two.covariances.tolist()
