"""Metrics against direct definitions, and their invariances."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from typica.plans import metrics, report


def frame(spark, scores, labels):
    return spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, labels, strict=True)], "score double, is_id int")


def direct(scores, labels):
    s, y = np.asarray(scores, float), np.asarray(labels)
    pos, neg = s[y == 1], s[y == 0]
    auroc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    ts = np.unique(s)[::-1]
    tp, fp = np.array([(pos >= t).sum() for t in ts]), np.array([(neg >= t).sum() for t in ts])
    p, r = tp / (tp + fp), tp / len(pos)
    ap = (np.diff(r, prepend=0) * p).sum()
    f1 = 2 * p * r / (p + r + 1e-10)
    keep = np.ones(len(ts), bool)
    if len(ts) > 2:
        keep[1:-1] = (np.diff(fp, 2) != 0) | (np.diff(tp, 2) != 0)
    fpr, tpr = np.append(0, fp[keep] / len(neg)), np.append(0, tp[keep] / len(pos))
    return auroc, fpr[np.argmin(np.abs(tpr - 0.95))], ap, f1.max()


CASES = [
    ([1, 2, 3, 4], [0, 0, 1, 1]),
    ([4, 3, 2, 1], [0, 0, 1, 1]),
    ([1, 1, 1, 1], [0, 1, 0, 1]),
    ([0.1, 0.4, 0.35, 0.8], [0, 0, 1, 1]),
    ([5, 1, 2], [1, 0, 0]),
    (list(range(20)) + [0.5] * 3, [0, 1] * 10 + [1, 0, 1]),
]


@pytest.mark.parametrize(("scores", "labels"), CASES)
def test_metrics(spark, scores, labels):
    r = metrics.all_metrics(frame(spark, scores, labels)).first()
    assert tuple(r) == pytest.approx(direct(scores, labels))
    one = frame(spark, scores, labels)
    assert metrics.auroc(one).first()[0] == pytest.approx(r.auroc) and metrics.average_precision(one).first()[0] == pytest.approx(r.auprc) and metrics.fpr_at_tpr(one).first()[0] == pytest.approx(r.fpr95) and metrics.best_f1(one).first()[0] == pytest.approx(r.f1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(0, 1)), min_size=4, max_size=60))
def test_properties(spark, rows):
    rows = [*rows, (0, 1), (1, 0)]
    s, y = [a for a, _ in rows], [b for _, b in rows]
    up, down, bent = (metrics.all_metrics(frame(spark, x, y)).first() for x in (s, [-a for a in s], [np.exp(a) for a in s]))
    assert tuple(up) == pytest.approx(direct(s, y))
    assert up.auroc == pytest.approx(1 - down.auroc) and tuple(up) == pytest.approx(tuple(bent))


def test_ranges_give_the_same_curve(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, np.round(rng.normal(size=500), 1), rng.integers(0, 2, 500))
    assert sorted(map(tuple, metrics.curve(df, ranges=7).collect())) == sorted(map(tuple, metrics.curve(df, ranges=1).collect()))


def test_one_sided_batches_are_null(spark):
    r = metrics.all_metrics(frame(spark, [1, 2], [1, 1])).first()
    assert r.auroc is None and r.fpr95 is None


def test_collinear_points_go(spark):
    df = frame(spark, [6, 5, 4, 3, 2, 1], [1, 1, 1, 0, 0, 0])
    assert sorted((r.fpr, r.tpr) for r in metrics.roc(df).collect()) == [(0, 0), (0, pytest.approx(1 / 3)), (0, 1), (1, 1)]


def test_thresholds_and_probabilities(spark):
    df = frame(spark, [1, 2, 3, 4], [0, 0, 1, 1])
    assert [r.pred for r in metrics.decide(df, None).orderBy("score").collect()] == [-1, -1, 1, 1]
    assert [r.proba for r in metrics.probabilities(df).orderBy("score").collect()] == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert {r.proba for r in metrics.probabilities(frame(spark, [2, 2], [0, 1])).collect()} == {0.5}
    assert metrics.percentile(df, 0.05) == pytest.approx(np.percentile([1, 2, 3, 4], 5))


def test_rejection_rates(spark):
    rng = np.random.default_rng(2)
    s, y = np.round(rng.normal(size=80), 2), rng.integers(0, 2, 80)
    rows = {r.threshold_key: r for r in metrics.rejection_rates(frame(spark, s, y)).collect()}
    for i, p in enumerate(metrics.PERCENTILES):
        t = np.percentile(s, p)
        r = rows[f"threshold_{i + 1}"]
        assert (r.threshold, r.safe_rejection_rate, r.toxic_rejection_rate) == pytest.approx((t, (s[y == 1] > t).mean(), (s[y == 0] > t).mean()))
        assert r.accuracy == pytest.approx((((s <= t) & (y == 1)) | ((s > t) & (y == 0))).mean())
    f1 = [2 * ((s >= t) & (y == 1)).sum() / ((s >= t).sum() + (y == 1).sum()) for t in np.unique(s)]
    assert rows["optimal_f1"].threshold == np.unique(s)[int(np.argmax(f1))]
    flipped = {r.threshold_key: r for r in metrics.rejection_rates(frame(spark, s, y), reject_above=False).collect()}
    assert flipped["threshold_3"].safe_rejection_rate == pytest.approx(1 - rows["threshold_3"].safe_rejection_rate)


def test_histogram_is_a_density(spark):
    h = metrics.histogram(frame(spark, [0, 0.5, 1, 2, 3], [1, 1, 1, 0, 0]), bins=6).collect()
    for y in (0, 1):
        assert sum(r.density * (r.hi - r.lo) for r in h if r.is_id == y) == pytest.approx(1)


def test_report_sinks(spark, tmp_path):
    tidy = spark.createDataFrame([("a", "d1", 0.5), ("b", "d1", 0.25), ("a", "d2", 1.0)], "method string, dataset string, auroc double")
    w = report.wide(tidy, ["d1", "d2"], ["auroc"])
    report.write_csv(w, f"{tmp_path}/r")
    back = {r.method: r for r in spark.read.option("header", True).csv(f"{tmp_path}/r").collect()}
    assert back["a"]["d2_AUROC" if "d2_AUROC" in back["a"].asDict() else "d2"] == "1.0000"
    report.write_metadata(w, f"{tmp_path}/m", {"n": 3, "models": ["x"]})
    assert spark.read.json(f"{tmp_path}/m").first().n == 3
