"""Queries over embeddings: neighbours, topology, detectors.

In-distribution (ID) rows have label < 7; ID rows with vec_id % 5 < 3 train, the rest and all others are scored as one
batch; training rows of even vec_id are the reference; label 9 stands in for a background corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typica.functions import vectors as V
from typica.operators import density, kernel_margin, linear, neighbours
from typica.operators.topology import topology
from typica.plans import metrics
from typica.plans.detector import Detector, TypicalityDetector
from typica.plans.registered import SQL, query
from typica.session import table


def rows(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    """(id, v, label); with dims, v is the sums over so many equal stretches of the embedding."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (v if dims is None else F.array(*(V.total(F.slice(v, 1 + k * (64 // dims), 64 // dims)) for k in range(dims)))).alias("v"), F.col("label").cast("long").alias("label"))


TRAIN = "label < 7 AND id % 5 < 3"


def train(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    return rows(spark, sf_dir, dims).where(TRAIN)


def batch(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    return rows(spark, sf_dir, dims).where(f"NOT ({TRAIN})")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train(spark, sf_dir).where("id % 2 = 0")


def background(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    return rows(spark, sf_dir, dims).where("label = 9")


def vecs(df: DataFrame) -> DataFrame:
    return df.select("id", "v")


def out(scores: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """vec_id and the columns, rounded, without negative zero."""
    return scores.select(F.col("id").alias("vec_id"), *((F.round(c, digits) + 0.0).alias(c) for c in columns or ("score",)))


E = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), tr AS (SELECT * FROM e WHERE label < 7 AND id % 5 < 3), q AS (SELECT * FROM e WHERE NOT (label < 7 AND id % 5 < 3)), ref AS (SELECT * FROM tr WHERE id % 2 = 0)"
#: The same on the sums of the embeddings' halves, two dimensions in which SQL can write out inverse and determinant.
E2 = E.replace("embedding::DOUBLE[] AS v", "[list_sum(embedding[1:32]::DOUBLE[]), list_sum(embedding[33:64]::DOUBLE[])] AS v")
PRDC = f"""{E},
rr AS (SELECT a.id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN a.id = b.id THEN 0 ELSE list_distance(a.v, b.v) END) AS k FROM ref a, ref b),
qq AS (SELECT a.id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN a.id = b.id THEN 0 ELSE list_distance(a.v, b.v) END) AS k FROM q a, q b),
rad_r AS (SELECT id, d AS r FROM rr WHERE k = 6), rad_q AS (SELECT id, d AS r FROM qq WHERE k = 6),
pairs AS (SELECT q.id, q.label, list_distance(q.v, ref.v) AS d, rad_r.r AS rr, rad_q.r AS rq FROM q JOIN rad_q ON q.id = rad_q.id, ref JOIN rad_r ON ref.id = rad_r.id),
prdc AS (SELECT id, any_value(label) AS label, count(*) FILTER (d < rq) / (SELECT count(*) FROM ref)::DOUBLE AS recall, count(*) FILTER (d < rr) / 5.0::DOUBLE AS density, max((d < rr)::INT)::DOUBLE AS precision, (min(d) < any_value(rq))::INT::DOUBLE AS coverage FROM pairs GROUP BY id)"""


@query(f"WITH {PRDC} SELECT id AS vec_id, round(recall, 6) AS recall, round(density, 6) AS density, precision, coverage FROM prdc")
def prdc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(topology(vecs(batch(spark, sf_dir)), vecs(reference(spark, sf_dir))), "recall", "density", "precision", "coverage")


#: Metrics of a CTE s (score, is_id) in SQL; eps completes F1.
METRICS = """c AS (SELECT score, sum(is_id) AS p, sum(1 - is_id) AS n FROM s GROUP BY score),
cu AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM c WINDOW w AS (ORDER BY score DESC)),
ro AS (SELECT *, lag(tp) OVER w - 2 * tp + lead(tp) OVER w AS bt, lag(fp) OVER w - 2 * fp + lead(fp) OVER w AS bf FROM cu WINDOW w AS (ORDER BY score DESC)),
kept AS (SELECT * FROM ro WHERE bt IS NULL OR bt <> 0 OR bf <> 0),
f AS (SELECT *, tp / (tp + fp)::DOUBLE AS pr, tp / pp::DOUBLE AS rc FROM cu),
m AS (SELECT (SELECT sum(n * (tp + tp - p) / 2.0::DOUBLE) / max(pp * nn) FROM cu) AS auroc,
  (SELECT fp / nn::DOUBLE FROM kept ORDER BY abs(tp / pp::DOUBLE - 0.95::DOUBLE), score DESC LIMIT 1) AS fpr95,
  (SELECT sum(p * pr) / max(pp) FROM f) AS auprc, (SELECT max(2 * pr * rc / (pr + rc + 1e-10)) FROM f) AS f1)"""


@query(f"WITH {PRDC}, s AS (SELECT density AS score, (label < 7)::INT AS is_id FROM prdc), {METRICS} SELECT round(auroc, 6) AS auroc, round(fpr95, 6) AS fpr95, round(auprc, 6) AS auprc, round(f1, 6) AS f1 FROM m")
def prdc_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: topology of the batch, its density as the score, and the ranking metrics."""
    b = batch(spark, sf_dir)
    scores = topology(vecs(b), vecs(reference(spark, sf_dir))).join(b.select("id", "label"), "id").select(F.col("density").alias("score"), (F.col("label") < 7).cast("int").alias("is_id"))
    return metrics.all_metrics(scores).select(*((F.round(c, 6) + 0.0).alias(c) for c in ("auroc", "fpr95", "auprc", "f1")))


def _knn_sql(distance: str, k: int) -> str:
    return f"""WITH {E}, d AS (SELECT q.id, {distance} AS d FROM q, tr), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM d),
s AS (SELECT id, -avg(d) AS score FROM k WHERE k <= {k} GROUP BY id) SELECT id AS vec_id, round(score, 6) AS score, CASE WHEN score > (SELECT median(score) FROM s) THEN 1 ELSE -1 END AS pred FROM s"""


def _knn(spark: SparkSession, sf_dir: str, metric: str, k: int) -> DataFrame:
    s = Detector("knn", metric=metric, k=k).setup(vecs(train(spark, sf_dir)), vecs(background(spark, sf_dir))).predict(vecs(batch(spark, sf_dir)))
    return s.select(F.col("id").alias("vec_id"), (F.round("score", 6) + 0.0).alias("score"), "pred")


@query(_knn_sql("list_distance(q.v, tr.v)", 1))
def knn_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "euclidean", 1)


@query(_knn_sql("1 - list_cosine_similarity(q.v, tr.v)", 3))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "cosine", 3)


@query(_knn_sql("list_sum(list_transform(list_zip(q.v, tr.v), lambda z: abs(z[1] - z[2])))", 3))
def knn_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "manhattan", 3)


@query(f"WITH {E}, d AS (SELECT q.id, 1 - list_cosine_similarity(q.v, tr.v) AS d FROM q, tr), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM d) SELECT id AS vec_id, round(-d, 6) AS score FROM k WHERE k = 5")
def cider_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(neighbours.kth_distance(vecs(batch(spark, sf_dir)), vecs(train(spark, sf_dir)), 5))


@query(f"WITH {E}, d AS (SELECT q.id, list_dot_product(q.v, tr.v) AS d FROM q, tr), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d DESC) AS k FROM d) SELECT id AS vec_id, round(avg(d), 6) AS mean_sim, round(min(d), 6) AS min_sim FROM k WHERE k <= 100 GROUP BY id")
def knn_topk_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(neighbours.top_similarity(vecs(batch(spark, sf_dir)), vecs(train(spark, sf_dir)), 100), "mean_sim", "min_sim")


@query(f"WITH {E}, d AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS d FROM e a, e b WHERE a.label = 0 AND b.label = 1), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d DESC, other) AS k FROM d) SELECT id AS vec_id, other, k AS rank, round(d, 6) AS sim FROM k WHERE k <= 3")
def cosine_matrix_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    pairs = neighbours.similar_pairs(vecs(r.where("label = 0")), vecs(r.where("label = 1")), 3)
    return pairs.select(F.col("id").alias("vec_id"), "other", "rank", (F.round("sim", 6) + 0.0).alias("sim"))


@query(f"WITH {PRDC} SELECT id AS vec_id, round(r, 6) AS radius FROM rad_r")
def self_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(neighbours.radii(vecs(reference(spark, sf_dir)), 5), "radius")


@query(f"WITH {E} SELECT id AS vec_id, round(-(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v)))))), 6) AS score FROM q")
def energy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(linear.energy(vecs(batch(spark, sf_dir))))


@query(f"WITH {E}, s AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM e) SELECT id AS vec_id, round(n, 6) AS norm, round(list_sum(list_transform(v, lambda x: abs(x / greatest(n, 1e-12)))), 6) AS unit_total, round(list_sum(v), 6) AS raw_total FROM s")
def feature_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rows(spark, sf_dir).select("id", *(V.feature(F.col("v"), k).alias(k) for k in ("norm", "normalized", "raw")))
    return out(f.select("id", F.get("norm", F.lit(0)).alias("norm"), V.total(F.transform("normalized", F.abs)).alias("unit_total"), V.total(F.col("raw")).alias("raw_total")), "norm", "unit_total", "raw_total")


@query(f"WITH {E} SELECT i - 1 AS dim, round(avg(x), 6) AS mean FROM (SELECT unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM tr) GROUP BY i")
def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = train(spark, sf_dir).select(F.posexplode("v").alias("dim", "x"))
    return each.groupBy(F.col("dim").cast("long").alias("dim")).agg((F.round(F.avg("x"), 6) + 0.0).alias("mean"))


@query(f"WITH {E}, x AS (SELECT id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM tr) SELECT a.i - 1 AS i, b.i - 1 AS j, round(covar_pop(a.x, b.x), 8) AS cov_mle, round(covar_samp(a.x, b.x), 8) AS cov_unbiased FROM x a JOIN x b USING (id) GROUP BY a.i, b.i")
def covariance_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the one pass of sums that all linear fits share."""
    m = linear.moments(vecs(train(spark, sf_dir)))
    d = len(m.mean)
    flat = [(i, j, float(m.covariance()[i, j]), float(m.covariance(True)[i, j])) for i in range(d) for j in range(d)]
    df = spark.createDataFrame(flat, "i long, j long, a double, b double")
    return df.select("i", "j", (F.round("a", 8) + 0.0).alias("cov_mle"), (F.round("b", 8) + 0.0).alias("cov_unbiased"))


def _md2(mean: str, n: str) -> str:
    """Quadratic form over two dimensions about the rows of a CTE's moments."""
    return f"(({n}.syy * (q.v[1] - {mean}.mx) * (q.v[1] - {mean}.mx) - 2 * {n}.sxy * (q.v[1] - {mean}.mx) * (q.v[2] - {mean}.my) + {n}.sxx * (q.v[2] - {mean}.my) * (q.v[2] - {mean}.my)) / ({n}.sxx * {n}.syy - {n}.sxy * {n}.sxy))"


def _m2(name: str, where: str) -> str:
    return f"{name} AS (SELECT avg(v[1]) AS mx, avg(v[2]) AS my, var_pop(v[1]) AS sxx, var_pop(v[2]) AS syy, covar_pop(v[1], v[2]) AS sxy FROM tr WHERE {where})"


@query(f"WITH {E2}, {_m2('m', 'true')} SELECT q.id AS vec_id, round(-{_md2('m', 'm')}, 6) AS score FROM q, m")
def mahalanobis_lowdim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(linear.mahalanobis(vecs(batch(spark, sf_dir, 2)), vecs(train(spark, sf_dir, 2))))


@query(f"WITH {E2}, {_m2('m', 'id % 2 = 0')}, {_m2('b', 'true')} SELECT q.id AS vec_id, round({_md2('b', 'b')} - {_md2('m', 'm')}, 6) AS score FROM q, m, b")
def rmd_lowdim(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = train(spark, sf_dir, 2)
    return out(linear.relative_mahalanobis(vecs(batch(spark, sf_dir, 2)), vecs(t.where("id % 2 = 0")), vecs(t)))


WB = f"""{E}, comp AS (SELECT i, avg(x) FILTER (c = 1) AS m1, avg(x) FILTER (c = 0) AS m0 FROM (SELECT 1 AS c, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM tr UNION ALL SELECT 0, unnest(range(1, len(v) + 1)), unnest(v) FROM e WHERE label = 9) GROUP BY i),
wb AS (SELECT list(m1 - m0 ORDER BY i) AS w, list(m1 ORDER BY i) AS mu, -sum((m1 - m0) * (m1 + m0) / 2) AS b FROM comp)"""


def lse(x: str) -> str:
    return f"(abs({x}) + ln(1 + exp(-2 * abs({x}))))"


def _margin(spark: SparkSession, sf_dir: str) -> linear.Margin:
    return linear.mean_margin(vecs(train(spark, sf_dir)), vecs(background(spark, sf_dir)))


def _detect(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    d = Detector(name, margin=_margin(spark, sf_dir), **options)
    return out(d.setup(vecs(train(spark, sf_dir)), vecs(background(spark, sf_dir))).postprocess(vecs(batch(spark, sf_dir))))


@query(f"""WITH {WB}, half AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY id) AS k FROM tr) WHERE k % 2 = 1), t AS (SELECT quantile_cont(x, 0.9) AS t FROM (SELECT unnest(v) AS x FROM half)),
l AS (SELECT id, list_dot_product(list_transform(v, lambda x: least(x, t.t)), w) + b AS l FROM q, t, wb) SELECT id AS vec_id, round({lse('l')}, 6) AS score FROM l""")
def react_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark, sf_dir, "react")


@query(f"WITH {WB} SELECT id AS vec_id, round(-(abs(list_dot_product(v, w) + b) / sqrt(list_dot_product(w, w))) / greatest(list_distance(v, mu), 1e-8), 6) AS score FROM q, wb")
def fdbd_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark, sf_dir, "fdbd")


@query(f"""WITH {WB}, bank AS (SELECT id, v, {lse('(list_dot_product(v, w) + b)')} AS g, sqrt(list_dot_product(v, v)) + 1e-10 AS n FROM tr, wb),
mine AS (SELECT id, v, {lse('(list_dot_product(v, w) + b)')} AS g, sqrt(list_dot_product(v, v)) + 1e-10 AS n FROM q, wb),
s AS (SELECT mine.id, mine.g, list_dot_product(mine.v, bank.v) / mine.n / bank.n * bank.g AS s FROM mine, bank), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC) AS k FROM s)
SELECT id AS vec_id, round(avg(s) * any_value(g), 6) AS score FROM k WHERE k <= 10 GROUP BY id""")
def nnguide_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark, sf_dir, "nnguide", k=10)


@query(f"""WITH {WB}, wr AS (SELECT j, y, row_number() OVER (ORDER BY abs(y), j) AS k FROM (SELECT unnest(range(1, len(w) + 1)) AS j, unnest(w) AS y FROM wb)), small AS (SELECT list(CASE WHEN k <= 3 THEN -0.1::DOUBLE * sign(y) ELSE 0.0::DOUBLE END ORDER BY j) AS p FROM wr),
a AS (SELECT id, v, (label < 7 AND id % 5 < 3) AS is_train, list_dot_product(v, w) + b AS l, p FROM e, wb, small),
m AS (SELECT *, CASE WHEN l > 0 THEN list_transform(list_zip(v, p), lambda z: z[1] + z[2]) ELSE v END AS vp, list_transform(list_sort(list_transform(v, lambda x, i: {{'a': -x, 'i': i}})), lambda s: s.i) AS top FROM a),
s AS (SELECT id, is_train, l, list_sum(list_transform(top[1:6], lambda i: greatest(vp[i], 0.0::DOUBLE))) + 10 * list_sum(list_transform(top[1:3], lambda i: abs(vp[i] - v[i]))) AS qq FROM m),
r AS (SELECT s.id, s.l, (SELECT count(*) FROM s t WHERE t.is_train AND t.qq <= s.qq) / (SELECT count(*) FROM s WHERE is_train)::DOUBLE AS ecdf FROM s WHERE NOT is_train)
SELECT id AS vec_id, round({lse('(l * (90 + (1 - ecdf) * 9) / 100)')}, 6) AS score FROM r""")
def adascale_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark, sf_dir, "adascale")


def _euclid(p: str, m: str) -> str:
    return f"sqrt(2 * ({p} - {m}) * ({p} - {m}))"


def _eucos(p: str, m: str) -> str:
    return f"(0.5::DOUBLE * sqrt(2 * ({p} - {m}) * ({p} - {m})) + 1 - ((1 - {p}) * (1 - {m}) + {p} * {m}) / (sqrt((1 - {p}) * (1 - {p}) + {p} * {p}) * sqrt((1 - {m}) * (1 - {m}) + {m} * {m})))"


@query(f"""WITH {WB}, pt AS (SELECT 1 / (1 + exp(-(list_dot_product(v, w) + b))) AS p FROM tr, wb), pb AS (SELECT 1 / (1 + exp(-(list_dot_product(v, w) + b))) AS p FROM e, wb WHERE label = 9),
c1 AS (SELECT p FROM pt WHERE p > 0.5), c0 AS (SELECT p FROM pb WHERE p <= 0.5), m1 AS (SELECT avg(p) AS m FROM c1), m0 AS (SELECT avg(p) AS m FROM c0),
s1 AS (SELECT avg(d) AS s FROM (SELECT {_eucos('p', 'm')} AS d FROM c1, m1 ORDER BY d DESC LIMIT 20)), s0 AS (SELECT avg(d) AS s FROM (SELECT {_eucos('p', 'm')} AS d FROM c0, m0 ORDER BY d DESC LIMIT 20)),
x AS (SELECT id, 1 / (1 + exp(-(list_dot_product(v, w) + b))) AS p FROM q, wb),
y AS (SELECT id, p, least(1, greatest(0, 1 - exp(-{_eucos('p', 'm0.m')} / s0.s))) AS w0, least(1, greatest(0, 1 - exp(-{_eucos('p', 'm1.m')} / s1.s))) AS w1 FROM x, m0, m1, s0, s1),
z AS (SELECT id, p, (1 - p) * (1 - w0 * CASE WHEN p < 0.5 THEN 1 ELSE 0.5::DOUBLE END) AS a, p * (1 - w1 * CASE WHEN p >= 0.5 THEN 1 ELSE 0.5::DOUBLE END) AS c FROM y)
SELECT id AS vec_id, round(greatest(exp(a), exp(c)) / (exp(a) + exp(c) + exp((1 - p - a) + (p - c))), 6) AS score FROM z""")
def openmax_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark, sf_dir, "openmax", distance="eucos")


@query(SQL["openmax_score"].replace(_eucos("p", "m"), _euclid("p", "m")).replace(_eucos("p", "m0.m"), _euclid("p", "m0.m")).replace(_eucos("p", "m1.m"), _euclid("p", "m1.m")))
def openmax_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark, sf_dir, "openmax")


@query(f"""WITH {E2}, h AS (SELECT pow(count(*), -1 / 6::DOUBLE) AS h, var_samp(v[1]) AS xx, var_samp(v[2]) AS yy, covar_samp(v[1], v[2]) AS xy FROM ref), c AS (SELECT xx * h * h + 1e-6 AS sxx, yy * h * h + 1e-6 AS syy, xy * h * h AS sxy FROM h),
d AS (SELECT q.id, exp(-0.5::DOUBLE * (syy * (q.v[1] - ref.v[1]) * (q.v[1] - ref.v[1]) - 2 * sxy * (q.v[1] - ref.v[1]) * (q.v[2] - ref.v[2]) + sxx * (q.v[2] - ref.v[2]) * (q.v[2] - ref.v[2])) / (sxx * syy - sxy * sxy)) / (2 * pi() * sqrt(sxx * syy - sxy * sxy)) AS k FROM q, ref, c)
SELECT id AS vec_id, round(ln(avg(k) + 1e-10), 6) AS score FROM d GROUP BY id""")
def kde_logpdf_lowdim(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = train(spark, sf_dir, 2).where("id % 2 = 0")
    return out(density.kernel_score(vecs(batch(spark, sf_dir, 2)), density.fit_kernel(vecs(ref))))


@query(f"""WITH {E2}, g AS (SELECT label % 2 AS k, avg(v[1]) AS mx, avg(v[2]) AS my FROM tr GROUP BY k), c AS (SELECT var_pop(v[1]) AS sxx, var_pop(v[2]) AS syy, covar_pop(v[1], v[2]) AS sxy FROM tr),
p AS (SELECT q.id, exp(-0.5::DOUBLE * (syy * (q.v[1] - mx) * (q.v[1] - mx) - 2 * sxy * (q.v[1] - mx) * (q.v[2] - my) + sxx * (q.v[2] - my) * (q.v[2] - my)) / (sxx * syy - sxy * sxy)) AS e, sxx * syy - sxy * sxy AS det FROM q, g, c)
SELECT id AS vec_id, round(ln(sum(0.5::DOUBLE * e / (2 * pi() * sqrt(det)))), 6) AS loglik, round(ln(sum(0.5::DOUBLE * e) + 1e-45), 6) AS raw FROM p GROUP BY id""")
def gmm_score_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components at the means of even and odd labels, one covariance, equal weights: both densities."""
    t = train(spark, sf_dir, 2)
    parts = [linear.moments(vecs(t.where(F.col("label") % 2 == k))) for k in (0, 1)]
    model = density.Mixture(np.array([0.5, 0.5]), np.stack([m.mean for m in parts]), np.stack([linear.moments(vecs(t)).covariance()] * 2))
    b = vecs(batch(spark, sf_dir, 2))
    both = density.mixture_score(b, model).withColumnRenamed("score", "loglik").join(density.mixture_score(b, model, raw=True).withColumnRenamed("score", "raw"), "id")
    return out(both, "loglik", "raw")


# ---- full fits: SQL solves the same equations in its own way


def moments_sql(n: str, source: str, covar: str = "covar_pop", ridge: str = "0") -> str:
    """CTEs {n}m (m: the covariance as rows) and {n}mu (mu) of a source (id, v)."""
    return f"""{n}x AS (SELECT id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM {source}), {n}mu AS (SELECT list(a ORDER BY i) AS mu FROM (SELECT i, avg(x) AS a FROM {n}x GROUP BY i)),
{n}m AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM (SELECT a.i, b.i AS j, {covar}(a.x, b.x) + CASE WHEN a.i = b.i THEN {ridge} ELSE 0 END AS c FROM {n}x a JOIN {n}x b USING (id) GROUP BY a.i, b.i) GROUP BY i))"""


def quadratic_sql(n: str, rows: str) -> str:
    """CTE {n}md (id, md): the quadratic form of rows (id, v) about mu with the inverse of m, by conjugate gradients."""
    plus = lambda a, f, b: f"list_transform(list_zip({a}, {b}), lambda z: z[1] + {f} * z[2])"
    return f"""{n}g AS (SELECT id, {plus('v', '(-1.0::DOUBLE)', 'mu')} AS g FROM {rows}, {n}mu),
{n}cg AS (SELECT id, 0 AS k, g, list_transform(g, lambda z: 0.0::DOUBLE) AS x, g AS r, g AS p, list_dot_product(g, g) AS rs FROM {n}g UNION ALL
SELECT id, k + 1, g, x, r, {plus('r', '(list_dot_product(r, r) / rs)', 'p')}, list_dot_product(r, r) FROM (SELECT id, k, g, rs, p, {plus('x', 'f', 'p')} AS x, {plus('r', '(-f)', 'ap')} AS r FROM
(SELECT *, rs / list_dot_product(p, ap) AS f FROM (SELECT c.*, list_transform(m, lambda row: list_dot_product(row, p)) AS ap FROM {n}cg c, {n}m WHERE k < 400 AND rs > 1e-22)))),
{n}md AS (SELECT id, arg_max(list_dot_product(g, x), k) AS md FROM {n}cg GROUP BY id)"""


@query(f"WITH RECURSIVE {E}, {moments_sql('a', 'tr')}, {quadratic_sql('a', 'q')} SELECT id AS vec_id, round(-md, 6) AS score FROM amd")
def mahalanobis_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(linear.mahalanobis(vecs(batch(spark, sf_dir)), vecs(train(spark, sf_dir))))


@query(f"WITH RECURSIVE {E}, {moments_sql('a', 'ref')}, {quadratic_sql('a', 'q')}, {moments_sql('b', 'tr')}, {quadratic_sql('b', 'q')} SELECT id AS vec_id, round(bmd.md - amd.md, 6) AS score FROM amd JOIN bmd USING (id)")
def rmd_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = train(spark, sf_dir)
    return out(linear.relative_mahalanobis(vecs(batch(spark, sf_dir)), vecs(t.where("id % 2 = 0")), vecs(t)))


def _side(n: str, cut: str) -> str:
    half = lambda where: f"(SELECT id, v{cut} AS v FROM {where})"
    return ", ".join([moments_sql(f"a{n}", half("tr"), "covar_samp", "1e-6"), quadratic_sql(f"a{n}", half("q")), moments_sql(f"b{n}", half("e WHERE label = 9"), "covar_samp", "1e-6"), quadratic_sql(f"b{n}", half("q"))])


@query(f"WITH RECURSIVE {E}, {_side('i', '[1:32]')}, {_side('o', '[33:64]')} SELECT id AS vec_id, round((bimd.md - aimd.md + bomd.md - aomd.md) / 2, 6) AS score FROM aimd JOIN bimd USING (id) JOIN aomd USING (id) JOIN bomd USING (id)")
def rmd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vectors per row: the halves of the embedding stand in for encoder and decoder states."""
    halves = lambda d: d.select("id", F.slice("v", 1, 32).alias("v_in"), F.slice("v", 33, 32).alias("v_out"))
    return out(linear.relative_mahalanobis_pairs(halves(batch(spark, sf_dir)), halves(train(spark, sf_dir)), halves(background(spark, sf_dir))))


def logistic_sql(weight: float = 1.0, cut: str = "") -> str:
    """CTE wb (w, mu, b): logistic regression of tr against label 9, by accelerated gradient steps of one over the largest
    curvature that the rows' lengths allow."""
    plus = lambda a, f, b: f"list_transform(list_zip({a}, {b}), lambda z: z[1] + {f} * z[2])"
    return f"""lx AS (SELECT row_number() OVER () AS n, x, y, wt FROM (SELECT list_append(v{cut}, 1.0::DOUBLE) AS x, 1.0::DOUBLE AS y, 1.0::DOUBLE AS wt FROM tr UNION ALL SELECT list_append(v{cut}, 1.0::DOUBLE), 0.0, {weight} FROM e WHERE label = 9)),
lt AS (SELECT list(c ORDER BY i) AS xt FROM (SELECT i, list(c ORDER BY n) AS c FROM (SELECT n, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS c FROM lx) GROUP BY i)),
ls AS (SELECT list(x ORDER BY n) AS xs, list(y ORDER BY n) AS ys, list(wt ORDER BY n) AS ws, 1 + 0.25::DOUBLE * sum(wt * list_dot_product(x, x)) AS l FROM lx),
la AS (SELECT xs, ys, ws, xt, l, (sqrt(l) - 1) / (sqrt(l) + 1) AS beta FROM ls, lt),
lr AS (SELECT 0 AS k, list_transform(xt, lambda c: 0.0::DOUBLE) AS p, list_transform(xt, lambda c: 0.0::DOUBLE) AS h FROM la UNION ALL
SELECT k + 1, p2, {plus('p2', 'beta', plus('p2', '(-1.0::DOUBLE)', 'p'))} FROM (SELECT k, p, beta, {plus('h', '(-1 / l)', plus('g', '1.0::DOUBLE', 'list_append(h[:len(h) - 1], 0.0::DOUBLE)'))} AS p2 FROM
(SELECT k, p, h, l, beta, list_transform(xt, lambda c: list_dot_product(c, d)) AS g FROM (SELECT k, p, h, l, beta, xt, list_transform(list_zip(list_transform(xs, lambda x: list_dot_product(x, h)), ys, ws), lambda z: z[3] * (1 / (1 + exp(-z[1])) - z[2])) AS d FROM lr, la WHERE k < 40 * sqrt(l))))),
wb AS (SELECT p[:len(p) - 1] AS w, p[len(p)] AS b, (SELECT list(a ORDER BY i) FROM (SELECT i, avg(x) AS a FROM (SELECT unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM tr) GROUP BY i)) AS mu FROM lr ORDER BY k DESC LIMIT 1)"""


@query(f"WITH RECURSIVE {E}, {logistic_sql(1.0, '[1:32]')} SELECT id AS vec_id, round(list_dot_product(v[1:32], w) + b, 6) AS score FROM q, wb")
def binary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = lambda d: d.select("id", F.slice("v", 1, 32).alias("v_in"), F.slice("v", 33, 32).alias("v_out"))
    return out(linear.relative_mahalanobis_pairs(halves(batch(spark, sf_dir)), halves(train(spark, sf_dir)), halves(background(spark, sf_dir)), "binary_input"))


@query(f"WITH RECURSIVE {E}, {logistic_sql(50.0)} SELECT id AS vec_id, round(list_dot_product(v, w) + b, 6) AS score FROM q, wb")
def logistic_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = linear.logistic_margin(vecs(train(spark, sf_dir)), vecs(background(spark, sf_dir)), weight=50.0)
    return out(linear.margin_score(vecs(batch(spark, sf_dir)), m))


def _with_logistic(name: str, **options) -> None:
    """The detector on its own margin, logistic regression, beside its SQL on the same."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = Detector(name, **options).setup(vecs(train(spark, sf_dir)), vecs(background(spark, sf_dir)))
        return out(d.postprocess(vecs(batch(spark, sf_dir))))

    run.__name__ = f"{name}_logistic"
    query(SQL[f"{name}_score"].replace(f"WITH {WB}", f"WITH RECURSIVE {E}, {logistic_sql()}"))(run)


for _name, _options in (("react", {}), ("fdbd", {}), ("nnguide", {"k": 10}), ("adascale", {}), ("openmax", {"distance": "eucos"})):
    _with_logistic(_name, **_options)


# ---- kernel densities and margins with a Gaussian kernel


def pair_steps_sql(source: str, nu: float, score: str) -> str:
    """CTEs that solve the one-class dual over source (id, v) by its most violating pairs, and s (id, score) over rows of score."""
    return f"""sv AS (SELECT row_number() OVER (ORDER BY id) AS n, v FROM {source}), gm AS (SELECT 1 / (any_value(d) * var_pop(x)) AS gamma FROM (SELECT len(v) AS d, unnest(v) AS x FROM sv)),
km AS MATERIALIZED (SELECT list(k ORDER BY n) AS k FROM (SELECT a.n, list(exp(-gamma * list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) ORDER BY b.n) AS k FROM sv a, sv b, gm GROUP BY a.n)),
st AS (SELECT 0 AS t, list_transform(k, lambda x: {nu}::DOUBLE) AS a, list_transform(k, lambda x: {nu}::DOUBLE * list_sum(x)) AS g, 0.0::DOUBLE AS rho, 1.0::DOUBLE AS gap FROM km UNION ALL
SELECT t + 1, list_transform(a, lambda x, p: CASE WHEN p = i THEN CASE WHEN d = 1 - x THEN 1.0 ELSE x + d END WHEN p = j THEN CASE WHEN d = x THEN 0.0 ELSE x - d END ELSE x END), list_transform(list_zip(g, k[i], k[j]), lambda z: z[1] + d * (z[2] - z[3])), (low + high) / 2, high - low FROM
(SELECT *, least((high - low) / greatest(2 - 2 * k[i][j], 1e-12), 1 - a[i], a[j]) AS d FROM (SELECT *, list_position(up, low) AS i, list_position(dn, high) AS j FROM (SELECT *, list_min(up) AS low, list_max(dn) AS high FROM
(SELECT *, list_transform(list_zip(g, a), lambda z: CASE WHEN z[2] < 1 THEN z[1] ELSE 1e300 END) AS up, list_transform(list_zip(g, a), lambda z: CASE WHEN z[2] > 0 THEN z[1] ELSE -1e300 END) AS dn FROM st, km WHERE gap > 1e-11 * len(a) AND t < 100000))))),
al AS (SELECT a, rho FROM st ORDER BY t DESC LIMIT 1),
s AS (SELECT q.id, sum(a[n] * exp(-gamma * list_sum(list_transform(list_zip(q.v, sv.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) - any_value(rho) AS score FROM {score} q, sv, gm, al GROUP BY q.id)"""


@query(f"WITH RECURSIVE {E}, {pair_steps_sql('tr', 0.1, 'q')} SELECT id AS vec_id, round(score, 6) AS score FROM s")
def rbf_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-class margin with a Gaussian kernel on whole embeddings."""
    return out(kernel_margin.kernel_margin_score(vecs(batch(spark, sf_dir)), kernel_margin.fit_kernel_margin(vecs(train(spark, sf_dir)), 0.1)))


def topology_sql(n: str, rows: str, cut: str) -> str:
    """CTE {n}f (id, f): the four features of rows against ref, on a slice of the vectors."""
    near = lambda t: f"SELECT id, d AS r FROM (SELECT a.id, list_distance(a.v{cut}, b.v{cut}) AS d, row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN a.id = b.id THEN 0 ELSE list_distance(a.v{cut}, b.v{cut}) END) AS k FROM {t} a, {t} b) WHERE k = 6"
    return f"""{n}f AS (SELECT id, [avg((d < rq)::INT), sum((d < rr)::INT) / 5.0, max((d < rr)::INT), max((d < rq)::INT)]::DOUBLE[] AS f
FROM (SELECT a.id, list_distance(a.v{cut}, b.v{cut}) AS d, x.r AS rq, y.r AS rr FROM {rows} a JOIN ({near(rows)}) x USING (id), ref b JOIN ({near('ref')}) y USING (id)) GROUP BY id)"""


#: Features of two models, the embedding and its first half: ft of the training rows that are no reference, fq of the batch.
FEATURES = f"""{E}, odd AS (SELECT * FROM tr WHERE id % 2 <> 0), {topology_sql('a', 'odd', '')}, {topology_sql('b', 'odd', '[1:32]')}, {topology_sql('c', 'q', '')}, {topology_sql('d', 'q', '[1:32]')},
ft AS MATERIALIZED (SELECT id, af.f || bf.f AS v FROM af JOIN bf USING (id)), fq AS MATERIALIZED (SELECT id, cf.f || df.f AS v FROM cf JOIN df USING (id))"""


def kernel_sql(fit: str, rows: str, d: int) -> str:
    """CTE s (id, score): the kernel density of fit in d dimensions; the bandwidth matrix is inverted by elimination."""
    return f"""{moments_sql('k', fit, f'(SELECT count(*) FROM {fit}) ** (-2.0::DOUBLE / {d + 4}) * covar_samp', '1e-6')},
el AS (SELECT 0 AS k, list_transform(m, lambda r, i: r || list_transform(range(1, {d + 1}), lambda j: CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE)) AS m, 0.0::DOUBLE AS ld FROM km UNION ALL
SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN p ELSE list_transform(list_zip(r, p), lambda z: z[1] - r[k + 1] * z[2]) END), ld + ln(m[k + 1][k + 1]) FROM (SELECT *, list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1]) AS p FROM el WHERE k < {d})),
iv AS (SELECT list_transform(m, lambda r: r[{d + 1}:]) AS m, ld FROM el WHERE k = {d}),
s AS (SELECT id, ln(avg(exp(-0.5 * ({d} * ln(2 * pi()) + ld + list_dot_product(x, list_transform(m, lambda r: list_dot_product(r, x)))))) + 1e-10) AS score FROM (SELECT q.id, list_transform(list_zip(q.v, t.v), lambda z: z[1] - z[2]) AS x FROM {rows} q, {fit} t), iv GROUP BY id)"""


def _even(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """The core detector on two models, with even ids as the reference."""
    pick = lambda d: {"full": vecs(d), "half": d.select("id", F.slice("v", 1, 32).alias("v"))}
    return out(TypicalityDetector(method, half="id % 2 = 0").fit(pick(train(spark, sf_dir))).scores(pick(batch(spark, sf_dir))))


@query(f"WITH RECURSIVE {FEATURES}, {kernel_sql('ft', 'fq', 8)} SELECT id AS vec_id, round(score, 6) AS score FROM s")
def core_kde_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _even(spark, sf_dir, "kde")


@query(f"WITH RECURSIVE {FEATURES}, {pair_steps_sql('ft', 0.01, 'fq')} SELECT id AS vec_id, round(score, 6) AS score FROM s")
def core_rbf_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all nus the smallest accepts most training rows here."""
    return _even(spark, sf_dir, "ocsvm_rbf")


# ---- fits that SQL can't express: rows only here, held against numpy in the tests


@query()
def vim_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark, sf_dir, "vim", dim=32)


@query()
def gmm_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight tied components on the first principal directions, uncentred."""
    t = vecs(train(spark, sf_dir))
    directions = density.reduction(t, "pca", 8)
    low = density.project(t, directions)
    return out(density.mixture_score(density.project(vecs(batch(spark, sf_dir)), directions), density.fit_mixture(low, 8, "tied")))


@query()
def gmm_lda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonal components on the directions that separate training rows from the background, without normalisers."""
    t, b = vecs(train(spark, sf_dir)), vecs(background(spark, sf_dir))
    directions = density.reduction(t, "lda", 1, classes=[b, t])
    model = density.fit_mixture(density.project(t, directions), 4, "diag")
    return out(density.mixture_score(density.project(vecs(batch(spark, sf_dir)), directions), model, raw=True))


def _core(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """Two models: the embedding and its first half."""
    pick = lambda d: {"full": vecs(d), "half": d.select("id", F.slice("v", 1, 32).alias("v"))}
    d = TypicalityDetector(method).fit(pick(train(spark, sf_dir)))
    return metrics.probabilities(d.predict(pick(batch(spark, sf_dir)))).select(F.col("id").alias("vec_id"), "score", "pred", "proba")


@query()
def core_gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _core(spark, sf_dir, "gmm")


@query()
def core_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _core(spark, sf_dir, "kde")


@query()
def core_ocsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _core(spark, sf_dir, "ocsvm")


@query()
def core_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batch(spark, sf_dir)
    d = TypicalityDetector("kde").fit({"full": vecs(train(spark, sf_dir))})
    return d.evaluate({"full": vecs(b.where("label < 7"))}, {"full": vecs(b.where("label >= 7"))})
