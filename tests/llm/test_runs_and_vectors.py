"""Periodic runs, vector codes and exact top products against plain Python, odd rows included."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_registered import table as comparable
from typica.llm import periodic_runs, queries, vector_codes, voronoi_join

TABLES = ("documents", "embeddings")


@pytest.mark.parametrize("name", ["op11_harmonic_runs", "op12_code_cells", "op13_voronoi_topk"])
def test_query_beside_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == comparable(columns, want.fetchall())


def plain_runs(w, least=6, exponent=4):
    out = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, exponent * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in out.items())


def plain_collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in runs))


def periodic(rng, n, letters):
    w = [rng.randrange(letters) for _ in range(n)]
    a = rng.randrange(n)
    p = rng.randint(1, max(1, (n - a) // 4))
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("spread", [periodic_runs.mixed, lambda x: (x % 2).astype(np.uint64)], ids=["hashes", "hashes that collide"])
def test_runs_by_brute_force(spread, monkeypatch):
    rng = random.Random(3)
    for k in range(150):
        monkeypatch.setattr(periodic_runs, "PAIRS", (7, 1000)[k % 2])
        texts = [periodic(rng, rng.randint(1, 60), rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 6))] + [[]]
        starts, ids = np.cumsum([0, *map(len, texts)]), np.array([x for w in texts for x in w], np.int64)
        for least, exponent in ((6, 4), (2, 2), (5, 3)):
            got = periodic_runs.runs_of(ids, starts, least, exponent, spread)
            assert [tuple(r) for r in got.tolist()] == [(t, *r) for t, w in enumerate(texts) for r in plain_runs(w, least, exponent)]


def test_runs_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "WORDS", 500)
    rng = random.Random(4)
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "a b " * 5 + "\x1cq", *(" ".join(f"w{x}" for x in periodic(rng, 80, 3)) for _ in range(20))]
    texts += [texts[-1], "x  x\nx\tx x x x", "la " * 300_000 + "end", "nospace" * 100_000]
    rows = spark.createDataFrame([(k % 7, t, k, "kept") for k, t in enumerate(texts)], "doc_id long, text string, PR_runs int, pr_text string")
    got = periodic_runs.periodic_runs(rows).collect()
    assert len(got) == len(texts) and set(got[0].asDict()) == {"doc_id", "text", "pr_text", "pr_n_words", "pr_runs", "pr_collapsed"}
    for r in got:
        w = [x.decode() for x in (r.text or "").encode().split()]
        want = plain_runs(w) if len(w) < 1000 else [(0, 300_000, 1)]
        assert [(x.start, x.length, x.period) for x in r.pr_runs] == want and r.pr_n_words == len(w) and r.pr_text == "kept"
        assert r.pr_collapsed == (plain_collapsed(w, want) if len(w) < 1000 else "la end")
    assert periodic_runs.periodic_runs(rows.limit(0)).collect() == []


def plain_codes(rows, k=16, parts=8, rounds=6):
    sound = [(i, lab, [math.floor(4096 * x) for x in v]) for i, v, lab in rows if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v)]
    w = 16 // parts
    cut = [(i, lab, [tuple(v[p * w : p * w + w]) for p in range(parts)]) for i, lab, v in sound]
    first = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:k]
    books = [[r[2][p] for r in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, part: min(range(len(books[p])), key=lambda e: (dist(books[p][e], part), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for r in cut:
                own[nearest(p, r[2][p])].append(r[2][p])
            new.append([tuple(sum(c) // len(m) for c in zip(*m, strict=True)) if m else books[p][e] for e, m in enumerate(own)])
        books = new
    out = []
    for i, lab, v in cut:
        code = [nearest(p, v[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e in code), sum(dist(books[p][e], v[p]) for p, e in enumerate(code)), lab))
    return [(i, c, e, sum(x[2] for x in out if x[3] == lab)) for i, c, e, lab in out]


def odd_vectors(rng, n, d=16, spread=0.4):
    rows = []
    for k in range(n):
        mid = [0.2 * ((k * 7 + j) % 5) for j in range(d)]
        rows.append((k, [float(np.float32(m + spread * (rng.random() - 0.5))) for m in mid], k % 3 if k % 4 else None))
    rows += [(3, rows[3][1], 1), (3, rows[3][1], 1), (3, rows[9][1], None), (None, rows[5][1], 2), (None, rows[5][1], 2), (700, [0.0] * d, 1), (750, [0.0] * d, 0)]
    rows += [(50, None, 1), (51, [], 1), (52, [None, *[0.5] * (d - 1)], 1), (53, [float("nan")] * d, 1), (54, [float("-inf")] * d, 0), (55, [1.0] * (d - 1), 0)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n", [90, 5, 0])
def test_codes_by_brute_force(spark, n):
    rows = odd_vectors(random.Random(8), n) if n == 90 else odd_vectors(random.Random(8), 20)[:n]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("x")).withColumn("V", F.lit(1)).repartition(5)
    got = [(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.compress(df).collect()]
    assert sorted(got, key=str) == sorted(plain_codes(rows), key=str)
    assert vector_codes.compress(df.where("embedding is null")).collect() == []


def test_cells_bound_and_find_the_nearest():
    rng, measured, all_pairs = np.random.default_rng(0), 0, 0
    for _ in range(60):
        k, w, s = int(rng.integers(1, 17)), int(rng.integers(1, 9)), int(rng.choice([1, 5, 2000]))
        entries, x = rng.integers(-s, s + 1, (k, w)), rng.integers(-2 * s, 2 * s, (40, w))
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        least, most = vector_codes.Cells(entries).bounds(x)
        chosen, n = vector_codes.Cells(entries).nearest(x)
        assert (least <= d).all() and (d <= most).all() and (chosen == d.argmin(1)).all()
        measured, all_pairs = measured + n, all_pairs + d.size
    assert measured < 0.5 * all_pairs
    book = np.arange(32).reshape(2, 16)
    assert vector_codes.decode("01" + "00" * 7, book).tolist() == [16, 17, *range(2, 16)]


def plain_top(rows, k=5, every=50):
    sound = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v, _) in enumerate(rows) if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in sound:
        if i is not None and i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), j is None, j or 0) for m, j, c in sound if m != n)
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(best[:k])]
    return out


@pytest.mark.parametrize("sizes", [None, (3, 20), (1, 7)])
def test_top_products_by_brute_force(spark, sizes, monkeypatch):
    if sizes:
        monkeypatch.setattr(voronoi_join, "GROUP", sizes[0])
        monkeypatch.setattr(voronoi_join, "SHARE", sizes[1])
    rows = odd_vectors(random.Random(9), 130) + [(1000 + k, [0.25] * 16, 0) for k in range(60)] + [(2000 + k, [0.5 * (j == k % 16) for j in range(16)], 0) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit(1)).repartition(5)
    for every in (50, 1):
        got = voronoi_join.top_products(df, F.col("vec_id") % every == 0)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_top(rows, every=every), key=str)
    few = df.where("vec_id in (0, 1, 2) and size(embedding) = 16").distinct()
    assert [(r.rank, r.vec_id) for r in voronoi_join.top_products(few, F.col("vec_id") == 0, id_col="vec_id").select("rank", F.col("id").alias("vec_id")).orderBy("rank").collect()][0][0] == 1
    assert voronoi_join.top_products(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert voronoi_join.top_products(df, F.lit(False)).collect() == []


def test_groups_get_only_the_candidates_that_they_need(spark, monkeypatch):
    """In clusters far apart a group of queries needs its own clusters alone."""
    monkeypatch.setattr(voronoi_join, "GROUP", 40)
    sent, rng = [], np.random.default_rng(5)
    mids = rng.normal(size=(12, 16))
    mids /= np.linalg.norm(mids, axis=1)[:, None]
    v = np.repeat(mids, 100, 0) + 0.01 * rng.normal(size=(1200, 16))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)]
    own = voronoi_join.needed

    def counted(*args):
        out = own(*args)
        sent.append(out.agg(F.sum(F.size("groups"))).first()[0])
        return out

    monkeypatch.setattr(voronoi_join, "needed", counted)
    got = voronoi_join.top_products(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(plain_top(rows, every=5))
    assert sent[0] < 3 * len(rows)  # of at least 6 groups
