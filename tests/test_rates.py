"""Rate windows and greedy batches by ranges against plain loops; the streaming form with late and repeated requests."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from typica.streaming import rates

RNG = random.Random(14)


def filled(rows, cap):
    out, used, at, model = {}, 0, 0, None
    for m, o, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if m != model:
            used, at, model = 0, 0, m
        if used + n > cap and used:
            used, at = 0, at + 1
        used += n
        out[m, o] = at
    return out


@pytest.mark.parametrize("size", [7, 1000])
def test_batches_by_ranges(spark, size):
    rows = [("hot", k, RNG.choice([0, 0, 1, 3, 9, 40, 130])) for k in range(300)] + [(m, k, RNG.choice([0, 20, 99])) for m in ("b", None) for k in range(25)] + [("zero", k, 0) for k in range(9)]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "model string, ord long, tokens int, more string").repartition(3)
    got = rates.token_batches(df, 125, range_rows=size).collect()
    assert {(r.model, r.ord): r.batch for r in got} == filled(rows, 100) and len(got) == len(rows) and {r.more for r in got} == {"kept"}
    assert rates.token_batches(df.limit(0), 125).collect() == []


def test_any_open_batch_goes_on_as_summed_up():
    import numpy as np

    for _ in range(200):
        t = np.array([RNG.choice([0, 0, 1, 2, 5, 30]) for _ in range(RNG.randrange(1, 40))])
        fill = rates.Fill(t, 20)
        s = fill.summary()
        assert len(s["room"]) <= 22
        for used in (0, 1, 5, 19, 20, 33):
            u, at = used, 3
            want = []
            for n in t:
                if u + n > 20 and u:
                    u, at = 0, at + 1
                u += n
                want.append(at)
            assert rates.after(used, 3, s, 20) == (u, at) and fill.batches(used, 3).tolist() == want


@pytest.mark.parametrize("seconds", [1, 60, 5000])
def test_windows_by_seconds(spark, seconds, monkeypatch):
    times = [RNG.randrange(-(10**9), 2 * 10**10) for _ in range(60)] + [x * 1_000_000 for x in range(3590, 3670)] + [3_599_999_999, 3_600_000_000, 3_600_000_001] * 2
    rows = [(RNG.choice(["m", "m", "n", None]), t, RNG.choice([None, 1, 5])) for t in times] + [("m", None, 3)]
    df = spark.createDataFrame(rows, "model string, ts_us long, tokens long").repartition(3)
    got = sorted((tuple(r) for r in rates.rate_window(df, seconds).collect()), key=str)
    want = []
    for m, t, n in rows:
        own = [x for x in rows if t is not None and x[1] is not None and x[0] == m and t - seconds * 10**6 < x[1] <= t]
        want.append((m, t, n, len(own) if t is not None else None, sum(x[2] or 0 for x in own) if t is not None else None))
    assert got == sorted(want, key=str)


def test_stream_of_late_and_repeated_requests(spark, tmp_path):
    start = datetime(2024, 5, 1)
    at = lambda s: start + timedelta(seconds=s)
    files = [
        [("a", "m", at(1), 10), ("b", "m", at(3), 20), ("a", "m", at(1), 10)],
        [("c", "m", at(62), 5), ("b", "m", at(3), 20), ("d", "n", at(40), 7)],  # b again; d is late, but not too late
        [("e", "m", at(200), 1)],
        [("f", "m", at(2), 1000), ("g", "m", at(400), 1)],  # f is too late
        [("h", "m", at(900), 1)],
        [("i", "m", at(901), 1)],
    ]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "request_id string, model string, ts timestamp, tokens long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("request_id string, model string, ts timestamp, tokens long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    run = rates.rate_stream(stream, 60, step=10).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {(r.model, round((r.until - start).total_seconds())): (r.n_requests, r.n_tokens) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["m", 10] == (2, 30) and got["m", 60] == (2, 30) and got["m", 70] == (1, 5)
    assert got["n", 50] == (1, 7) and got["m", 210] == (1, 1)
    assert all(t <= 400 + 70 or n == (1, 1) for (_, t), n in got.items())
