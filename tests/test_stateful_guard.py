"""The guard on the state store against the pure step, over batches, restarts and failures."""

import random

import pytest
from pyspark.sql import functions as F

from typica.streaming import guard, stateful

KIND = "req_id long, text string, finish_reason string, seq long"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def words(n):
    return " ".join(["w"] * n)


def score(df):
    return df.select("req_id", F.when(F.length("text") % 5 == 0, -1).otherwise(1).alias("pred"))


def feed(spark, source, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(source))


def taken(spark, folder):
    rows = spark.read.schema("req_id bigint, pred int, action string, error string, batch int").parquet(str(folder / "actions")).collect()
    return sorted((r.batch, r.req_id, r.pred, r.action) for r in rows if r.error is None)


def by_steps(spark, parts, **limits):
    """Actions of each part through guard.step, the state carried in memory."""
    state, out = [], []
    for rows in parts:
        new, actions = guard.step(spark.createDataFrame(state, guard.STATE), spark.createDataFrame(rows, KIND), score, **limits)
        out.append(sorted((r.req_id, r.pred, r.action) for r in actions.collect()))
        state = [tuple(r) for r in new.collect()]
    return out


@pytest.mark.parametrize("least", [1, 6])
def test_stream_equals_steps_over_a_restart(spark, tmp_path, least):
    rng = random.Random(least)
    size, parts = dict.fromkeys(range(12), 0), []
    for t in range(3):
        part = []
        for i in rng.sample(range(12), 6):
            size[i] += rng.choice((3, 13, 25))
            part.append((i, words(size[i]), "stop" if t == 2 and i % 4 == 0 else None, 100 * t + i))
        parts.append(part)
    source, folder = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    got = []
    for rows in parts:  # each part with a query of its own: the state outlives it
        q = stateful.run(spark.readStream.schema(KIND).parquet(str(source)), score, str(folder), least=least)
        feed(spark, source, rows)
        q.processAllAvailable()
        q.stop()
        got.append(taken(spark, folder))
    want = by_steps(spark, parts, least=least)
    assert [sorted(r[1:] for r in now if r not in old) for old, now in zip([[], *got], got, strict=False)] == want
    assert any(want) and (least == 1 or any(len(w) == least for w in want))


def test_late_texts_failures_and_what_a_batch_touches(spark, tmp_path):
    source, folder, fail, asked = tmp_path / "in", tmp_path / "out", [True], []
    source.mkdir()

    def flaky(df):
        asked.append(sorted(r.req_id for r in df.collect()))
        if fail[0]:
            raise RuntimeError("no model")
        return score(df)

    q = stateful.run(spark.readStream.schema(KIND).parquet(str(source)), flaky, str(folder), least=1)
    feed(spark, source, [(1, words(30), None, 5), (2, words(4), None, 6), (3, None, None, 7), (1, words(2), None, 1)])
    q.processAllAvailable()
    assert asked == [[1]] and taken(spark, folder) == []  # the last text counts, not the last row
    fail[0] = False
    feed(spark, source, [(1, words(3), None, 2)])  # late: the newer text stays, and is due again after the failure
    q.processAllAvailable()
    assert asked == [[1], [1]] and [r[1:] for r in taken(spark, folder)] == [(1, 1, "go")]
    feed(spark, source, [(1, words(31), None, 8), (2, words(9), "stop", 9)])
    q.processAllAvailable()
    touched = max((folder / "touched").iterdir(), key=lambda p: int(p.name))
    last = spark.read.schema(stateful.TOUCHED).parquet(str(touched))
    q.stop()
    assert asked[2:] == [[2]] and last.count() == 1  # the last batch only carried the score of 2 back
    state = {r.req_id: (r.word_count, r.last_predicted_at, r.finish_reason) for r in stateful.state_before(spark, str(folder / "checkpoint")).collect()}
    assert state == {1: (31, 30, None), 2: (9, 9, "stop"), 3: (0, 0, None)}


def test_requests_end_by_themselves(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    q = stateful.run(spark.readStream.schema(KIND).parquet(str(source)), score, str(folder), least=1, ttl_ms=1)
    for k in range(2):
        feed(spark, source, [(k, words(25), None, k)])
        q.processAllAvailable()
    feed(spark, source, [(0, words(30), None, 9)])  # forgotten, so due again with only five more words
    q.processAllAvailable()
    q.stop()
    assert [r[1] for r in taken(spark, folder)] == [0, 1, 0]
