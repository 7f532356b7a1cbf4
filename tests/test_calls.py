"""Rounds of calls: only failed rows go again, nothing after a success, runs that were cut off go on."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from typica.sources import calls


class Model:
    """Fails each text as often as its first figure says; text 9 always; notes what it was sent."""

    def __init__(self, broken=()):
        self.sent, self.round, self.broken = [], 0, set(broken)

    def __call__(self, rows):
        own = self.round
        self.round += 1
        if own in self.broken:
            raise RuntimeError("no line")
        texts = [r.text for r in rows.collect()]
        self.sent.append(sorted(texts))
        out = rows.where("text <> 'silent'").withColumn("success", F.lit(own) >= F.coalesce(F.substring("text", 1, 1).try_cast("int"), F.lit(0)))
        return out.select("key", F.concat(F.lit("re: "), "text").alias("output"), "success", F.when(~F.col("success"), "busy").alias("error"))


def test_failed_rows_alone_go_again(spark, tmp_path):
    texts = spark.createDataFrame([("0a", 1), ("0a", 2), ("1b", 3), ("2c", 4), ("9d", 5), (None, 6), ("silent", 7)], "text string, n int")
    model, slept = Model(), []
    ask = lambda m, t=texts, **o: {r.n: r for r in calls.call_all(t, "m", m, f"{tmp_path}/log", metadata=["n"], sleep=slept.append, clock=lambda: datetime(2024, 1, 2), **o).collect()}
    got = ask(model, run="first", times=2)
    assert model.sent == [["", "0a", "1b", "2c", "9d", "silent"], ["1b", "2c", "9d", "silent"], ["2c", "9d", "silent"]]
    assert [(got[n].output, got[n].success, got[n].attempts) for n in (1, 2, 3, 4, 6)] == [("re: 0a", True, 1)] * 2 + [("re: 1b", True, 2), ("re: 2c", True, 3), ("re: ", True, 1)]
    assert (got[5].success, got[5].error, got[5].attempts) == (False, "busy", 3) and (got[7].success, got[7].error) == (False, "no answer")
    assert len(slept) == 2 and 1 <= slept[0] <= 1.5 and 2 <= slept[1] <= 3
    again = Model()
    assert ask(again, run="first", times=2)[5].attempts == 3 and again.sent == []  # its rounds are whole
    later = Model()
    later.round = 9
    assert ask(later, run="second")[5].success and later.sent == [["9d", "silent"]] + [["silent"]] * 3
    rows = calls.log(spark, f"{tmp_path}/log").where("key = sha2('9d', 256)").orderBy("run", "round").collect()
    assert [(r.input, r.metadata, r.success, r.timestamp_utc) for r in rows] == [("9d", {"n": "5"}, False, datetime(2024, 1, 2))] * 3 + [("9d", {"n": "5"}, True, datetime(2024, 1, 2))]


def test_a_call_that_fails_as_a_whole(spark, tmp_path):
    model = Model(broken=[0])
    rows = calls.call_all(spark.createDataFrame([("0a",), ("0b",)], "text string"), "m", model, f"{tmp_path}/log", sleep=lambda s: None).collect()
    assert model.sent == [["0a", "0b"]] and {(r.success, r.attempts) for r in rows} == {(True, 2)}
    assert {r.error for r in calls.log(spark, f"{tmp_path}/log").where("round = 0").collect()} == {"RuntimeError: no line"}
    assert calls.call_all(spark.createDataFrame([], "text string"), "m", model, f"{tmp_path}/none").collect() == []


def test_waits_grow_and_differ_by_run():
    one, two = ([calls.waits(1.0, 0.5, run, k) for k in (1, 2, 3)] for run in "ab")
    assert one != two and all(2**k <= w <= 1.5 * 2**k for ws in (one, two) for k, w in enumerate(ws))
    assert calls.waits(2.0, 0.0, "a", 2) == pytest.approx(4.0)
