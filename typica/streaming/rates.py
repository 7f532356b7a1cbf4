"""Rates: requests and tokens of the last seconds, and batches that keep below a rate. No task sees all rows of a model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typica.storage import write_out

#: Rows of a range of token_batches, seconds of a block of rate_window.
RANGE_ROWS, BLOCK = 1_000_000, 3600
MICROS = 1_000_000


def rate_window(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """requests (model, ts_us, tokens) with n_requests and n_tokens of the model's last seconds, the row's own included.

    The window of a row ends at its own time and begins after the same time ``seconds`` before. It is the part of the row's
    own second up to it, the whole seconds before that, and what comes after the beginning in the first second: only rows
    of one second of a model meet, beside sums of seconds in blocks of an hour. Rows of equal times count for each other;
    null models are one model; a row without a time has no window and gets nulls.
    """
    n, tokens = F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")
    timed = requests.where("ts_us is not null")
    points = timed.groupBy("model", "ts_us").agg(n, tokens).withColumn("sec", F.floor(F.col("ts_us") / MICROS))
    whole = points.groupBy("model", "sec").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    # a second also goes to the next block if that has seconds that look back on it
    block, last = F.floor(F.col("sec") / BLOCK), F.pmod("sec", F.lit(BLOCK)) >= BLOCK - seconds
    dealt = whole.withColumn("block", F.explode(F.when(last & (seconds <= BLOCK), F.array(block, block + 1)).otherwise(F.array(block))))
    if seconds > BLOCK:
        dealt = whole.withColumn("block", F.explode(F.sequence(block, F.floor((F.col("sec") + seconds) / BLOCK))))
    back = Window.partitionBy("model", "block").orderBy("sec").rangeBetween(-(seconds - 1), -1)
    looked = dealt.select("model", "sec", "block", *(F.coalesce(F.sum(c).over(back), F.lit(0)).alias(f"{c}_mid") for c in ("n", "t")))
    middle = looked.where(F.col("block") == block).select(F.col("model").alias("of_model"), F.col("sec").alias("of_sec"), "n_mid", "t_mid")
    own = points.join(middle, F.col("model").eqNullSafe(F.col("of_model")) & (F.col("sec") == F.col("of_sec")))
    rows = own.select("model", "sec", F.col("ts_us").alias("at"), F.col("ts_us").alias("of"), "n", "t", "n_mid", "t_mid", F.lit(False).alias("edge"))
    edges = points.select("model", F.col("sec") - seconds, F.col("ts_us") - seconds * MICROS, "ts_us", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(True))
    within = Window.partitionBy("model", "sec")
    upto = within.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    part = lambda c: F.when(F.col("edge"), F.sum(c).over(within) - F.sum(c).over(upto)).otherwise(F.sum(c).over(upto) + F.col(f"{c}_mid"))
    parts = rows.union(edges).select("model", "of", part("n").alias("n"), part("t").alias("t"))
    found = parts.groupBy(F.col("model").alias("of_model"), "of").agg(F.sum("n").alias("n_requests"), F.sum("t").alias("n_tokens"))
    out = requests.join(found, F.col("model").eqNullSafe(F.col("of_model")) & (F.col("ts_us") == F.col("of")), "left")
    return out.select(*(F.col(f"`{c}`") for c in requests.columns), "n_requests", "n_tokens")


def rate_stream(requests: DataFrame, seconds: int = 60, *, step: int = 1, late: int = 30) -> DataFrame:
    """(model, until, n_requests, n_tokens) of a stream of requests (request_id, model, ts, tokens): the last seconds at
    every full step. Requests that come twice count once; those over ``late`` seconds behind the newest are left out, and
    no state is held for longer. Steps are summed first, windows are sums of steps."""
    once = requests.withWatermark("ts", f"{late} seconds").dropDuplicatesWithinWatermark(["request_id"])
    steps = once.groupBy("model", F.window("ts", f"{step} seconds").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    windows = steps.groupBy("model", F.window(F.window_time("s"), f"{seconds} seconds", f"{step} seconds").alias("w"))
    return windows.agg(F.sum("n").alias("n_requests"), F.sum("t").alias("n_tokens")).select("model", F.col("w.end").alias("until"), "n_requests", "n_tokens")


class Fill:
    """Greedy filling of a stretch of rows, from any state of the batch that is open before it.

    A batch ends before the row that would take it over the cap, unless it has no tokens yet. sums[i]: tokens of the rows
    up to i; ends[s]: where a batch that starts at s ends.
    """

    def __init__(self, tokens: np.ndarray, cap: int):
        self.n, self.cap = len(tokens), cap
        self.sums = np.cumsum(tokens)
        before = self.sums - tokens
        self.ends = np.searchsorted(self.sums, before + cap, "right")
        lone = (self.ends < self.n) & (self._before(self.ends) == before)  # its first tokens alone are too many
        self.ends[lone] += 1

    def _before(self, i: np.ndarray) -> np.ndarray:
        return np.where(i > 0, self.sums[np.maximum(i, 1) - 1], 0)

    def first_end(self, used: int) -> int:
        """Where the batch that is open before the stretch ends, of which tokens are used."""
        return int(np.searchsorted(self.sums, self.cap - used, "right")) if used else int(self.ends[0])

    def summary(self) -> dict:
        """What becomes of any open batch: up to which room left it ends where, as room, tokens used at last, batches ended;
        the same where nothing is used yet; and all tokens, for a batch that goes on."""
        last, count, to = np.arange(self.n), np.ones(self.n, np.int64), self.ends.copy()
        while (to < self.n).any():  # the ends of the ends, and so on
            go = np.flatnonzero(to < self.n)
            at = to[go]
            count[go], last[go], to[go] = count[go] + count[at], last[at], to[at]
        used = self.sums[-1] - self._before(last)
        stops = np.arange(min(self.n, int(np.searchsorted(self.sums, self.cap, "right")) + 1))  # where an open batch may end
        change = np.ones(len(stops), bool)
        change[:-1] = (used[stops][1:] != used[stops][:-1]) | (count[stops][1:] != count[stops][:-1])
        keep = stops[change]
        return {"room": self.sums[keep].tolist(), "used": used[keep].tolist(), "ended": count[keep].tolist(), "used0": int(used[0]), "ended0": int(count[0]) - 1, "total": int(self.sums[-1])}

    def batches(self, used: int, at: int) -> np.ndarray:
        """The batch of each row, if batch ``at`` is open with so many tokens."""
        starts, i = np.zeros(self.n + 1, np.int64), self.first_end(used)
        while i < self.n:
            starts[i] += 1
            i = int(self.ends[i])
        return at + np.cumsum(starts[:-1])


def after(used: int, at: int, s: dict, cap: int) -> tuple[int, int]:
    """The open batch, its tokens and number, after a stretch with this summary."""
    if not used:
        return s["used0"], at + s["ended0"]
    if cap - used >= s["total"]:
        return used + s["total"], at
    k = int(np.searchsorted(s["room"], cap - used, "right"))
    return s["used"][k], at + s["ended"][k]


SUMMARY = {"room": "array<bigint>", "used": "array<bigint>", "ended": "array<bigint>", "used0": "bigint", "ended0": "bigint", "total": "bigint"}


def _stretches(t: pa.Table) -> Iterator[tuple[object, pa.Table]]:
    """The models of a table, each with its rows in order (ord, then tokens)."""
    if t.num_rows:
        t = t.sort_by([("model", "ascending"), ("ord", "ascending"), ("tokens", "ascending")])
        model = t.column("model").combine_chunks()
        new = np.flatnonzero([True, *(a != b for a, b in zip(model[1:].to_pylist(), model[:-1].to_pylist(), strict=True))])
        for lo, hi in zip(new, [*new[1:], t.num_rows], strict=True):
            yield model[int(lo)].as_py(), t.slice(int(lo), int(hi - lo))


def token_batches(texts: DataFrame, tokens_per_minute: int, share: float = 0.8, *, range_rows: int | None = None) -> DataFrame:
    """texts (model, ord, tokens, ...) with batch: filled greedily in order up to share of the limit; one batch if all fit.

    Rows are cut into ranges by model and ord. A range is summed up as what it does to any batch that is open before it,
    which only depends on the room left in that; a model's ranges are then chained by their summaries alone, and each range
    fills its batches from the state that it is entered with. Equal places of a model go by tokens; null tokens are none.
    """
    cap, size = int(tokens_per_minute * share), range_rows or RANGE_ROWS
    given = texts.withColumn("tokens", F.coalesce(F.col("tokens"), F.lit(0).cast(texts.schema["tokens"].dataType)))
    parts = max(1, -(-given.count() // size))
    rows = write_out(given.repartitionByRange(parts, "model", "ord").withColumn("part", F.spark_partition_id()), "ranges")
    kind = texts.schema["model"].dataType.simpleString()

    def sums(t: pa.Table) -> pa.Table:
        out = {"part": [], "model": [], **{c: [] for c in SUMMARY}}
        for model, own in _stretches(t):
            s = Fill(own.column("tokens").to_numpy().astype(np.int64), cap).summary()
            for c, x in {"part": own.column("part")[0].as_py(), "model": model, **s}.items():
                out[c].append(x)
        return pa.table({"part": pa.array(out["part"], pa.int32()), "model": pa.array(out["model"], t.schema.field("model").type), **{c: pa.array(out[c], pa.list_(pa.int64()) if "array" in k else pa.int64()) for c, k in SUMMARY.items()}})

    def chain(t: pa.Table) -> pa.Table:
        used, at, entered = 0, 0, []
        for s in t.sort_by("part").to_pylist():
            entered.append((s["part"], s["model"], used, at))
            used, at = after(used, at, s, cap)
        part, model, u, a = zip(*entered, strict=True)
        return pa.table({"part": pa.array(part, pa.int32()), "model": pa.array(model, t.schema.field("model").type), "used": pa.array(u, pa.int64()), "at": pa.array(a, pa.int64())})

    columns = texts.columns

    def fill(t: pa.Table, states: pa.Table) -> pa.Table:
        entered = {s["model"]: (s["used"], s["at"]) for s in states.to_pylist()}
        done = [own.select(columns).append_column("batch", pa.array(Fill(own.column("tokens").to_numpy().astype(np.int64), cap).batches(*entered[model]))) for model, own in _stretches(t)]
        return pa.concat_tables(done) if done else t.select(columns).append_column("batch", pa.array([], pa.int64()))

    summaries = rows.select("part", "model", "ord", "tokens").groupBy("part").applyInArrow(sums, f"part int, model {kind}, " + ", ".join(f"{c} {k}" for c, k in SUMMARY.items()))
    states = summaries.groupBy("model").applyInArrow(chain, f"part int, model {kind}, used bigint, at bigint")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema), "batch bigint"])
    return rows.groupBy("part").cogroup(states.groupBy("part")).applyInArrow(fill, schema)
