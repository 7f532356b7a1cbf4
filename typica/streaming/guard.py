"""The incremental guard: texts that grow are scored every so many words, in batches of a minimum size.

``step`` is a pure function of (state, what came in) and serves streams through foreachBatch and tests alike. State rows:
req_id, text, word_count, last_predicted_at, finish_reason, first_seen. A step that can't fill its minimum scores nothing
and moves no counter; nor does one whose scores fail, which lets all requests go on and says so in ``error``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typica.functions.text import n_words

STATE = "req_id bigint, text string, word_count int, last_predicted_at int, finish_reason string, first_seen bigint"


def update(state: DataFrame, came: DataFrame) -> DataFrame:
    """state after came (req_id, text, finish_reason, seq): each request's latest text; here marks those that came."""
    last = came.groupBy("req_id").agg(F.max_by(F.struct("text", "finish_reason"), "seq").alias("x"), F.min("seq").alias("seen"))
    both = state.join(last, "req_id", "full_outer")
    text = F.coalesce("x.text", "text")
    return both.select("req_id", text.alias("text"), n_words(text).alias("word_count"), F.coalesce("last_predicted_at", F.lit(0)).alias("last_predicted_at"), F.coalesce("x.finish_reason", "finish_reason").alias("finish_reason"), F.coalesce("first_seen", "seen").alias("first_seen"), F.col("x").isNotNull().alias("here"))


def candidates(now: DataFrame, *, interval: int = 20, fill_share: float = 0.6) -> DataFrame:
    """now with tier: 1 due (enough new words, or finished now), 2 and 3 fill the batch, null otherwise.

    2: unfinished with fill_share of the interval; 3: finished before.
    """
    since, done = F.col("word_count") - F.col("last_predicted_at"), F.col("finish_reason").isNotNull()
    due = F.col("here") & ((since >= interval) | done)
    tier = F.when(due, 1).when(~done & (since >= fill_share * interval), 2).when(done, 3)
    return now.withColumn("tier", tier)


def batch(now: DataFrame, *, interval: int = 20, least: int = 10, fill_share: float = 0.6) -> DataFrame:
    """Rows to score: all of tier 1, then as many of tiers 2 and 3 in order of first_seen as the minimum needs; none if it can't be met."""
    c = candidates(now, interval=interval, fill_share=fill_share).where("tier is not null")
    due = c.where("tier = 1")
    n = due.count()
    if n == 0:
        return due
    if n < least:
        due = due.unionByName(c.where("tier > 1").orderBy("tier", "first_seen", "req_id").limit(least - n))
        if due.count() < least:
            return due.limit(0)
    return due


def step(state: DataFrame, came: DataFrame, score: Callable[[DataFrame], DataFrame], *, hold: Callable[[DataFrame], DataFrame] = lambda d: d, **limits) -> tuple[DataFrame, DataFrame]:
    """(new state, actions): score maps rows (req_id, text) to (req_id, pred); below 1 stops a request of this step.

    hold: what makes the scored rows fixed, as a written table, so that state and actions read the same scores and the model
    sees a batch once. actions: req_id, pred, action, error. If score or hold fails, the rows that were to be scored go on,
    without pred and with the error, and are due again.
    """
    now = update(state, came)
    found, actions, error = judged(now, batch(now, **limits), score, hold)
    new = now.join(found.select("req_id", F.lit(error is None).alias("scored")), "req_id", "left")
    new = new.select("req_id", "text", "word_count", F.when(F.col("scored"), F.col("word_count")).otherwise(F.col("last_predicted_at")).alias("last_predicted_at"), "finish_reason", "first_seen")
    return new, actions


def judged(now: DataFrame, chosen: DataFrame, score: Callable[[DataFrame], DataFrame], hold: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, str | None]:
    """(scores, actions, error) of the chosen rows of now, as ``step`` describes them."""
    try:
        found, error = hold(score(chosen.select("req_id", "text"))), None
    except Exception as e:  # the guard is open when its model is not there
        found, error = chosen.select("req_id", F.lit(None).cast("int").alias("pred")), f"{type(e).__name__}: {e}"[:500]
    here = now.select("req_id", "here")
    stop = (F.col("pred") < 1) & F.col("here")
    actions = found.join(here, "req_id").select("req_id", "pred", F.when(stop, "stop").otherwise("go").alias("action"), F.lit(error).cast("string").alias("error"))
    return found, actions, error


def kept_state(new: DataFrame, history: int) -> DataFrame:
    """All requests that still need a score, and the last ``history`` others that have finished, which may fill batches."""
    done = F.col("finish_reason").isNotNull() & (F.col("last_predicted_at") >= F.col("word_count"))
    return new.where(~done).unionByName(new.where(done).orderBy(F.desc("first_seen"), F.desc("req_id")).limit(history))


def run(stream: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, *, history: int = 1000, **limits):
    """Start the guard on a stream of (req_id, text, finish_reason, seq). Scores, state and actions are tables under folder, one
    per batch, so a batch that runs twice writes the same. Of the state the last two batches are kept. Finished requests
    leave the state once they are scored at their end, but for the last ``history`` of them, which fill batches."""

    def each(came: DataFrame, number: int) -> None:
        spark = came.sparkSession
        before = f"{folder}/state/{number - 1}"
        state = spark.read.schema(STATE).parquet(before) if number else spark.createDataFrame([], STATE)

        def hold(found: DataFrame) -> DataFrame:
            found.select("req_id", "pred").write.mode("overwrite").parquet(f"{folder}/scores/{number}")
            return spark.read.schema("req_id bigint, pred int").parquet(f"{folder}/scores/{number}")

        new, actions = step(state, came, lambda d: score(d).withColumn("pred", F.col("pred").cast("int")), hold=hold, **limits)
        actions.write.mode("overwrite").parquet(f"{folder}/actions/batch={number}")
        kept_state(new, history).write.mode("overwrite").parquet(f"{folder}/state/{number}")
        for old in (f"{folder}/state/{number - 2}", f"{folder}/scores/{number - 2}"):
            path = spark._jvm.org.apache.hadoop.fs.Path(old)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").start()
