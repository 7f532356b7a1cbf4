"""The incremental guard on Spark's state store: one state per request that ends by itself, and batches as large as what came in.

The operator keeps every request under its id and lets out only those that something came for. What a batch scored comes
back through a folder that the stream reads beside its own source, so scores reach the state in the next batch. The whole
state is read, as of the batch before, only by a batch that has due requests and fewer of them than its minimum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from typica.functions.text import n_words
from typica.storage import drop_path
from typica.streaming import guard

KEPT = "text string, word_count int, last_predicted_at int, finish_reason string, first_seen bigint, seq bigint"
TOUCHED = f"{guard.STATE}, here boolean"
SCORED = "req_id bigint, scored_at int"
#: Settings of the query. Batches without rows would follow each other for good, as states may end at any time.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Requests(StatefulProcessor):
    """A request's latest text and the word count it was last scored at. Rows with scored_at say that it was scored, all
    others bring a text; of these the one with the largest seq stays (ties: the largest text), also against earlier batches.
    Scores of requests that have ended are dropped."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("request", KEPT, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = self.kept.get()
        text, words, scored, finish, first, seq = old if old is not None else (None, None, 0, None, None, None)
        here, back = False, []
        for r in rows:
            if r.scored_at is not None:
                back.append(r.scored_at)
                continue
            here = True
            first = r.seq if old is None and (first is None or r.seq < first) else first
            if seq is None or (r.seq, r.text or "") >= (seq, text or ""):
                text, words, seq = r.text if r.text is not None else text, r.word_count if r.text is not None else words, r.seq
                finish = r.finish_reason if r.finish_reason is not None else finish
        if old is not None or here:
            words, scored = words or 0, max(back, default=scored)
            self.kept.update((text, words, scored, finish, first, seq))
            yield Row(req_id=key[0], text=text, word_count=words, last_predicted_at=scored, finish_reason=finish, first_seen=first, here=here)

    def close(self) -> None:
        pass


def state_before(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The requests that live on after the last batch that ended, in the columns of a batch, none of them here."""
    kept = spark.read.format("statestore").option("stateVarName", "request").load(checkpoint).where("value.ttlExpirationMs > unix_millis(current_timestamp())")
    value = [c.split()[0] for c in guard.STATE.split(", ")[1:]]
    return kept.select(F.col("key.req_id").alias("req_id"), *(F.col(f"value.value.{c}").alias(c) for c in value), F.lit(False).alias("here"))


def run(stream: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, *, ttl_ms: int = 3_600_000, **limits):
    """Start the guard on a stream of (req_id, text, finish_reason, seq); score and limits as in ``guard.step``.

    A request is forgotten ttl_ms after the last row for it, finished or not; until then a finished one may fill batches.
    Scores and actions are tables under folder, one per batch, written again by a batch that runs again. A null req_id is a
    request like any other. A query started again on the folder goes on with its state.
    """
    spark, checkpoint, back = stream.sparkSession, f"{folder}/checkpoint", f"{folder}/scored"
    for made in (back, f"{folder}/actions"):
        path = spark._jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def each(came: DataFrame, number: int) -> None:
        own = came.sparkSession
        touched_at, scores_at = f"{folder}/touched/{number}", f"{folder}/scores/{number}"
        came.write.mode("overwrite").parquet(touched_at)
        now = own.read.schema(TOUCHED).parquet(touched_at)
        due = guard.candidates(now, **{k: v for k, v in limits.items() if k != "least"}).where("tier = 1").count()
        if number and 0 < due < limits.get("least", 10):
            before = state_before(own, checkpoint)
            now = now.unionByName(before.join(now.select(F.col("req_id").alias("id")), F.col("req_id").eqNullSafe(F.col("id")), "left_anti"))

        def hold(found: DataFrame) -> DataFrame:
            found.select("req_id", F.col("pred").cast("int").alias("pred")).write.mode("overwrite").parquet(scores_at)
            return own.read.schema("req_id bigint, pred int").parquet(scores_at)

        if due:
            found, actions, error = guard.judged(now, guard.batch(now, **limits), score, hold)
            actions.write.mode("overwrite").parquet(f"{folder}/actions/batch={number}")
            if error is None:
                found.join(now, "req_id").select("req_id", F.col("word_count").alias("scored_at")).write.mode("overwrite").parquet(f"{back}/{number}")
        for old in (f"{folder}/touched/{number - 1}", f"{folder}/scores/{number - 1}"):
            drop_path(own, old)

    texts = stream.select("req_id", "text", n_words(F.col("text")).alias("word_count"), "finish_reason", "seq", F.lit(None).cast("int").alias("scored_at"))
    scored = spark.readStream.schema(SCORED).option("recursiveFileLookup", "true").option("cleanSource", "delete").parquet(back)
    scored = scored.select("req_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("word_count"), F.lit(None).cast("string").alias("finish_reason"), F.lit(None).cast("bigint").alias("seq"), "scored_at")
    kept = texts.unionByName(scored).groupBy("req_id").transformWithState(Requests(ttl_ms), TOUCHED, "update", "processingTime")
    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:  # the query takes a copy of the settings when it starts
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        return kept.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
