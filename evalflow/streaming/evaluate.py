"""Structured Streaming: continuous scoring, retry selection, live status.

``evaluate_stream`` follows the commits of a store (or the files of a
folder) and writes the feedback rows of their records in ``foreachBatch``. A
micro-batch can be replayed after a failure (the sink is at-least-once), so
each batch first drops the keys that already have finished feedback among
the records it carries. ``retry_scored`` scores failed and stuck rows again,
``retry_stored`` puts the outcome into the store. ``status_stream`` counts
feedbacks, not rows: a feedback whose status changes leaves its old count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalflow.operators.metrics import REC_KEYS, evaluate
from evalflow.session import materialize
from evalflow.sources.store import COMMIT, FEEDBACKS, RECORDS, RunStore

# --- fixed values that must equal the reference's output -----------------
# Seconds after which a failed feedback is retried.
RETRY_FAILED_AFTER = 60
# Seconds after which a feedback stuck in "running" is retried.
RETRY_RUNNING_AFTER = 30
# --------------------------------------------------------------------------


def retry_pending(
    feedbacks: DataFrame,
    now: Column,
    failed_after: int = RETRY_FAILED_AFTER,
    running_after: int = RETRY_RUNNING_AFTER,
) -> DataFrame:
    """Feedback keys due for another judge call: failed longer than
    ``failed_after`` seconds ago, or running longer than ``running_after``.
    ``now`` is a column (a literal, or a scalar subquery) -- never read from
    the clock inside the plan, so retries are reproducible."""
    return feedbacks.where(_due(now, failed_after, running_after)).select(*REC_KEYS, "name", "status")


def _due(now: Column, failed_after: int, running_after: int) -> Column:
    age = F.timestamp_diff("MICROSECOND", F.col("last_ts"), now) / F.lit(1_000_000.0)
    failed, running = F.col("status") == "failed", F.col("status") == "running"
    return F.coalesce((failed & (age > failed_after)) | (running & (age > running_after)), F.lit(False))


def retry_scored(
    records: DataFrame,
    feedbacks: DataFrame,
    now: Column,
    scorer: Callable[[DataFrame], DataFrame] = evaluate,
    failed_after: int = RETRY_FAILED_AFTER,
    running_after: int = RETRY_RUNNING_AFTER,
) -> DataFrame:
    """The feedback table with its due rows scored again: a due row whose
    record still exists is replaced by the scorer's new row, all others stay,
    those of the same feedback that are not yet due too. The scorer sees each
    record with a due metric once; its output is written before use, as
    judge calls are neither free nor repeatable.
    """
    untouched, rest = _retried(records, feedbacks, now, scorer, failed_after, running_after)
    return untouched.unionByName(rest)


def _retried(
    records: DataFrame, feedbacks: DataFrame, now: Column, scorer: Callable[[DataFrame], DataFrame], failed_after: int, running_after: int
) -> tuple[DataFrame, DataFrame]:
    """``retry_scored`` in two parts: rows that are not due, read and filtered
    alone, and all others. Only due rows and their records are shuffled."""
    keys = [*REC_KEYS, "name"]
    is_due = _due(now, failed_after, running_after)
    due = feedbacks.where(is_due)
    # a row for each record with its due names: scored rows meet it where the scorer left them
    names = due.groupBy(F.struct(*REC_KEYS).alias("_other")).agg(F.collect_set(F.struct("name")).alias("_names"))
    key = F.struct(*REC_KEYS) == F.col("_other")
    todo = records.join(names, key, "left_semi")
    fresh = scorer(todo).join(names, key).where(F.array_contains("_names", F.struct("name")))
    fresh = materialize(fresh.select(*[F.col(c).cast(feedbacks.schema[c].dataType) for c in feedbacks.columns]), "retry")
    return feedbacks.where(~is_due), _matching(due, fresh, keys, "left_anti").unionByName(fresh)


def retry_stored(
    store: RunStore,
    now: Column,
    scorer: Callable[[DataFrame], DataFrame] = evaluate,
    failed_after: int = RETRY_FAILED_AFTER,
    running_after: int = RETRY_RUNNING_AFTER,
) -> int:
    """``retry_scored`` on a store: only partitions (dataset, recipe) with
    due feedback are read, scored and written, and one commit replaces them.
    Stopped before that, nothing has changed; run again, it finds what is
    due then. Returns the number of partitions replaced."""
    feedbacks = store.feedbacks()
    due = retry_pending(feedbacks, now, failed_after, running_after)
    # those whose records are gone cannot be scored
    due = _matching(due, store.records(), REC_KEYS, "left_semi")
    touched = due.select("dataset", "recipe").distinct()
    partitions = [(r["dataset"], r["recipe"]) for r in touched.collect()]  # one for each dataset of a recipe
    if partitions:
        own = reduce(lambda a, b: a | b, [F.col("dataset").eqNullSafe(d) & F.col("recipe").eqNullSafe(r) for d, r in partitions])
        untouched, rest = _retried(store.records().where(own), feedbacks.where(own), now, scorer, failed_after, running_after)
        store.replace_feedbacks(rest, partitions, untouched)
    return len(partitions)


def _matching(df: DataFrame, other: DataFrame, keys, how: str) -> DataFrame:
    """Rows of ``df`` with (``left_semi``) or without (``left_anti``) their keys in ``other``, nulls equal to nulls."""
    found = other.select(F.struct(*keys).alias("_other")).distinct()
    return df.join(found, F.struct(*keys) == F.col("_other"), how)


def _new_feedback(batch: DataFrame, store: RunStore, scored: DataFrame) -> DataFrame:
    """Scored rows whose key has no finished feedback yet; a failed or
    running one does not keep a new score out. The join on the partition
    columns prunes the store's folders at run time."""
    finished = store.feedbacks().where(F.col("status") == "done").select(*REC_KEYS, "name")
    return _matching(scored, _matching(finished, batch, REC_KEYS, "left_semi"), [*REC_KEYS, "name"], "left_anti")


def evaluate_stream(
    spark: SparkSession,
    source: RunStore | str,
    store: RunStore,
    checkpoint: str,
    questions: DataFrame | None = None,
    metrics=None,
    available_now: bool = True,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Score records arriving in ``source`` into ``store``.

    A store is followed by its log: each trigger scores the records of the
    commits since the last, so rows that are not committed are left alone. A
    string names a folder of record files without commits.
    ``scorer`` replaces the lexical judge (e.g. ``lambda df:
    evaluate_with_judge(df, judge)``). With ``available_now`` the query
    processes what is there and stops (batch-like scheduling with
    streaming bookkeeping); otherwise it keeps running.
    """
    followed = isinstance(source, RunStore)
    if followed:
        stream = spark.readStream.schema(COMMIT).json(source.path("commits"))
    else:
        stream = spark.readStream.schema(RECORDS).option("basePath", source).parquet(source)

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        if followed:
            batch = source.records(batch.select("commit"))
        # the batch is read twice below (keys, scoring);
        # cached blocks lost with an executor are re-read from the files
        batch = batch.persist()
        try:
            if scorer is not None:
                scored = scorer(batch)
            else:
                scored = evaluate(batch, questions, metrics, last_ts=F.localtimestamp())
            store.write_feedbacks(_new_feedback(batch, store, scored))
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


#: State on the executors' disks, of bounded memory, instead of their heaps.
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # counting the rows takes another lookup for each
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
_NO_TIME = -(1 << 62)


@contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """``conf`` for the queries started in the block; a stream keeps the settings it started with."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def status_stream(
    spark: SparkSession,
    feedbacks_path: str,
    out_path: str,
    checkpoint: str,
    available_now: bool = True,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Live counts of feedbacks per status, each by its latest row.

    The state holds each feedback's latest row (by time, then by status),
    kept by Spark's own aggregation; a trigger updates what it brought and
    counts the state anew. Every trigger writes ``out_path``/epoch=<number>
    anew, so a replayed one gives the same counts; read them with
    ``live_status``.
    """
    stream = spark.readStream.schema(FEEDBACKS).option("basePath", feedbacks_path)
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    at = F.coalesce(F.timestamp_diff("MICROSECOND", epoch, F.col("last_ts")), F.lit(_NO_TIME)).alias("at")
    rows = stream.parquet(feedbacks_path).select(*REC_KEYS, "name", F.struct(at, "status").alias("seen"))
    latest = rows.groupBy(*REC_KEYS, "name").agg(F.max("seen").alias("last"))

    def write(batch: DataFrame, epoch_id: int) -> None:
        counts = batch.groupBy(F.col("last.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")  # a row for each status

    writer = latest.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
    with _set(spark, _STATE_STORE):
        return writer.start()


def live_status(spark: SparkSession, out_path: str) -> DataFrame:
    """(status, n) as of the last trigger of ``status_stream``."""
    counts = spark.read.schema("status string, n long, epoch long").option("basePath", out_path).parquet(out_path)
    last = counts.select(F.max("epoch")).scalar()
    return counts.where((F.col("epoch") == last) & (F.col("n") > 0)).select("status", "n")
