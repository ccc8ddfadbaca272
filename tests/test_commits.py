"""The commit log: what a stopped writer leaves, replaced partitions, resumed experiments, retry, live status, statistics."""

from __future__ import annotations

import datetime as dt
import math
import os
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from evalflow.operators import metrics, stats
from evalflow.plans import pipeline, planning
from evalflow.registry import _Stopped
from evalflow.sources.store import RunStore
from evalflow.streaming import evaluate as streaming

T0 = dt.datetime(2024, 1, 1)
REC = "recipe string, dataset string, record_id string, input string, output string, contexts array<struct<page_content:string,metadata:string>>"
FB = "recipe string, dataset string, record_id string, name string, status string, result double, last_ts timestamp_ntz"


def records(spark, rows):
    df = spark.createDataFrame(rows, REC)
    return df.select("*", *[F.lit(None).alias(c) for c in ("metadata", "n_tokens", "start_time", "end_time", "error")])


def feedbacks(spark, rows):
    return spark.createDataFrame(rows, FB).withColumn("calls", F.lit(None).cast("array<struct<reason:string,reasons:string,context:string,score:double>>"))


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


# ---------------------------------------------------------------- store


def test_rows_show_with_their_commit_only(spark, tmp_dir):
    store = RunStore(spark, f"{tmp_dir}/s")
    rec = records(spark, [("r", "d", "1", "a", "b", []), ("r", None, "2", "a", "b", [])])
    with pytest.raises(RuntimeError):
        with store.commit() as c:
            c.write_records(rec)
            raise RuntimeError("stopped")
    assert store.records().count() == 0 and store.feedbacks().count() == 0 and store.runs().count() == 0
    assert store.clean(older_than=3600) == 0 and len(files(f"{tmp_dir}/s/records")) == 2
    assert store.clean(older_than=-1) == 2 and not files(f"{tmp_dir}/s/records")
    with store.commit() as c:
        c.write_records(rec)
        c.write_runs(rec.select("recipe", "dataset", F.lit("{}").alias("metadata")))
        assert store.records().count() == 0
    assert store.records().count() == 2 and store.runs().count() == 2
    assert store.clean(older_than=-1) == 0


def test_a_run_has_one_row_that_of_its_last_commit(spark, tmp_dir):
    store = RunStore(spark, f"{tmp_dir}/s")
    for text in ("{}", '{"k": 1}', None):
        store.write_runs(spark.createDataFrame([("r", "d", text), ("r", None, text)], "recipe string, dataset string, metadata string"))
    assert sorted(tuple(r) for r in store.runs().select("recipe", "metadata").collect()) == [("r", None), ("r", None)]
    assert store.runs().count() == 2


def test_two_writers_get_entries_of_their_own(spark, tmp_dir):
    a, b = RunStore(spark, f"{tmp_dir}/s"), RunStore(spark, f"{tmp_dir}/s")
    rec = records(spark, [("r", "d", "1", "a", "b", [])])
    with a.commit() as x, b.commit() as y:
        x.write_records(rec)
        y.write_records(rec.withColumn("record_id", F.lit("2")))
    assert sorted(r["seq"] for r in a.log().collect()) == [0, 1]
    assert {r["record_id"] for r in b.records().collect()} == {"1", "2"}


def test_reset_is_one_entry_and_later_rows_show(spark, tmp_dir):
    store = RunStore(spark, f"{tmp_dir}/s")
    rec = records(spark, [("r", d, "1", "a", "b", []) for d in ("d1", "d/2", None)])
    store.write_records(rec)
    before = store.log().count()
    assert store.reset("r") == 3
    assert store.log().count() == before + 1 and store.records().count() == 0
    store.write_records(rec)
    assert store.records().count() == 3


def test_upsert_touches_only_buckets_of_new_documents(spark, tmp_dir):
    store = RunStore(spark, f"{tmp_dir}/s")
    chunks = lambda ids, t: spark.createDataFrame([(i, c, f"{t}{c}") for i in ids for c in range(2)], "doc_id long, chunk_id int, text string")
    assert store.chunks() is None
    assert store.upsert_chunks(chunks(range(200), "a"), buckets=16) == 0
    old = files(f"{tmp_dir}/s/chunks")
    assert store.upsert_chunks(chunks([3, 500], "b").limit(4)) == 1
    kept = [p for p in files(f"{tmp_dir}/s/chunks") if p in old]
    assert len(kept) == len(old)
    got = {(r["doc_id"], r["chunk_id"]): r["text"] for r in store.chunks().collect()}
    assert len(got) == 402 and got[3, 0] == "b0" and got[4, 1] == "a1" and got[500, 1] == "b1"
    touched = {p.split("bucket=")[1].split("/")[0] for p in files(f"{tmp_dir}/s/chunks") - old}
    assert 1 <= len(touched) <= 2
    assert store.clean(older_than=-1) == len(touched)  # what the second upsert replaced
    assert store.chunks().count() == 402


# ---------------------------------------------------------------- resume


@pytest.mark.parametrize("judge", [None, metrics.LexicalJudge()])
def test_a_stopped_experiment_loses_and_repeats_nothing(spark, tmp_dir, judge):
    class Echo:
        def __init__(self, k):
            self.k = k

        def invoke(self, q):
            return {"answer": f"{q} {self.k}", "contexts": [q]}

    qs = spark.createDataFrame([("d", i, f"q{i}", None) for i in range(4)] + [(None, 0, "n", "n 1")], "dataset string, pos long, query string, ground_truth string")
    recipes = [{"recipe": "a", "k": 1}, {"recipe": "b", "k": 2}]
    root = f"{tmp_dir}/s"
    run = lambda store, q: pipeline.run_experiment(q, None, recipes, store, query_fn=lambda k: Echo(k), judge=judge)
    for stop in (1, 2):
        with pytest.raises(InterruptedError):
            run(_Stopped(spark, root, stop), qs.where("pos < 2"))
    store = RunStore(spark, root)
    assert store.records().count() == 6 and store.feedbacks().count() == 0
    run(store, qs)
    run(store, qs)
    assert store.records().count() == 10 and store.feedbacks().count() == 40
    assert store.feedbacks().select("recipe", "dataset", "record_id", "name").distinct().count() == 40
    assert store.runs().count() == 4


def test_unscored_names_what_is_missing(spark):
    rec = spark.createDataFrame([("r", None, "1"), ("r", "d", "2"), ("r", "d", "3")], "recipe string, dataset string, record_id string")
    fb = feedbacks(spark, [("r", None, "1", "a", "done", 1.0, T0)] + [("r", "d", "2", m, "failed", None, T0) for m in ("a", "b")])
    got = {r["record_id"]: r["lacking"] for r in planning.unscored(rec, fb, ["b", "a"]).collect()}
    assert got == {"1": ["b"], "3": ["a", "b"]}


def test_progress_counts_feedbacks_not_rows(spark):
    work = spark.createDataFrame([("r", "d", "q1"), ("r", "d", "q2")], "recipe string, dataset string, query string")
    rec = spark.createDataFrame([("r", "d", "q1"), ("r", "d", "q2")], "recipe string, dataset string, input string")
    rows = [("r", "d", "1", m, "done", 1.0, T0) for m in metrics.METRIC_NAMES]
    out = planning.progress(work, rec, feedbacks(spark, rows + rows), stored_encoded=False).first()
    assert (out["feedbacks_done"], out["complete"]) == (4, False)


# ---------------------------------------------------------------- retry, status


def test_retry_goes_into_the_store_and_is_repeatable(spark, tmp_dir):
    store = RunStore(spark, f"{tmp_dir}/s")
    rec = records(spark, [("r", d, "1", "a b", "a", []) for d in ("d", "e", None)])
    store.write_records(rec)
    rows = []
    for d in ("d", "e", None):
        for m in metrics.METRIC_NAMES:
            bad = m == "answer_relevance" and d != "e"
            rows.append(("r", d, "1", m, "failed" if bad else "done", None if bad else 0.25, T0))
    rows.append(("r", "d", "gone", "answer_relevance", "failed", None, T0))  # its record does not exist
    rows.append(("r", "d", "1", "answer_relevance", "failed", None, T0 + dt.timedelta(minutes=5)))  # not yet due
    store.write_feedbacks(feedbacks(spark, rows))
    old = files(f"{tmp_dir}/s/feedbacks")
    now = F.lit(T0 + dt.timedelta(minutes=5)).cast("timestamp_ntz")
    scorer = lambda df: metrics.evaluate(df, last_ts=now)
    assert streaming.retry_stored(store, now, scorer) == 2
    got = sorted(((r["dataset"], r["record_id"], r["name"], r["status"], r["result"]) for r in store.feedbacks().collect()), key=str)
    assert len(got) == len(rows)
    assert ("d", "1", "answer_relevance", "done", 0.5) in got and (None, "1", "answer_relevance", "done", 0.5) in got
    assert ("d", "1", "answer_relevance", "failed", None) in got and ("d", "gone", "answer_relevance", "failed", None) in got
    assert {p for p in files(f"{tmp_dir}/s/feedbacks") if "dataset=e" in p} == {p for p in old if "dataset=e" in p}
    assert streaming.retry_stored(store, now, scorer) == 0
    assert store.feedbacks().count() == len(rows)


def test_live_status_follows_changes_over_many_triggers(spark, tmp_dir):
    rng = random.Random(3)
    store, rows = RunStore(spark, f"{tmp_dir}/s"), []
    for step in range(3):
        part = [
            (f"r{rng.randrange(2)}", rng.choice(["d", None]), str(rng.randrange(8)), rng.choice("ab"), rng.choice(["none", "running", "failed", "done"]), None, T0 + dt.timedelta(seconds=60 * rng.randrange(4) + step))
            for _ in range(40)
        ] + [("r", "d", "x", "a", None, None, None)]
        rows += part
        store.write_feedbacks(feedbacks(spark, part))
        streaming.status_stream(spark, store.path("feedbacks"), f"{tmp_dir}/out", f"{tmp_dir}/ckpt", files_per_trigger=2).awaitTermination()
    latest = {}
    for recipe, dataset, record, name, status, _, at in rows:
        key, seen = (recipe, dataset, record, name), (at or dt.datetime.min, status or "")
        latest[key] = max(latest.get(key, seen), seen)
    want = {}
    for _, status in latest.values():
        want[status or None] = want.get(status or None, 0) + 1
    assert {r["status"]: r["n"] for r in streaming.live_status(spark, f"{tmp_dir}/out").collect()} == want
    batch = stats.latest_feedback(store.feedbacks()).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in batch} == want


def test_stream_follows_commits(spark, tmp_dir):
    source, store = RunStore(spark, f"{tmp_dir}/src"), RunStore(spark, f"{tmp_dir}/dst")
    score = lambda: streaming.evaluate_stream(spark, source, store, f"{tmp_dir}/ckpt").awaitTermination()
    source.write_records(records(spark, [("r", "d", "1", "a", "a", [])]))
    with pytest.raises(RuntimeError):
        with source.commit() as c:
            c.write_records(records(spark, [("r", "d", "left", "a", "a", [])]))
            raise RuntimeError("stopped")
    score()
    assert {r["record_id"] for r in store.feedbacks().collect()} == {"1"}
    source.write_records(records(spark, [("r", None, "2", "a", "a", [])]))
    score()
    assert sorted(r["record_id"] for r in store.feedbacks().collect()) == ["1"] * 4 + ["2"] * 4


# ---------------------------------------------------------------- statistics


def chart(spark, values):
    rows = [("r", "d", str(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "recipe string, dataset string, record_id string, m double")


def box(spark, values):
    return stats.box_stats(chart(spark, values), ["m"]).first()


@pytest.mark.parametrize(
    "values",
    [
        [1e-13, 3e-13],
        [0.5, 1e27],
        [1e30, 0.1, 0.2, 0.3],
        [1e30, -1e30, 1e-13],
        [0.1] * 10,
        [-0.1, -0.2, -0.3],
        [5e-324, 5e-324, 1e-320],
        [1.7e308, 1.7e308, -1.7e308],
        [0.0, -0.0],
        [1 / 3, 2 / 3, -1e-20, 1e16],
        [float(i) * 0.1 for i in range(-50, 90)],
    ],
)
def test_mean_is_the_exact_sum_over_the_count(spark, values):
    total = sum(map(Fraction, values))
    got = box(spark, values)
    try:
        want = float(total) / len(values)
    except OverflowError:
        want = math.inf
    assert got["mean"] == want or abs(got["mean"] - want) <= 2**-52 * abs(want) or abs(want) < 1e-300
    assert (got["high"], got["low"]) == (max(values), min(values))


def test_mean_with_infinite_values(spark):
    inf = math.inf
    assert box(spark, [0.5, inf])["mean"] == inf and box(spark, [0.5, -inf, None])["mean"] == -inf
    assert math.isnan(box(spark, [inf, -inf])["mean"])
    assert box(spark, [None, math.nan])["mean"] is None
    got = box(spark, [inf, inf, 1.0])
    assert (got["median"], got["q3"], got["high"]) == (inf, inf, inf)


@pytest.mark.parametrize("outlier", [None, 1e30, -1e30])
def test_quartiles_whatever_the_outliers(spark, outlier):
    rng = random.Random(9)
    values = [rng.random() for _ in range(5000)] + [0.25] * 700 + ([outlier] if outlier else [])
    got, s = box(spark, values), sorted(values)

    def quantile(p):
        h = (len(s) - 1) * p
        a, b = s[math.floor(h)], s[math.ceil(h)]
        return a + (b - a) * (h - math.floor(h))

    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert got[name] == pytest.approx(quantile(p), rel=1e-12)


def test_ranges_have_equal_depth_with_an_outlier(spark):
    """No range holds more than a few of the distinct values, though one value spans the scale."""
    values = spark.range(20_000).select((F.col("id") / 20_000).alias("value")).unionByName(spark.createDataFrame([(1e30,)], "value double"))
    steps = [i / stats.RANGES for i in range(1, stats.RANGES)]
    cuts = values.agg(F.percentile_approx("value", steps, 4 * stats.RANGES).alias("cuts"))
    depth = values.crossJoin(F.broadcast(cuts)).groupBy(stats._range_of(F.col("value"), F.col("cuts"))).count()
    assert depth.agg(F.max("count")).first()[0] < 20_000 / stats.RANGES * 4
