"""Behaviour facts of the reference (its own unit tests) and the edge cases
"""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalflow.functions.json import metadata_predicate
from evalflow.functions.ordinal import group_ordinal
from evalflow.functions.text import decode_text, encode_text, escape_markdown, format_2f, recipe_name, split_reason, tokens
from evalflow.operators import frames, stats
from evalflow.plans import planning

T0 = dt.datetime(2024, 1, 1)

# ---------------------------------------------------------------- reference unit tests

QUESTIONS = [("test", 0, "Quéry 1"), ("test", 1, "Query 2"), ("test", 2, "Query 3"), ("test", 3, "Query 4")]


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "dataset string, pos long, query string")


def _progress(spark, p, recorded):
    qs = planning.sample_exact(_questions(spark), p, seed=7)
    work = planning.work_plan(qs, ["recipe"])
    rec = spark.createDataFrame([("recipe", "test", s) for s in recorded], "recipe string, dataset string, input string")
    row = planning.progress(work, rec).collect()[0]
    return row["questions"], row["finished"], row["feedbacks"]


def test_plan_without_sample(spark):
    assert _progress(spark, 1.0, []) == (4, 0, 16)


def test_plan_half_sample(spark):
    assert _progress(spark, 0.5, []) == (2, 0, 8)


def test_resume_with_non_ascii_question(spark):
    # stored inputs are JSON string literals, non-ASCII escaped
    assert _progress(spark, 1.0, ['"Qu\\u00e9ry 1"']) == (4, 1, 16)


def test_recipe_name_from_ingredients(spark):
    df = spark.createDataFrame(
        [([("param1", "value1"), ("param2", "value2")],)], "ingredients array<struct<key:string,value:string>>"
    )
    assert df.select(recipe_name("ingredients")).first()[0] == "param1_value1_param2_value2"


def test_sample_is_exact_per_group(spark):
    rows = [("a", i, f"q{i}") for i in range(101)] + [("b", i, f"q{i}") for i in range(7)]
    df = spark.createDataFrame(rows, "dataset string, pos long, query string")
    got = {r["dataset"]: r["count"] for r in planning.sample_exact(df, 0.3, seed=1).groupBy("dataset").count().collect()}
    assert got == {"a": 30, "b": 2}
    assert planning.sample_exact(df, 0.0).count() == 108 and planning.sample_exact(df, 1.0).count() == 108


# ---------------------------------------------------------------- text helpers


def test_decode_text_edge_cases(spark):
    rows = [('"Qu\\u00e9ry 1"',), ('"Quéry raw"',), ('"a \\"quoted\\" line\\nnext"',), ('"\\ud83d\\ude00 ok"',), (None,)]
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(decode_text("s")).collect()]
    assert got == ["Quéry 1", "Quéry raw", 'a "quoted" line\nnext', "\U0001F600 ok", None]


def test_encode_decode_round_trip(spark):
    df = spark.createDataFrame([("line\n\"x\" é   end",), (None,)], "s string")
    got = [r[0] for r in df.select(decode_text(encode_text("s"))).collect()]
    assert got == ["line\n\"x\" é   end", None]


def test_split_reason(spark):
    rows = [
        ("Criteria: a b\nSupporting Evidence: c d ",),
        ("Criteria: only",),
        ("Supporting Evidence: ev",),
        ("nothing",),
        (None,),
    ]
    df = spark.createDataFrame(rows, "r string")
    got = [r[0] for r in df.select(split_reason("r")).collect()]
    assert got[0] == {"Criteria": "a b", "Supporting Evidence": "c d"}
    assert got[1] == {"Criteria": "only"}
    assert got[2] == {"Supporting Evidence": "ev"}
    assert got[3] == {}
    assert got[4] == {}  # no reason: no labels


def test_escape_markdown(spark):
    df = spark.createDataFrame([("a-b.c, (x)|*y*\nz",)], "s string")
    assert df.select(escape_markdown("s")).first()[0] == "a\\-b\\.c\\, \\(x\\)\\|\\*y\\* z"


def test_format_two_decimals_like_python(spark):
    vals = [0.125, 2.675, 1.005, 0.5, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(format_2f("v")).collect()]
    assert got == ["{:.2f}".format(v) if v is not None else None for v in vals]


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, hello WORLD! Grüße 42",), (None,)], "s string")
    got = [sorted(r[0]) for r in df.select(tokens("s")).collect()]
    assert got == [["42", "grüße", "hello", "world"], []]


# ---------------------------------------------------------------- frames


def _store(spark):
    rec = spark.createDataFrame(
        [
            ("r", "d", "1", "q1", "a1", '{"k": 5, "s": "5", "b": true}', 10, T0, T0 + dt.timedelta(seconds=1.5)),
            ("r", "d", "2", "q2", "a2", '{"k": 5.0, "s": "x", "b": false}', 20, T0, T0 + dt.timedelta(microseconds=1623456)),
            ("r", "d", "3", None, "a3", "{}", 30, T0, T0),
        ],
        "recipe string, dataset string, record_id string, input string, output string, metadata string, "
        "n_tokens long, start_time timestamp_ntz, end_time timestamp_ntz",
    )
    fb = spark.createDataFrame(
        [
            ("r", "d", "1", "m", "done", 0.2, T0),
            ("r", "d", "1", "m", "done", 0.9, T0 + dt.timedelta(seconds=5)),
            ("r", "d", "2", "m", "failed", 0.7, T0),
            ("r", "d", "2", "n", "done", -0.1, T0),
        ],
        "recipe string, dataset string, record_id string, name string, status string, result double, last_ts timestamp_ntz",
    )
    return rec, fb


def test_run_frame_keeps_records_and_latest_done(spark):
    rec, fb = _store(spark)
    rows = {r["record_id"]: r for r in frames.run_frame(rec, fb, metrics=["m", "n"]).collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["1"]["m"] == 0.9  # latest done wins
    assert rows["2"]["m"] is None  # only done counts
    assert rows["2"]["n"] == -0.1  # compare keeps negatives
    assert rows["2"]["latency"] == pytest.approx(1.623456, abs=1e-9)  # exact microseconds


def test_chart_data_nulls_negative_scores_only(spark):
    rec, fb = _store(spark)
    rows = {r["record_id"]: r for r in frames.chart_data(rec, fb, metrics=["m", "n"]).collect()}
    assert rows["2"]["n"] is None and rows["2"]["total_tokens"] == 20


def test_metadata_filter_is_typed(spark):
    rec, _ = _store(spark)

    def ids(f):
        return sorted(r[0] for r in rec.where(metadata_predicate("metadata", f)).select("record_id").collect())

    assert ids({"k": 5}) == ["1", "2"]  # 5 and 5.0 are the same number
    assert ids({"s": "5"}) == ["1"]  # string matches string only
    assert ids({"k": "5"}) == []  # a number never equals a string
    assert ids({"b": True}) == ["1"]
    assert ids({"b": 1}) == []  # a bool is not a number
    assert ids({"s": "<all>"}) == ["1", "2", "3"]


def test_compare_aligns_null_inputs_and_duplicates(spark):
    rows = []
    for r in ("x", "y"):
        for i, inp in enumerate(["q", "q", "q", None, "only_" + r]):
            rows.append((r, "d", f"{r}{i}", inp, f"out-{r}{i}", "{}", 1, T0, T0))
    rec = spark.createDataFrame(
        rows,
        "recipe string, dataset string, record_id string, input string, output string, metadata string, "
        "n_tokens long, start_time timestamp_ntz, end_time timestamp_ntz",
    )
    fb = spark.createDataFrame(
        [(r[0], "d", r[2], "m", "done", 0.5, T0) for r in rows],
        "recipe string, dataset string, record_id string, name string, status string, result double, last_ts timestamp_ntz",
    )
    cmp = frames.compare_runs(rec, fb, ["x", "y"], "d")
    out = cmp.collect()
    # 3 aligned duplicates of q, 1 null row, 2 one-sided rows: no pair multiplication
    assert len(out) == 6
    assert sum(1 for r in out if r["input"] is None) == 1
    assert cmp.columns[:4] == ["input", "ground_truth", "output_x", "output_y"]
    assert "m__diff" in cmp.columns and "latency__diff" in cmp.columns


def test_group_ordinal_dense_with_hot_key(spark):
    rows = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(5)] + [(None, i) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, v long")
    out = group_ordinal(df, ["k"], ["v"], name="o", buckets=16)
    got = {}
    for r in out.collect():
        got.setdefault(r["k"], []).append(r["o"])
    assert sorted(got["hot"]) == list(range(1, 3001))
    assert sorted(got["cold"]) == list(range(1, 6))
    assert sorted(got[None]) == list(range(1, 5))


# ---------------------------------------------------------------- statistics


def test_score_histogram_edges_match_numpy(spark):
    vals = [0.0, 0.1, 0.3, 0.6, 0.7, 0.95, 1.0, 1.2, -0.1, float("nan")]
    chart = spark.createDataFrame([("r", "d", str(i), v) for i, v in enumerate(vals)], "recipe string, dataset string, record_id string, m double")
    chart = chart.withColumn("latency", F.lit(None).cast("double"))
    h = stats.histogram(chart, ["m"], latency=False).orderBy("bin").collect()
    finite = [v for v in vals if np.isfinite(v) and v >= 0]
    want, _ = np.histogram(finite, bins=10, range=(0, 1))
    assert [r["n"] for r in h] == list(want)
    assert sum(r["percent"] for r in h) == pytest.approx(100.0)


def test_latency_histogram_has_50_bins(spark):
    vals = [0.0, 0.30612244897959184, 14.99, 15.0, 49.0]
    chart = spark.createDataFrame([("r", "d", str(i), v) for i, v in enumerate(vals)], "recipe string, dataset string, record_id string, latency double")
    h = stats.histogram(chart, [], latency=True).orderBy("bin").collect()
    assert len(h) == 50
    edges = np.concatenate([np.linspace(0, 15), [np.inf]])
    want, _ = np.histogram(vals, bins=edges)
    assert [r["n"] for r in h] == list(want)


def test_box_stats_match_pandas(spark):
    vals = [0.1, 0.4, 0.4, 0.9, None, 0.2]
    chart = spark.createDataFrame([("r", "d", str(i), v) for i, v in enumerate(vals)], "recipe string, dataset string, record_id string, m double")
    row = stats.box_stats(chart, ["m"]).first()
    s = pd.Series(vals, dtype="float64")
    assert row["q1"] == pytest.approx(s.quantile(0.25))
    assert row["median"] == pytest.approx(s.median())
    assert row["q3"] == pytest.approx(s.quantile(0.75))
    assert row["mean"] == pytest.approx(s.mean())
    assert (row["low"], row["high"]) == (0.1, 0.9)


def test_golden_set_mismatch_gives_null_ground_truth(spark):
    from evalflow.operators import metrics as met

    golden = spark.createDataFrame(
        [("test", 0, "Query 1", "Response 1"), ("test", 1, "Query 2", "Response 2")],
        "dataset string, pos long, query string, ground_truth string",
    )
    rec = spark.createDataFrame(
        [("r", "test", "1", "Quéry 1", "Response 1", []), ("r", "test", "2", "Query 2", "Response 2", [])],
        "recipe string, dataset string, record_id string, input string, output string, "
        "contexts array<struct<page_content:string,metadata:string>>",
    )
    got = {r["record_id"]: r["result"] for r in met.evaluate(rec, golden, ["answer_correctness"]).collect()}
    assert got == {"1": None, "2": 1.0}


def test_cluster_conf_sizes_shuffles_within_bounds():
    from evalflow.session import MAX_SHUFFLE_PARTITIONS, PARTITION_BYTES, cluster_conf

    assert cluster_conf(10**6)["spark.sql.shuffle.partitions"] == "200"
    one_tb = cluster_conf(2**40)
    assert int(one_tb["spark.sql.shuffle.partitions"]) == 2**40 // 4 // PARTITION_BYTES
    assert cluster_conf(100 * 2**40)["spark.sql.shuffle.partitions"] == str(MAX_SHUFFLE_PARTITIONS)
    assert one_tb["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == one_tb["spark.sql.shuffle.partitions"]
