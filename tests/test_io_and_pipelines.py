"""Store, loaders, streaming, user-code pipelines, chunking and retrieval."""

import asyncio
import datetime as dt
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF
from evalflow.operators import ingest, metrics, retrieval
from evalflow.plans import pipeline, planning
from evalflow.sources import fixtures as fx
from evalflow.sources import questions as qs
from evalflow.sources.store import RunStore
from evalflow.streaming import evaluate as streaming

T0 = dt.datetime(2024, 1, 1)


# ---------------------------------------------------------------- loaders


def test_jsonl_loader_subsets_nulls_and_metadata(spark, tmp_dir):
    path = os.path.join(tmp_dir, "questions.jsonl")
    rows = [
        {"query": "q1", "answer": "a1", "question_type": "simple", "domain": "x"},
        {"query": "q2", "answer": None, "question_type": "simple", "domain": "y"},
        {"query": "q3", "answer": "a3", "question_type": "comparison", "domain": "z"},
        {"query": "q1", "answer": "a1-late", "question_type": "simple", "domain": "w"},
    ]
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    df = qs.load_questions_jsonl(spark, path, "crag", subsets=["simple"])
    got = sorted((r["query"], r["ground_truth"], json.loads(r["metadata"])["domain"]) for r in df.collect())
    assert got == [("q1", "a1", "x"), ("q1", "a1-late", "w")]
    gold = {r["query"]: r["ground_truth"] for r in qs.golden_lookup(df).collect()}
    assert gold == {"q1": "a1-late"}  # last duplicate wins
    with pytest.raises(ValueError):
        qs.load_questions_jsonl(spark, path, "crag", subsets=["nope"])


def test_examples_loader(spark, tmp_dir):
    path = os.path.join(tmp_dir, "rag_dataset.json")
    with open(path, "w") as f:
        json.dump({"examples": [{"query": "a?", "reference_answer": "A"}, {"query": "b?", "reference_answer": "B"}]}, f)
    got = [(r["pos"], r["query"], r["ground_truth"], r["metadata"]) for r in qs.load_questions_examples(spark, path, "ds").orderBy("pos").collect()]
    assert got == [(0, "a?", "A", "{}"), (1, "b?", "B", "{}")]


# ---------------------------------------------------------------- store


def test_store_write_reset_export(spark, tmp_dir):
    store = RunStore(spark, os.path.join(tmp_dir, "store"))
    rec = fx.records(spark, SF)
    store.write_records(rec)
    store.write_feedbacks(fx.feedbacks(spark, SF))
    store.write_runs(fx.runs(spark, SF))
    n_click = rec.where(F.col("recipe") == "click").count()
    assert store.records().count() == rec.count()
    removed = store.reset("click")
    assert removed == 6  # 3 datasets x (records, feedbacks)
    assert store.records().count() == rec.count() - n_click
    assert store.feedbacks().where(F.col("recipe") == "click").count() == 0
    assert store.recipes().where(F.col("recipe") == "click").count() == 0
    out = os.path.join(tmp_dir, "export")
    store.export_results(store.records().select("dataset", "record_id", "output"), out)
    assert sorted(d for d in os.listdir(out) if d.startswith("dataset=")) == ["dataset=ds0", "dataset=ds1", "dataset=ds2"]


def test_chunk_store_upsert_versions(spark, tmp_dir):
    store = RunStore(spark, os.path.join(tmp_dir, "store"))
    docs = fx.read_table(spark, SF, "documents")
    v0 = store.upsert_chunks(ingest.chunk_window(docs, 100).withColumn("size", F.lit(100)))
    de = docs.where(F.col("lang") == "de")
    v1 = store.upsert_chunks(ingest.chunk_window(de, 200).withColumn("size", F.lit(200)))
    assert (v0, v1) == (0, 1)
    cur = store.chunks()
    de_ids = {r[0] for r in de.select("doc_id").collect()}
    sizes = {(r["doc_id"] in de_ids, r["size"]) for r in cur.select("doc_id", "size").distinct().collect()}
    assert sizes == {(True, 200), (False, 100)}


# ---------------------------------------------------------------- streaming


def test_stream_matches_batch_and_replay_is_idempotent(spark, tmp_dir):
    src = RunStore(spark, os.path.join(tmp_dir, "src"))
    rec = fx.eval_records(spark, SF).drop("ground_truth", "pos")
    src.write_records(rec.select("*", *[F.lit(None).alias(c) for c in ("metadata", "n_tokens", "start_time", "end_time", "error")]))
    store = RunStore(spark, os.path.join(tmp_dir, "dst"))
    questions = fx.query_items(spark, SF)
    for i in range(2):  # second run: fresh checkpoint = full replay of the same records
        q = streaming.evaluate_stream(spark, src.path("records"), store, os.path.join(tmp_dir, f"ckpt{i}"), questions=questions)
        q.awaitTermination()
    streamed = store.feedbacks()
    batch = metrics.evaluate(rec, questions)
    key = ["recipe", "dataset", "record_id", "name"]
    assert streamed.count() == batch.count()
    diff = streamed.select(*key, F.round("result", 9).alias("r")).exceptAll(batch.select(*key, F.round("result", 9).alias("r")))
    assert diff.count() == 0


def test_retry_pending_uses_given_now(spark):
    fb = spark.createDataFrame(
        [
            ("r", "d", "1", "m", "failed", T0),
            ("r", "d", "2", "m", "failed", T0 + dt.timedelta(seconds=50)),
            ("r", "d", "3", "m", "running", T0 + dt.timedelta(seconds=20)),
            ("r", "d", "4", "m", "running", T0 + dt.timedelta(seconds=40)),
            ("r", "d", "5", "m", "done", T0),
        ],
        "recipe string, dataset string, record_id string, name string, status string, last_ts timestamp_ntz",
    )
    now = F.lit(T0 + dt.timedelta(seconds=61)).cast("timestamp_ntz")
    got = sorted(r["record_id"] for r in streaming.retry_pending(fb, now).collect())
    assert got == ["1", "3"]


# ---------------------------------------------------------------- user code


def test_bind_ingredients():
    def fn(k, chunk_size, **kwargs):
        return None

    assert pipeline.bind_ingredients(fn, {"k": 1, "chunk_size": 2, "other": 3}) == {"k": 1, "chunk_size": 2}
    with pytest.raises(ValueError):
        pipeline.bind_ingredients(fn, {"k": 1})


def test_run_pipeline_isolates_errors(spark):
    work = spark.createDataFrame(
        [("r", "d", 0, "good question"), ("r", "d", 1, "bad"), ("r", "d", 2, "another good one")],
        "recipe string, dataset string, pos long, query string",
    )

    def factory(k):
        class P:
            def invoke(self, q):
                if q == "bad":
                    raise RuntimeError("boom")
                return {"answer": " ".join(q.split()[:k]), "contexts": ["ctx " + q]}

        return P()

    out = {r["input"]: r for r in pipeline.run_pipeline(work, factory, {"k": 2}).collect()}
    assert out["good question"]["output"] == "good question"
    assert out["bad"]["output"] is None and "boom" in out["bad"]["error"]
    assert out["another good one"]["contexts"][0]["page_content"] == "ctx another good one"
    assert out["another good one"]["start_time"] <= out["another good one"]["end_time"]


def test_ingest_sources_runs_async_functions(spark, tmp_dir):
    paths = []
    for i in range(3):
        p = os.path.join(tmp_dir, f"f{i}.txt")
        open(p, "w").write("x")
        paths.append((p,))
    src = spark.createDataFrame(paths + paths, "path string")

    async def ingest_fn(file_path, chunk_size, **_):
        await asyncio.sleep(0)
        if file_path.endswith("f2.txt"):
            raise ValueError("cannot read")
        with open(file_path + f".{chunk_size}.done", "w") as f:
            f.write("ok")

    out = {r["path"]: r["error"] for r in pipeline.ingest_sources(src, ingest_fn, {"chunk_size": 100, "k": 5}).collect()}
    assert len(out) == 3  # distinct sources only
    assert out[paths[0][0]] is None and "cannot read" in out[paths[2][0]]
    assert os.path.exists(paths[0][0] + ".100.done")


# ---------------------------------------------------------------- chunking / retrieval


def test_window_chunks_cover_every_word(spark):
    docs = fx.read_table(spark, SF, "documents")
    chunks = ingest.chunk_window(docs, 100)
    step = 100 - ingest.default_overlap(100)
    # non-overlapping parts of consecutive chunks rebuild the word list
    rebuilt = chunks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("cs")
    ).select(
        "doc_id",
        F.flatten(F.transform("cs", lambda c, i: F.slice(F.split(c["text"], " "), 1, F.when(i == F.size("cs") - 1, F.lit(100)).otherwise(F.lit(step))))).alias("w"),
    )
    orig = docs.select("doc_id", ingest.words(F.col("text")).alias("o"))
    bad = rebuilt.join(orig, "doc_id").where(F.col("w") != F.col("o")).count()
    assert bad == 0
    assert chunks.where(F.col("n_words") > 100).count() == 0


def test_hashing_embedding_properties(spark):
    texts = [
        (0, "Alpha beta gamma delta"),
        (1, "delta GAMMA beta alpha alpha"),  # same token set, other order and case
        (2, ""),
        (3, None),
        (4, " ".join(f"tok{i}" for i in range(500))),
    ]
    df = spark.createDataFrame(texts, "id int, text string")
    got = {r["id"]: r["embedding"] for r in ingest.embed(df, dim=16).collect()}
    assert all(len(v) == 16 for v in got.values())
    assert got[0] == got[1]
    assert got[2] == [0.0] * 16 and got[3] == [0.0] * 16
    # every distinct token adds +1 or -1 to one bucket
    for i, n in ((0, 4), (4, 500)):
        v = np.array(got[i])
        assert np.all(v == np.round(v))
        assert np.abs(v).sum() <= n and (v.sum() - n) % 2 == 0


def test_recursive_split_respects_size():
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(37)) for i in range(9))
    parts = ingest.split_recursive(text, 50, 12)
    assert all(ingest.word_length(p) <= 50 for p in parts)
    joined = set(" ".join(parts).split())
    assert joined == set(text.split())


def test_topk_is_exact_with_ties(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(300, 8)).round(1)
    vecs[10] = vecs[11] = vecs[12]  # exact ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    got = retrieval.retrieve_topk(df.withColumnRenamed("vec_id", "query_id"), df, k=4, exclude_self=True, block_rows=100)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in got.collect()}
    f = np.array([r[1] for r in rows], dtype="float32").astype("float64")
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    sims = u @ u.T
    for q in range(300):
        order = sorted((j for j in range(300) if j != q), key=lambda j: (-round(sims[q, j], 12), j))[:4]
        assert [got[(q, r)] for r in range(1, 5)] == order


def test_topk_with_a_passage_copied_into_a_third_of_chunks(spark):
    rng = np.random.default_rng(11)
    vecs = rng.normal(size=(300, 8)).round(1)
    vecs[::3] = vecs[0]  # 100 identical chunks: every query's ties at one similarity
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    chunks = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    queries = spark.createDataFrame(rows[:40], "query_id long, embedding array<float>")
    hits = retrieval.retrieve_topk(queries, chunks, k=3)
    assert hits.groupBy("query_id").count().where("count != 3").count() == 0
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in hits.collect()}
    f = vecs.astype("float32").astype("float64")
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    sims = u[:40] @ u.T
    for q in range(40):
        order = sorted(range(300), key=lambda j: (-round(sims[q, j], 12), j))[:3]
        assert [got[(q, r)] for r in range(1, 4)] == order


def test_topk_hot_query_id_and_block_split(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(120, 6)).round(2)
    chunks = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>"
    ).repartition(5)
    # query 7 holds a third of the query rows; blocks of 10 force hash blocks and re-splits
    qrows = [(i, [float(x) for x in vecs[i]]) for i in range(60)] + [(7, [float(x) for x in vecs[7]])] * 30
    queries = spark.createDataFrame(qrows, "query_id long, embedding array<float>").repartition(3)
    got = retrieval.retrieve_topk(queries, chunks, k=3, block_rows=10)
    assert got.count() == 60 * 3
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in got.collect()}
    f = vecs.astype("float32").astype("float64")
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    sims = u[:60] @ u.T
    for q in range(60):
        order = sorted(range(120), key=lambda j: (-round(sims[q, j], 12), j))[:3]
        assert [got[(q, r)] for r in range(1, 4)] == order


def test_topk_leaves_out_unusable_vectors_and_takes_text_ids(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", None), ("d", [1.0, None]), ("e", [0.0, 0.0]), ("f", [1.0, 0.0, 0.0]), ("g", [])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = retrieval.retrieve_topk(df.withColumnRenamed("vec_id", "query_id"), df, k=3, exclude_self=True)
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in got.collect()) == [("a", "b", 1), ("b", "a", 1)]
    empty = df.limit(0)
    assert retrieval.retrieve_topk(empty.withColumnRenamed("vec_id", "query_id"), df, k=3).count() == 0
    assert retrieval.retrieve_topk(df.withColumnRenamed("vec_id", "query_id"), empty, k=3).count() == 0


# ---------------------------------------------------------------- scale properties


def test_store_filters_prune_partitions(spark, tmp_dir):
    from evalflow.operators import frames

    store = RunStore(spark, os.path.join(tmp_dir, "store"))
    store.write_records(fx.records(spark, SF))
    store.write_feedbacks(fx.feedbacks(spark, SF))
    rf = frames.run_frame(store.records(), store.feedbacks(), ["click"], "ds1", metrics=list(metrics.METRIC_NAMES))
    import re

    plan = rf._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    # both scans (records, feedbacks) prune to one recipe and one dataset directory
    assert len(scans) >= 2
    assert all(re.search(r"PartitionFilters: .*recipe#\d+ = click", p) and re.search(r"PartitionFilters: .*dataset#\d+ = ds1", p) for p in scans)
    assert [tuple(r) for r in rf.select("recipe", "dataset").distinct().collect()] == [("click", "ds1")]


def test_compare_with_hot_input_is_linear(spark):
    from evalflow.operators import frames

    rows = []
    for r in ("x", "y"):
        for i in range(600):
            inp = "hot" if i % 3 == 0 else f"q{i}"
            rows.append((r, "d", f"{r}{i}", inp, "o", "{}", 1, T0, T0))
    rec = spark.createDataFrame(
        rows,
        "recipe string, dataset string, record_id string, input string, output string, metadata string, "
        "n_tokens long, start_time timestamp_ntz, end_time timestamp_ntz",
    )
    fb = spark.createDataFrame(
        [(r[0], "d", r[2], "m", "done", 0.5, T0) for r in rows],
        "recipe string, dataset string, record_id string, name string, status string, result double, last_ts timestamp_ntz",
    )
    out = frames.compare_runs(rec, fb, ["x", "y"], "d")
    # 200 copies of the hot question per recipe align one-to-one: 600 rows, not 200 x 200
    assert out.count() == 600
    assert out.where(F.col("input") == "hot").count() == 200


def test_load_documents_excludes_hidden_and_dedupes(spark, tmp_dir):
    from evalflow.sources.documents import list_sources, load_documents

    a, b = os.path.join(tmp_dir, "a"), os.path.join(tmp_dir, "b")
    os.makedirs(a)
    os.makedirs(b)
    for folder, name, text in [(a, "one.txt", "first\nfile"), (a, ".hidden", "x"), (a, "_meta", "y"), (b, "two.md", "second")]:
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    docs = load_documents(spark, [a, b, a])  # overlapping dataset folders
    got = sorted((os.path.basename(r["path"]), r["text"]) for r in docs.collect())
    assert got == [("_meta", "y"), ("one.txt", "first\nfile"), ("two.md", "second")]
    assert sorted(os.path.basename(r[0]) for r in list_sources(spark, [a, b, a]).collect()) == ["_meta", "one.txt", "two.md"]


def test_compare_dispatch_and_metric_selection(spark):
    from evalflow.operators import stats

    chart = spark.createDataFrame([("r", "d", "1", 0.5, 1.0)], "recipe string, dataset string, record_id string, m double, latency double")
    assert stats.compare_chart(chart, ["m"], "box-plots").count() == 1
    assert stats.compare_chart(chart, ["m"], "histogram-grid").count() == 60
    with pytest.raises(ValueError):
        stats.compare_chart(chart, ["m"], "pie")
    assert metrics.select_metrics({"groundedness": {"enabled": True}, "answer_relevance": {"enabled": False}}) == ["groundedness"]
    assert metrics.select_metrics(["groundedness", "answer_correctness"]) == ["answer_correctness", "groundedness"]
    with pytest.raises(ValueError):
        metrics.select_metrics(["faithfulness"])


# ---------------------------------------------------------------- the whole chain


def test_reset_takes_names_literally(spark, tmp_dir):
    store = RunStore(spark, os.path.join(tmp_dir, "store"))
    names = ["query_pipelines/query.py_m_k_5", "*", "a[b]", "plain", "50%"]
    rec = spark.createDataFrame([(n, d, f"{n}:{d}") for n in names for d in ("d1", "d/2")], "recipe string, dataset string, record_id string")
    rest = ("input", "output", "metadata", "contexts", "n_tokens", "start_time", "end_time", "error")
    store.write_records(rec.select("*", *[F.lit(None).alias(c) for c in rest]))
    store.write_runs(rec.select("recipe", "dataset", F.lit("{}").alias("metadata")))
    for gone, n in (("query_pipelines/query.py_m_k_5", 2), ("*", 2), ("a[b]", 2), ("absent", 0), ("50%", 2)):
        assert store.reset(gone) == n
        left = {r["recipe"] for r in store.records().select("recipe").distinct().collect()}
        assert gone not in left and "plain" in left
        assert left == {r["recipe"] for r in store.recipes().collect()}
    assert {r["recipe"] for r in store.records().collect()} == {"plain"}


def test_judge_failures_stay_with_their_rows(spark):
    class Fussy(metrics.Judge):
        def score_batch(self, batch):
            if (batch["input"] == "bad").any():
                raise RuntimeError("no")
            scores = [float("nan") if i == "nan" else None if i == "none" else 1.0 for i in batch["input"]]
            return pd.DataFrame({"score": pd.Series(scores, dtype=object), "reason": ["r"] * len(batch)})

    inputs = ["bad", "nan", "none", *[f"q{i}" for i in range(40)]]
    rows = [("r", "d", str(n), i, "out", []) for n, i in enumerate(inputs)]
    schema = "recipe string, dataset string, record_id string, input string, output string, contexts array<struct<page_content:string,metadata:string>>"
    rec = spark.createDataFrame(rows, schema).coalesce(1)
    fb = metrics.evaluate_with_judge(rec, Fussy(), metrics=["answer_relevance", "context_relevance"])
    got = {(inputs[int(r["record_id"])], r["name"]): (r["status"], r["result"], len(r["calls"])) for r in fb.collect()}
    assert len(got) == 2 * len(inputs)  # a record without contexts has its row too
    assert got[("bad", "answer_relevance")][:2] == ("failed", None)
    assert got[("nan", "answer_relevance")][:2] == ("failed", None)
    assert got[("none", "answer_relevance")][:2] == ("done", None)
    assert all(got[(f"q{i}", "answer_relevance")] == ("done", 1.0, 1) for i in range(40))
    assert all(got[(i, "context_relevance")] == ("done", None, 0) for i in inputs)


def test_judge_and_native_agree_on_nulls(spark):
    schema = "recipe string, dataset string, record_id string, input string, output string, contexts array<struct<page_content:string,metadata:string>>"
    rows = [("r", "d", "1", None, "a b", None), ("r", "d", "2", "a", None, []), ("r", "d", "3", "a b", "a", [("a", None), (None, None)]), ("r", "d", "4", "", "", [("x", None)])]
    rec = spark.createDataFrame(rows, schema)
    pick = lambda fb: {(r["record_id"], r["name"]): (r["status"], r["result"]) for r in fb.collect()}
    native = pick(metrics.evaluate(rec))
    assert native == pick(metrics.evaluate_with_judge(rec, metrics.LexicalJudge()))
    assert len(native) == 16


def test_evaluate_cuts_each_text_into_tokens_once(spark):
    schema = "recipe string, dataset string, record_id string, input string, output string, contexts array<struct<page_content:string,metadata:string>>, ground_truth string"
    plan = metrics.evaluate(spark.createDataFrame([], schema))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 4


def test_experiment_tells_datasets_apart_and_uses_the_store(spark, tmp_dir):
    qs_ = spark.createDataFrame(
        [("A", 0, "red apples grow", "truth a"), ("B", 0, "blue whales swim", "truth b"), (None, 0, "green grass", None)],
        "dataset string, pos long, query string, ground_truth string",
    )
    docs = spark.createDataFrame([("/x/a.txt", "red apples grow on trees"), ("/x/b.txt", "blue whales swim in the sea")], "doc_id string, text string")
    recipes = [{"recipe": "s/1", "chunk_size": 50, "k": 1}, {"recipe": "s2", "chunk_size": 50, "k": 2}]
    store = RunStore(spark, os.path.join(tmp_dir, "store"))
    out = pipeline.run_experiment(qs_, docs, recipes, store=store)
    assert out.count() == 2 * 3 * 4
    got = {(r["recipe"], r["dataset"]): r for r in store.records().collect()}
    assert got[("s/1", "A")]["output"] == "red apples grow on trees"
    assert got[("s/1", "B")]["output"] == "blue whales swim in the sea"
    assert len(got[("s/1", "A")]["contexts"]) == 1
    n = store.records().count()
    pipeline.run_experiment(qs_, docs, recipes, store=store)
    assert store.records().count() == n  # nothing was asked twice
    assert {r["recipe"] for r in store.recipes().collect()} == {"s/1", "s2"}

    class Echo:
        def __init__(self, k):
            self.k = k

        def invoke(self, q):
            return f"{q} {self.k}"

    other = RunStore(spark, os.path.join(tmp_dir, "other"))
    pipeline.run_experiment(qs_, docs, [{"recipe": "e1", "k": 1}, {"recipe": "e2", "k": 2}], store=other, query_fn=lambda k: Echo(k), judge=metrics.LexicalJudge())
    assert {(r["recipe"], r["output"]) for r in other.records().where("dataset = 'A'").collect()} == {("e1", "red apples grow 1"), ("e2", "red apples grow 2")}


def test_questions_of_several_files_have_their_own_positions(spark, tmp_dir):
    for f in ("a", "b"):
        with open(os.path.join(tmp_dir, f"{f}.jsonl"), "w") as out:
            for i in range(3):
                out.write('{"query": "%s%d", "answer": "x", "question_type": "simple"}\n' % (f, i))
    got = qs.load_questions_jsonl(spark, tmp_dir, "d").orderBy("pos").collect()
    assert [r["query"] for r in got] == ["a0", "a1", "a2", "b0", "b1", "b2"]
    assert len({r["pos"] for r in got}) == 6


def test_sampling_keeps_the_null_group(spark):
    rows = [(None if i % 2 else "d", i) for i in range(20)]
    df = spark.createDataFrame(rows, "dataset string, pos long")
    got = planning.sample_exact(df, 0.5, seed=1).groupBy("dataset").count().collect()
    assert {r["dataset"]: r["count"] for r in got} == {None: 5, "d": 5}


def test_retry_scores_failed_rows_again(spark):
    rec = spark.createDataFrame(
        [("r", "d", "1", "a b", "a", [])],
        "recipe string, dataset string, record_id string, input string, output string, contexts array<struct<page_content:string,metadata:string>>",
    )
    fb = metrics.evaluate(rec, last_ts=F.lit(T0))
    fb = fb.withColumn("status", F.when(F.col("name") == "answer_relevance", F.lit("failed")).otherwise(F.col("status")))
    fb = fb.withColumn("result", F.when(F.col("status") == "done", F.col("result")))
    out = streaming.retry_scored(rec, fb, F.lit(T0) + F.expr("interval 5 minutes"))
    got = {r["name"]: (r["status"], r["result"]) for r in out.collect()}
    assert len(got) == 4 and got["answer_relevance"] == ("done", 0.5)


def test_many_metric_names_are_all_listed(spark):
    from evalflow.operators import frames

    fb = spark.range(2500).select(F.lit("r").alias("recipe"), F.concat(F.lit("m"), "id").alias("name"))
    assert len(frames.list_metrics(fb)) == 2500 and len(frames.recipe_metrics(fb, ["r"])["r"]) == 2500
