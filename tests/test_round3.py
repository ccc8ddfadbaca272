"""Native recursive chunking, files Spark hides, far pages, pruned search, judges by metric."""

from __future__ import annotations

import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalflow.operators import details, frames, ingest, metrics, retrieval
from evalflow.sources import documents, questions

REC = "recipe string, dataset string, record_id string, input string, output string, contexts array<struct<page_content:string,metadata:string>>"


# ---------------------------------------------------------------- chunking


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (7, 0), (5, 5), (1, 0), (30, 7)])
def test_native_recursive_chunks_are_the_plain_ones(spark, size, overlap):
    rng = random.Random(size)
    parts = ["word", "two words", "\n", "\n\n", "\n\n\n", " ", "  ", "\t", "tab\tbed\ttext", "é漢\U0001f600", "\xa0", "x" * 30, " ", "\x1c", " end.\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(150)] + ["", " ", None, "\n\n", "a", "w " * 3000, "\tw" * 40, "a\n\n\n\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in ingest.chunk_recursive(df, size, overlap).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_id"], r["n_tokens"], r["text"]))
    for i, text in enumerate(texts):
        want = [(k, ingest.word_length(c), c) for k, c in enumerate(ingest.split_recursive(text or "", size, overlap))]
        assert got.get(i, []) == want, text


def test_recursive_chunks_by_a_length_of_ones_own(spark):
    df = spark.createDataFrame([(1, "abc def\n\nghij klm")], "doc_id long, text string")
    rows = ingest.chunk_recursive(df, 8, 0, length=len).orderBy("chunk_id").collect()
    assert [(r["n_tokens"], r["text"]) for r in rows] == [(7, "abc def"), (8, "ghij klm")]


# ---------------------------------------------------------------- sources


def test_underscore_files_are_sources_dot_files_are_not(spark, tmp_dir):
    for name in ("a.txt", "_intro.txt", ".hidden", "_b c=d.txt"):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(f"text of {name}\nend")
    os.mkdir(os.path.join(tmp_dir, "_folder"))
    rows = documents.load_documents(spark, [tmp_dir, tmp_dir + "/"]).collect()
    assert sorted(r["text"].split("\n")[0] for r in rows) == ["text of _b c=d.txt", "text of _intro.txt", "text of a.txt"]
    assert len({r["path"] for r in rows}) == 3
    assert documents.list_sources(spark, [tmp_dir]).count() == 3
    assert ingest.document_text(documents.load_documents(spark, [tmp_dir])).count() == 3


def test_two_texts_of_one_source_raise(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "doc_id string, text string")
    with pytest.raises(ValueError, match="a produced 2"):
        ingest.document_text(docs)


def test_examples_of_several_files_have_their_own_positions(spark, tmp_dir):
    for f in ("a", "b"):
        with open(os.path.join(tmp_dir, f"{f}.json"), "w") as out:
            json.dump({"examples": [{"query": f"{f}{i}", "reference_answer": "x"} for i in range(3)]}, out)
    rows = questions.load_questions_examples(spark, tmp_dir, "d").orderBy("pos").collect()
    assert [r["query"] for r in rows] == ["a0", "a1", "a2", "b0", "b1", "b2"] and len({r["pos"] for r in rows}) == 6


# ---------------------------------------------------------------- pages, selection, contexts


def test_far_pages_are_those_of_the_whole_order(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1.0, 2.0, 3.0, rng.random()])) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(5)
    order = [F.col("v").desc_nulls_last()]
    seen = []
    for page in range(0, 143):
        if page % 20 in (0, 7) or page == 142:
            near = frames.compare_page(df, None, order, page, 7, ["id"]).orderBy("row_pos").collect()
            far = frames.compare_page(df, None, order, page, 7, ["id"], top_rows=0).orderBy("row_pos").collect()
            assert near == far
            seen += [r["row_pos"] for r in far]
    assert seen[0] == 1 and seen[-1] == 1000 and frames.compare_page(df, None, order, 500, 7, ["id"], top_rows=0).count() == 0


def test_context_index_is_the_last_place_of_the_text(spark):
    ctx = lambda *t: [(x, None) for x in t]
    rec = spark.createDataFrame([("r", None, "1", "q", "o", ctx("a", "b", "a")), ("r", "d", "2", "q", "o", None)], REC)
    calls = [(None, None, t, 1.0) for t in ("a", "b", "c", None)]
    schema = "recipe string, dataset string, record_id string, name string, status string, calls array<struct<reason:string,reasons:string,context:string,score:double>>, last_ts timestamp_ntz"
    fb = spark.createDataFrame([("r", None, "1", "context_relevance", "done", calls, None), ("r", "d", "2", "context_relevance", "done", calls[:1], None)], schema)
    got = sorted((r["record_id"], r["pos"], r["context_index"]) for r in details.context_reasons(rec, fb).collect())
    assert got == [("1", 0, 2), ("1", 1, 1), ("1", 2, None), ("1", 3, None), ("2", 0, None)]
    chosen = spark.createDataFrame([("r", "2")], "recipe string, record_id string")
    assert {r["record_id"] for r in details.context_reasons(rec, fb, chosen).collect()} == {"2"}


def test_two_decimals_as_python_writes_them(spark):
    from evalflow.functions.text import format_2f

    rng = random.Random(4)
    values = [0.0, -0.0, 0.125, 0.375, 2.675, 1.005, 0.005, 0.015, 0.995, 0.9949999, 99.995, -0.001, -2.5, 1e-300, 5e-324, 2.0**53, 2.0**62 + 2048, 123456789.125, 1e15 + 0.375]
    values += [rng.choice([1, 10, 1e6, 1e12]) * rng.uniform(-1, 1) for _ in range(3000)] + [k / 1000 for k in range(-2000, 2000)] + [k / 8 for k in range(-500, 500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["t"] for r in df.select("v", format_2f(F.col("v")).alias("t")).collect()]
    assert got == [f"{v:.2f}" for v in values]
    odd = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),), (float("-inf"),)], "v double")
    assert [r[0] for r in odd.select(format_2f(F.col("v"))).collect()] == [None, None, "inf", "-inf"]


# ---------------------------------------------------------------- search


def brute_topk(queries, chunks, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit(queries) @ unit(chunks).T
    return [sorted(range(s.shape[1]), key=lambda j: (-round(s[i, j], 12), j))[:k] for i in range(len(s))]


def vectors(spark, m, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<double>")


def test_clustered_vectors_are_found_in_few_blocks(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((30, 24))
    chunks = centres[rng.integers(30, size=1500)] + 0.05 * rng.standard_normal((1500, 24))
    queries = centres[rng.integers(30, size=60)] + 0.05 * rng.standard_normal((60, 24))
    hits, met = retrieval.search(vectors(spark, queries, "query_id"), vectors(spark, chunks, "vec_id"), 4)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert [got[i] for i in range(60)] == brute_topk(queries, chunks, 4)
    assert met["first"] + met["second"] < met["all"] / 4


def test_unclustered_vectors_are_found_as_well(spark):
    rng = np.random.default_rng(9)
    chunks, queries = rng.standard_normal((400, 6)), rng.standard_normal((50, 6))
    hits, met = retrieval.search(vectors(spark, queries, "query_id"), vectors(spark, chunks, "vec_id"), 5, block_rows=16)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert [got[i] for i in range(50)] == brute_topk(queries, chunks, 5)
    assert met["first"] + met["second"] <= met["all"]


# ---------------------------------------------------------------- judges


def test_every_metric_asks_its_judge_and_equal_requests_once(spark, tmp_dir):
    def judge(score, name):
        class Fixed(metrics.Judge):
            def score_batch(self, batch):
                with open(f"{tmp_dir}/{name}", "a") as f:
                    f.writelines(f"{n}|{i}|{c!r}\n" for n, i, c in zip(batch["name"], batch["input"], batch["context"]))
                return pd.DataFrame({"score": pd.Series([score] * len(batch), dtype=object), "reason": ["r"] * len(batch)})

        return Fixed()

    ctx = [("c1", None), ("c1", None), ("c2", None)]
    rec = spark.createDataFrame([("r", d, str(i), "q", "o", ctx) for d in ("d", None) for i in range(5)], REC).repartition(3)
    config = {"groundedness": {"judge": "strict"}, "answer_relevance": {}, "context_relevance": {"judge": judge(0.75, "own")}, "answer_correctness": {"enabled": False}}
    fb = metrics.evaluate_with_judge(rec, {"default": judge(1.0, "default"), "strict": judge(0.5, "strict")}, metrics=config).collect()
    assert len(fb) == 30
    assert {(r["name"], r["result"]) for r in fb} == {("groundedness", 0.5), ("answer_relevance", 1.0), ("context_relevance", 0.75)}
    assert all(len(r["calls"]) == (3 if r["name"] == "context_relevance" else 1) for r in fb)
    calls = {name: sorted(open(f"{tmp_dir}/{name}").read().split("\n")[:-1]) for name in ("default", "strict", "own")}
    assert [len(calls[n]) for n in ("default", "strict", "own")] == [1, 1, 2]
    with pytest.raises(ValueError, match="names a judge"):
        metrics.evaluate_with_judge(rec, judge(1.0, "x"), metrics={"groundedness": {"judge": "absent"}})
