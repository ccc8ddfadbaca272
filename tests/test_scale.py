"""Steps that must not grow faster than their input."""

import datetime as dt
import re
import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from evalflow.functions.text import tokens
from evalflow.operators import ingest, metrics, retrieval
from evalflow.sources.store import FEEDBACKS, RECORDS, RunStore
from evalflow.streaming import evaluate as streaming


def test_live_status_is_kept_by_spark_on_disk(spark, tmp_dir):
    store, t0 = RunStore(spark, f"{tmp_dir}/s"), dt.datetime(2024, 1, 1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for step, status in enumerate(("running", "done")):
        rows = [(str(i), "m", status, None, None, t0 + dt.timedelta(seconds=step), "d", "r") for i in range(0, 300, step + 1)]
        store.write_feedbacks(spark.createDataFrame(rows, FEEDBACKS))
        query = streaming.status_stream(spark, store.path("feedbacks"), f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
        query.awaitTermination()
        # no Python call for each record; state is not held in the executors' heaps
        state = query.lastProgress["stateOperators"][0]
        assert state["operatorName"] == "stateStoreSave"
        assert any(name.startswith("rocksdb") for name in state["customMetrics"])
    assert {r["status"]: r["n"] for r in streaming.live_status(spark, f"{tmp_dir}/out").collect()} == {"running": 150, "done": 150}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_places_of_many_queries_take_little_memory():
    rng = np.random.default_rng(1)
    centres = {4: retrieval._unit_rows(rng.standard_normal((1024, 4)))}
    rows = [{"dim": 4, "cluster": i, "low": 0.5, "n": 1 + i % 7 * 20} for i in range(1024)]
    bounds = retrieval._Bounds(rows, centres, 100)
    chosen = rng.random((512, 1024)) < 0.9
    tracemalloc.start()
    places = bounds.places(4, chosen)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(places) == 512 and peak < 40e6


def test_shards_hold_whole_clusters_or_blocks_of_one():
    rows = [{"dim": 2, "cluster": i, "low": 0.9, "n": n} for i, n in enumerate((3, 250, 40, 60, 1, 100, 101))]
    angle = np.arange(7) / 3
    bounds = retrieval._Bounds(rows, {2: np.c_[np.cos(angle), np.sin(angle)]}, 100)
    table = {cluster: (first, blocks) for _, cluster, first, blocks in bounds.table()}
    held: dict[int, int] = {}
    for r in rows:
        first, blocks = table[r["cluster"]]
        assert blocks == -(-r["n"] // 100)
        for shard in range(first, first + blocks):
            held[shard] = held.get(shard, 0) + r["n"] / blocks
    assert sorted(held) == list(range(bounds.shards)) and max(held.values()) <= 100
    chosen = np.zeros((2, 7), bool)
    chosen[1] = True
    nothing, every = bounds.places(2, chosen).to_pylist()
    assert nothing == [] and sorted((p["shard"], c) for p in every for c in p["clusters"]) == sorted(
        (shard, c) for c, (first, blocks) in table.items() for shard in range(first, first + blocks)
    )
    assert len({p["shard"] for p in every}) == len(every)


def test_recursive_chunks_of_a_long_text_take_time_by_its_length(spark):
    def seconds(n):
        words = [f"w{i}" for i in range(n)]
        docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
        began = time.monotonic()
        rows = ingest.chunk_recursive(docs, 100).selectExpr("count(*)", "max(n_tokens)", "max_by(text, chunk_id)").first()
        spent = time.monotonic() - began
        assert rows[:2] == (1 + -(-(n - 100) // 75), 100) and rows[2].endswith(f" w{n - 1}")
        return spent

    seconds(1_000)
    # ten times the words; going through all of them for every chunk would take a hundred times as long
    assert seconds(100_000) < 25 * max(seconds(10_000), 0.4)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = ingest.chunk_recursive(docs, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"slice\([^,()]+, \(", plan)


def test_recursive_chunks_by_blanks_and_separators(spark):
    texts = ["a\tb c d  e\n\nf", " \n\n ", "x " * 130, "p\tq " * 90, "\n".join(["l m"] * 80) + "\n\n" + "t\x1fu" * 60, "v " * 120, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((100, 25), (7, 2), (1, 0)):
        got = {}
        for r in ingest.chunk_recursive(docs, size, overlap).orderBy("doc_id", "chunk_id").collect():
            got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["text"]))
        for i, text in enumerate(texts):
            assert got.get(i, []) == [(ingest.word_length(c), c) for c in ingest.split_recursive(text or "", size, overlap)]


def test_retry_shuffles_only_what_is_due(spark, tmp_dir):
    store, t0 = RunStore(spark, f"{tmp_dir}/s"), dt.datetime(2024, 1, 1)
    status = lambda i: "failed" if i % 10 == 0 else "done"
    records = [(str(i), "q", "q", None, [("q", None)], None, None, None, None, "d", "r") for i in range(200)]
    rows = [(str(i), "answer_relevance", status(i), None, None, t0, "d", "r") for i in range(200)]
    with store.commit() as commit:
        commit.write_records(spark.createDataFrame(records, RECORDS))
        commit.write_feedbacks(spark.createDataFrame(rows, FEEDBACKS))
    packed = []

    class Watched(RunStore):
        def replace_feedbacks(self, df, *rest):
            packed.append(df.count())
            super().replace_feedbacks(df, *rest)

    now = F.lit(t0 + dt.timedelta(hours=1)).cast("timestamp_ntz")
    scorer = lambda df: metrics.evaluate(df, last_ts=now)
    assert streaming.retry_stored(Watched(spark, f"{tmp_dir}/s"), now, scorer) == 1
    assert packed == [20]  # of 200 rows, those dealt to the partition's files anew
    got = {r["record_id"]: (r["status"], r["result"]) for r in store.feedbacks().collect()}
    assert got == {str(i): ("done", 1.0 if i % 10 == 0 else None) for i in range(200)}
    assert store.feedbacks().count() == 200


def test_words_of_a_batch_are_hashed_once(spark):
    texts = ["Alpha beta-GAMMA 12", "  alpha\tBETA ", "ÉTÉ alpha ½", "", None, "--", "Straße alpha"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    plan = ingest.embed(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "array_distinct" not in plan  # not word by word in the JVM
    hashed = lambda w: F.conv(F.substring(F.md5(w), 1, 15), 16, 10).cast("long")
    rows = ingest.embed(df, dim=16).select("embedding", F.transform(tokens("text"), hashed).alias("h")).collect()
    for r in rows:
        want = np.zeros(16)
        for h in r["h"]:
            want[h % 16] += 1 - 2 * (h >> 32 & 1)
        assert r["embedding"] == want.tolist()


def test_tiles_multiply_in_single_precision_and_rank_in_double():
    rng = np.random.default_rng(2)
    q, c = (retrieval._unit_rows(rng.integers(-3, 4, (n, 16)).astype(float) + 1e-9 * rng.random((n, 16))) for n in (70, 900))
    c[450:] = c[:450] * (1 + 1e-16)  # ties and near ties, which single precision cannot tell apart
    c[300:450] = retrieval._unit_rows(c[:150] + 1e-9 * rng.random((150, 16)))
    wanted, cluster = rng.random((70, 9)) < 0.8, np.repeat(np.arange(9), 100)
    same, place = np.where(np.arange(900) < 70, np.arange(900), -1), rng.permutation(900)
    exact = np.array([np.einsum("ij,ij->i", np.repeat(q[i : i + 1], 900, axis=0), c) for i in range(70)])
    for least in (np.full(70, -np.inf), np.sort(exact, axis=1)[:, -40]):
        runs = iter([(a, min(a + 128, 900)) for a in range(0, 900, 128)])
        r, at, s = retrieval._tile_topk(q, c, c.astype("float32"), wanted, cluster, runs, same, place, least, 4)
        got = list(zip(r.tolist(), at.tolist(), s.tolist()))
        want = []
        for i in range(70):
            mine = [(-exact[i, j], place[j]) for j in range(900) if wanted[i, cluster[j]] and same[j] != i and exact[i, j] >= least[i]]
            want += [(i, p, -x) for x, p in sorted(mine)[:4]]
        assert got == want


def test_a_shard_is_copied_for_the_queries_that_go_there(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = 5 * rng.standard_normal((6, 8))
    chunks, queries = (centres[np.arange(n) % 6] + 0.01 * rng.standard_normal((n, 8)) for n in (240, 60))
    frames = [
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, embedding array<float>")
        for m, name in ((queries, "query_id"), (chunks, "vec_id"))
    ]
    written = {}
    keep = retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, name, **more: written.setdefault(name, keep(df, name, **more)))
    hits, _ = retrieval.search(*frames, 3, block_rows=30)
    # ten queries go to each cluster, so no shard needs a second block of them
    assert {r["blocks"] for r in written["retrieval-first-blocks"].collect()} == {1}
    unit = lambda m: retrieval._unit_rows(m.astype("float32").astype("float64"))
    best = np.argsort(-(unit(queries) @ unit(chunks).T), axis=1)[:, 0]
    assert [r["vec_id"] for r in hits.where("rank = 1").orderBy("query_id").collect()] == best.tolist()
