"""Randomised checks of the distributed rewrites against their plain
definitions (small inputs, brute force in Python/NumPy)."""

import hashlib

import numpy as np
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalflow.operators import metrics, stats
from evalflow.plans import planning

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def _h(seed, pos):
    return int(hashlib.md5(f"{seed}:{pos}".encode()).hexdigest()[:15], 16)


@SETTINGS
@given(
    sizes=st.lists(st.integers(min_value=0, max_value=60), min_size=1, max_size=4),
    p=st.floats(min_value=0.01, max_value=0.99),
    seed=st.integers(min_value=0, max_value=10**6),
)
def test_sample_exact_equals_window_definition(spark, sizes, p, seed):
    rows = [(f"d{g}", pos, f"q{pos}") for g, n in enumerate(sizes) for pos in range(n)]
    df = spark.createDataFrame(rows, "dataset string, pos long, query string")
    got = sorted((r["dataset"], r["pos"]) for r in planning.sample_exact(df, p, seed=seed).collect())
    want = []
    for g, n in enumerate(sizes):
        k = int(np.floor(p * n))
        order = sorted(range(n), key=lambda pos: (_h(seed, pos), pos))
        want += [(f"d{g}", pos) for pos in order[:k]]
    assert got == sorted(want)


@SETTINGS
@given(vals=st.lists(st.sampled_from([i / 100 for i in range(-10, 121)]) | st.floats(min_value=-1, max_value=2, allow_nan=False), min_size=1, max_size=80))
def test_score_histogram_equals_numpy(spark, vals):
    chart = spark.createDataFrame([("r", "d", str(i), float(v)) for i, v in enumerate(vals)], "recipe string, dataset string, record_id string, m double")
    h = [r["n"] for r in stats.histogram(chart, ["m"], latency=False).orderBy("bin").collect()]
    ok = [v for v in vals if 0 <= v]
    want, _ = np.histogram(ok, bins=10, range=(0, 1))
    assert h == list(want)


WORD = regex.compile(r"[^\p{L}\p{N}]+")


def _t(s):
    return {w for w in WORD.split(s.lower()) if w} if s is not None else set()


@SETTINGS
@given(
    texts=st.lists(
        st.tuples(
            st.text(alphabet="abcé ÄÖ12,.!\n", max_size=30),
            st.one_of(st.none(), st.text(alphabet="abcé ÄÖ12,.!\n", max_size=30)),
            st.lists(st.text(alphabet="abcé ÄÖ12,.!", max_size=20), min_size=1, max_size=3),
        ),
        min_size=1,
        max_size=10,
    )
)
def test_lexical_metrics_equal_python(spark, texts):
    rows = [
        ("r", "d", str(i), q, a, [(c, None) for c in ctx], a)
        for i, (q, a, ctx) in enumerate(texts)
    ]
    df = spark.createDataFrame(
        rows,
        "recipe string, dataset string, record_id string, input string, output string, "
        "contexts array<struct<page_content:string,metadata:string>>, ground_truth string",
    )
    got = {(r["record_id"], r["name"]): r["result"] for r in metrics.evaluate(df).collect()}
    for i, (q, a, ctx) in enumerate(texts):
        tq, ta = _t(q), _t(a)
        tc = [_t(c) for c in ctx]
        union = set().union(*tc)
        want = {
            "answer_relevance": len(tq & ta) / len(tq) if tq else None,
            "groundedness": len(ta & union) / len(ta) if ta else None,
            "context_relevance": (sum(len(tq & c) / len(tq) for c in tc) / len(tc)) if tq else None,
            "answer_correctness": (2.0 * len(ta & ta) / (2 * len(ta))) if (a is not None and ta) else None,
        }
        for name, w in want.items():
            g = got[(str(i), name)]
            assert (g is None and w is None) or abs(g - w) < 1e-12, (name, q, a, ctx, g, w)


def test_box_stats_against_numpy(spark):
    rng = np.random.default_rng(5)
    hot = rng.exponential(3.0, size=20000).round(4)  # a hot group with ties and a long tail
    rows = [("hot", "d", float(x)) for x in hot] + [("cold", "d", float(x)) for x in rng.normal(size=50)]
    rows += [("one", "d", 1.5), ("hot", None, 2.0), ("hot", None, None), ("cold", None, float("nan"))]
    rows += [("wide", "d", x) for x in (-1e9, 0.0, 0.0, 1e-9, 1e9)]
    df = spark.createDataFrame(rows, "recipe string, dataset string, m double").withColumn("record_id", F.lit("x")).repartition(6)
    got = {(r["recipe"], r["dataset"]): r for r in stats.box_stats(df, ["m"]).collect()}
    assert len(got) == 4 * 2  # combinations without values are there, with nulls
    for key, r in got.items():
        vals = np.array([v for a, b, v in rows if (a, b) == key and v is not None and v == v])
        names = ("low", "q1", "median", "q3", "high", "mean")
        if not len(vals):
            assert all(r[c] is None for c in names), key
            continue
        want = [vals.min(), *np.quantile(vals, [0.25, 0.5, 0.75]), vals.max(), vals.mean()]
        assert np.allclose([r[c] for c in names], want, rtol=1e-12, atol=1e-9), (key, r, want)


@settings(max_examples=50, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 4), st.integers(0, 30), st.sampled_from([0.1, 0.5, 0.5, 0.9, -0.2])),
        max_size=80,
    ),
    st.integers(1, 5),
)
def test_first_k_matches_sorting(cands, k):
    from evalflow.operators.retrieval import _first_k

    r = np.array([x[0] for x in cands], dtype="int64")
    c = np.array([x[1] for x in cands], dtype="int64")
    s = np.array([x[2] for x in cands], dtype="float64")
    gr, gc, gs = _first_k(r, c, s, k)
    got = sorted(zip(gr.tolist(), gc.tolist(), gs.tolist()))
    want = []
    for q in set(r.tolist()):
        mine = sorted(((sv, cv) for rv, cv, sv in cands if rv == q), key=lambda t: (-t[0], t[1]))[:k]
        want += [(q, cv, sv) for sv, cv in mine]
    assert got == sorted(want)
