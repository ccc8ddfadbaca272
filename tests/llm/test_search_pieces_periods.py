"""Ranked search, pieces and periodic runs against brute force, the library and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalflow.llm import periods, pieces, ranked
from evalflow.llm.queries import ORACLE, QUERIES, vocabulary_path
from tests.conftest import SF

DOCS = "doc_id long, text string"
ODD = [None, "", " \n\t", "one", "ünï 漢字 \U0001f600 ▁▁ x", "x" * 30_000, "tie tie tie", "tie tie tie", "NUL\x00 \x01\x1f nbsp\xa0\x85 end"]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    clash = ("n", "term", "runs", "ids", "decoded", "shard", "row_key", "rank", "score", "period", "low", "tile")
    return df.withColumns({c: F.lit(7) for c in clash}) if extra else df


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# op11


def terms(text):
    low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(documents, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in documents]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for (i, bag), n in zip(bags, sizes):
            s = 0
            for t, times in Counter(terms(text)).items():
                if t in bag:
                    m = 100 - 75 + (75 * n * n_docs) // n_terms
                    s += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def found_rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_ranked_search_small_shards(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(700)]
    rows += [(900 + i, t) for i, t in enumerate(ODD)] + [(3, rows[3][1]), (None, "tie w1"), (None, None)]
    rows += [(2000 + i, "tie W1 w2") for i in range(40)]  # ties
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(30)]
    items += [(100, "tie"), (101, None), (102, ""), (103, "neverseen"), (100, "tie"), (104, "ÜNÏ ünï 漢字 one ONE"), (104, "w1 w1 w1")]
    index = ranked.build_index(frame(spark, rows, extra=True), shard_rows=100, block=4)
    assert index.shards.count() >= 8
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    assert found_rows(ranked.search(index, asked)) == brute_search(rows, items)


@pytest.mark.parametrize("seed", range(3))
def test_windows_and_block_maxima(seed, monkeypatch):
    """Many windows: equal to full scoring, and blocks of non-essential lists stay undecoded."""
    monkeypatch.setattr(ranked, "WINDOWS", (64, 256))
    rng = np.random.default_rng(seed)
    n_rows, block = 6000, 16
    lists, total = [], np.zeros(n_rows, np.int64)
    for share, weight, times in ((0.6, 40, 1), (0.4, 90, 2), (0.05, 1500, 1), (0.01, 3000, 1), (0.004, 5000, 1)):
        d = np.flatnonzero(rng.random(n_rows) < share)
        s = (rng.pareto(3, len(d)) * 1000 + 1).astype(np.int64).clip(1, 1 << 20)
        opens = np.arange(0, len(d), block)
        gap = np.diff(d, prepend=0)
        gap[opens] = d[opens]
        raw = b"".join(int(a).to_bytes(2, "little") + int(b).to_bytes(3, "little") for a, b in zip(gap, s))
        lists.append((ranked.Postings(weight, d[np.append(opens[1:], len(d)) - 1], np.maximum.reduceat(s, opens), raw, len(d), block), times))
        total[d] += s * weight * times
    docs, scores = ranked.best_of(lists, n_rows, 10)
    want = sorted(range(n_rows), key=lambda i: (-total[i], i))[:10]
    assert docs.tolist() == want and scores.tolist() == [total[i] for i in want]
    common = lists[0][0]
    assert common.decoded < len(common.lasts)


def test_ranked_search_empty(spark):
    index = ranked.build_index(frame(spark, []))
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert (index.n_documents, index.n_terms) == (0, 0)
    assert ranked.search(index, items).collect() == []
    index = ranked.build_index(frame(spark, [(1, "a b"), (2, "b c")]))
    assert ranked.search(index, items.where("item_id < 0")).collect() == []
    assert found_rows(ranked.search(index, items)) == brute_search([(1, "a b"), (2, "b c")], [(1, "a b")])


def test_op11_brute(spark):
    documents = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert found_rows(QUERIES["op11_ranked_search"](spark, SF)) == brute_search(documents, items)
    assert "op11_ranked_search" in ORACLE


# op12


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def test_op12_library(spark, library):
    texts = dict(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_pieces"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    want = {}
    for i, t in texts.items():
        ids = library.encode(t or "")
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert found == want


def test_pieces_odd_texts(spark, library):
    rng = random.Random(2)
    alphabet = ["the", "ing", " ", "tion", "▁", "  ", "\n", "é", "漢", "\x00", "<0x0A>", "<s>", "</s>", "<unk>", "\U0001f600", "aaaa", "=" * 9, " " * 17, "\t"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(800)] + ["ab" * 40_000, " " * 30_001, "".join(map(chr, range(1, 0xD800, 7)))]
    df = frame(spark, list(enumerate(texts)), extra=True)
    path = vocabulary_path("piece_bpe_32k.model")
    coded = pieces.encode(df, path)
    assert coded.columns[-3:] == ["n_tokens", "ids", "decoded"] and coded.columns.count("ids") == 1
    rows = {r["doc_id"]: r for r in coded.collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert (rows[i]["ids"], rows[i]["n_tokens"], rows[i]["decoded"]) == (ids, len(ids), library.decode(ids)), t
    again = pieces.decode(coded.drop("decoded"), path).select("doc_id", "decoded").collect()
    assert all(r["decoded"] == rows[r["doc_id"]]["decoded"] for r in again)
    assert pieces.encode(df.where("doc_id < 0"), path).collect() == []
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], DOCS)
    assert pieces.encode(twice, path).count() == 3


def test_pieces_bounded_memory(library):
    """What is remembered stays in bounds and does not change results."""
    tables = pieces.pieces(vocabulary_path("piece_bpe_32k.model"))
    small = pieces.Encoder(tables, cache_bytes=20_000)
    rng = random.Random(4)
    for _ in range(300):
        text = " ".join("".join(rng.choices("abcdeinorst", k=rng.randrange(1, 12))) for _ in range(20))
        assert small.encode(text)[1] == ",".join(map(str, library.encode(text)))
        assert len(small.pairs) * pieces.PAIR_BYTES <= 20_000 + pieces.PAIR_BYTES and len(small.parts) * 400 <= 21_000


def test_pieces_decode_any_ids(library):
    tables = pieces.pieces(vocabulary_path("piece_bpe_32k.model"))
    rng = random.Random(6)
    for _ in range(1500):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(262) for _ in range(rng.randrange(9))]
        assert pieces.decode_ids(tables, ids) == library.decode(ids), ids


# op13


def brute_runs(w, least=12):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                out.setdefault((s, i - s + q), q)
    return sorted((s, q, length) for (s, length), q in out.items())


def brute_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + length for s, q, length in runs)]
    best = max(runs, key=lambda r: (r[2], -r[0], -r[1]), default=None)
    head = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (len(runs), *head, sha("".join(f"{s},{length},{q}\n" for s, q, length in runs)), sha(" ".join(kept)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op13_brute(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows if len((r["text"] or "").split()) < 1500]  # the brute force is quadratic
    small = {r["doc_id"]: brute_digest(r["doc_id"], r["text"]) for r in rows}
    found = QUERIES["op13_periodic_runs"](spark, SF).select(*COLUMNS).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert {r["doc_id"]: tuple(r)[1:] for r in found if r["doc_id"] in small} == small
    assert any(r["n_runs"] for r in found)


def random_words(rng, n):
    w = [str(rng.randrange(rng.choice([1, 2, 3, 30]))) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 4:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            for i in range(a + p, min(n, a + p + rng.randrange(n - a + 1))):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("dealt", [1, 8, 4096])
def test_runs_dealt_tiles(spark, dealt):
    """Runs found in place, and stitched from tiles that other tasks solve."""
    rng = random.Random(dealt)
    texts = [" ".join(random_words(rng, rng.randrange(260))) for _ in range(60)] + ODD
    texts += ["a " * 900, " ".join(str(i % 37) for i in range(700)), " ".join(str(i) for i in range(500)), "a b\n" * 6 + "c"]
    rows = list(enumerate(texts)) + [(None, "z " * 12), (None, "z " * 12), (None, None), (5, texts[5]), (5, "y " * 20)]
    found = periods.collapse(frame(spark, rows, extra=True), dealt=dealt).collect()
    got = sorted(((r["doc_id"], r["collapsed"], [(x["start"], x["period"], x["length"]) for x in r["runs"]]) for r in found), key=str)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(w)
        want.append((i, " ".join(x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, q, n in runs)), runs))
    assert got == sorted(want, key=str)


def test_runs_shorter_least():
    rng = random.Random(8)
    for _ in range(400):
        w = random_words(rng, rng.randrange(120))
        least = rng.choice([2, 3, 5, 12, 20])
        parts, tiles = periods.fragments(periods.coded([x.encode() for x in w]), least, 1 << 20)
        ends = {}
        for p, a, b in sorted(parts):
            if b - a >= max(p, least - p):
                ends.setdefault((a, b - a + p), p)
        assert not tiles
        assert {(s, q, n) for (s, n), q in ends.items()} >= set(brute_runs(w, least)), (least, w)


def test_runs_empty_table(spark):
    assert periods.collapse(frame(spark, [])).collect() == []
