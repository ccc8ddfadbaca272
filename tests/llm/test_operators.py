"""The numbered operators against brute-force versions, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalflow.llm import bpe, chat, contamination, lines, projections, quality, secret_scan, shingle_join, suffix, toxicity
from evalflow.llm.queries import ORACLE, QUERIES, vocabulary_path
from evalflow.llm.shared import components

DOCS = "doc_id long, text string"
ODD = [None, "", " \n\t", "one", "ünï 漢字 \U0001f600", "x" * 50_000, "tie tie tie", "tie tie tie"]


def docs(spark, texts, extra=False):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    # columns whose names clash with those that operators use inside
    return df.withColumns({c: F.lit(7) for c in ("n", "a", "k", "key", "score", "found", "ids", "label", "sig")}) if extra else df


def rooted(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(300, 380)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    want = rooted(400, edges)
    assert found == {x: want[x] for e in edges if e[0] != e[1] for x in e}


# op1


def brute_links(rows):
    groups, n, edges = defaultdict(list), [0] * len(rows), []
    for i, (_, e, label) in enumerate(rows):
        if label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e):
            groups[label, len(e)].append(i)
    for g in groups.values():
        x = np.array([rows[i][1] for i in g], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1))):
            n[g[a]] += 1
            n[g[b]] += 1
            edges.append((g[a], g[b]))
    root = rooted(len(rows), edges)
    return [(i, n[i], root[i], root[i] == i) for i in range(len(rows))]


def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    rows = []
    for i in range(200):
        v = base[rng.integers(30)] + rng.standard_normal(16) * rng.choice([0.0, 0.2, 0.3])
        rows.append((i, [float(x) for x in v], int(rng.integers(2))))
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [float("inf")] * 16]
    rows += [(200 + i, e, 0) for i, e in enumerate(odd)] + [(207, rows[0][1], None), (208, rows[0][1], rows[0][2]), (209, [2 * x for x in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1))
    found = sorted(tuple(r) for r in projections.near_duplicates(df).collect())
    assert found == brute_links(rows)
    assert projections.near_duplicates(df.limit(0)).count() == 0


# op2, op7


@pytest.mark.parametrize(("model", "train", "score"), [(toxicity, toxicity.train, toxicity.score_column), (quality, quality.fit, quality.score_column)])
def test_classifiers_learn(spark, model, train, score):
    import pyarrow as pa

    rng = random.Random(3)
    words = ["".join(rng.choices("aeiounst", k=5)) for _ in range(200)]
    marked = lambda y: " ".join([*rng.choices(words, k=rng.randint(5, 60)), *(["grumble!!"] if y else []), *rng.choices(words, k=20)])
    y = np.array([i % 2 for i in range(1000)])
    texts = [marked(v) for v in y]
    fitted = train(texts[:800], y[:800])
    found = score(fitted, pa.array(texts[800:]))
    assert ((found >= 0.5) == y[800:]).mean() >= 0.95
    odd = model.score(docs(spark, ODD, extra=True), fitted).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in odd if r["text"] in (None, "")}) == 1
    alone = train(["a", "b"], np.array([1, 1]))
    assert set(score(alone, pa.array(["a", None, ""]))) == {0.5}
    assert model.score(docs(spark, ["a"]).limit(0), fitted).count() == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op7_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    found = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    out = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert np.mean([r["predicted"] == r[label] for r in out]) >= least


# op3


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_groups(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    near = lambda x, y: x and y and 100 * len(x & y) >= percent * len(x | y)
    root = rooted(len(texts), [(i, j) for j in range(len(sets)) for i in range(j) if near(sets[i], sets[j])])
    return [(i, len(sets[i]), root[i]) for i in range(len(texts))]


def edited(rng, words, vocabulary, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        words[i : i + rng.choice([0, 1])] = [rng.choice(vocabulary)]
    return " ".join(words)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_shingle_join(spark, k, percent):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [*ODD, "One TWO three", "one two THREE"]
    for size in (5, 7, 9, 12, 16, 25, 60, 200):
        for copies in (1, 3, 30):
            base = rng.choices(vocabulary, k=size)
            texts += [edited(rng, base, vocabulary, rng.randint(0, 1 + size // 20)) for _ in range(copies)]
    passage = rng.choices(vocabulary, k=40)
    texts += [" ".join([*rng.choices(vocabulary, k=rng.randint(0, 30)), *passage, *rng.choices(vocabulary, k=rng.randint(0, 30))]) for _ in range(60)]
    found = shingle_join.similar_groups(docs(spark, texts, extra=True), k, percent)
    assert sorted(tuple(r) for r in found.collect()) == brute_groups(texts, k, percent)


def test_shingle_join_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, "lone"), (3, "a b c d e")], DOCS)
    found = Counter(tuple(r) for r in shingle_join.similar_groups(df).collect())
    assert found == {(None, 2, 3): 1, (3, 2, 3): 2, (None, 1, None): 1}
    assert shingle_join.similar_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 512), (5, 80, 7)])
def test_shingle_links(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [*ODD, "One TWO three", "one two THREE"]
    for size, copies in ((9, 5), (25, 20), (60, 60), (200, 8)):
        base = rng.choices(vocabulary, k=size)
        texts += [edited(rng, base, vocabulary, rng.randint(0, 1 + size // 30)) for _ in range(copies)]
    texts += texts[20:40] + rng.choices(texts[40:], k=30)
    sets = [shingles(t, k) for t in texts]
    near = lambda x, y: x and y and 100 * len(x & y) >= percent * len(x | y)
    n_links = [sum(bool(near(x, y)) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]
    # links that do not join components are in it too
    assert sum(n_links) / 2 > 3 * len(texts)
    found = sorted(tuple(r) for r in shingle_join.linked_groups(docs(spark, texts, extra=True), k, percent).collect())
    assert found == [(*g, n) for g, n in zip(brute_groups(texts, k, percent), n_links)]


def test_shingle_links_odd_rows(spark):
    words = [f"w{i}" for i in range(40)]
    near = " ".join([*words, "end"])
    rows = [(None, " ".join(words)), (3, " ".join(words)), (3, " ".join(words)), (3, near), (5, near), (None, "lone"), (7, None)]
    found = Counter(tuple(r) for r in shingle_join.linked_groups(spark.createDataFrame(rows, DOCS)).collect())
    # 3 has two texts: each links with the other and with 5
    assert found == {(None, 37, 3, 3): 1, (3, 37, 3, 2): 2, (3, 38, 3, 2): 1, (5, 38, 3, 2): 1, (None, 1, None, 0): 1, (7, 0, 7, 0): 1}
    assert shingle_join.linked_groups(spark.createDataFrame([], DOCS)).count() == 0


# op4


def test_lines(spark):
    pages = [("h", "menu\nbody 1\n\nmenu "), ("h", "menu\r\nbody 2"), ("h", "menu\nbody 3"), ("h", "body 4"), ("g", "menu\nother"), (None, None), (None, ""), ("h", "body 5")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, site string, text string").withColumn("host", F.lit("x"))
    found = {r["page_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_boilerplate(df, F.col("site"), max_ratio=0.5, min_pages=3).collect()}
    assert found[0] == ("body 1\n", 3, 2) and found[1] == ("body 2", 2, 1) and found[4] == ("menu\nother", 2, 0)
    assert found[5] == (None, 0, 0) and found[6] == ("", 0, 0) and len(found) == len(pages)
    assert lines.drop_boilerplate(df.limit(0), F.col("site")).count() == 0


# op5


def brute_spans(texts, window):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                cover[i : i + window] = b"\1" * window
        spans = [m.span() for m in re.finditer(b"\1+", bytes(cover))]
        out.append((len(b), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "anchor"), [(40, 20), (24, 10)])
def test_suffixes(spark, window, anchor):
    rng = random.Random(window)
    shared = ["".join(rng.choices("abcdé \n", k=200)) for _ in range(8)]
    twice = "".join(rng.choices("ABCDE", k=150))
    texts = [None, "", "short", twice + "-" + twice, "q" + twice[30:110], "abab" * 40, "aaaa" * 30, "z" * window, "z" * (window + 1)]
    for _ in range(80):
        text = "".join(rng.choices("abcdé ", k=rng.randint(0, 80)))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(shared)[rng.randrange(150) :][: rng.randint(1, 120)] + rng.choice("xyz")
        texts.append(text)
    texts += texts[10:16]
    found = suffix.repeated_spans(docs(spark, texts, extra=True), window, anchor)
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    assert [(r["n_bytes"], [tuple(s) for s in r["spans"]], r["kept_sha256"]) for r in rows] == brute_spans(texts, window)
    kept = suffix.remove_spans(docs(spark, texts).join(found, "doc_id")).collect()
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in kept)
    assert suffix.repeated_spans(docs(spark, ["a"]).limit(0), window, anchor).count() == 0


# op6


def test_preference(spark):
    turn = lambda role, text: {"role": role, "text": text}
    rows = [
        (1, [turn("user", "q"), turn("assistant", "good")], [turn("user", "q"), turn("assistant", "bad"), turn("user", "x")]),
        (2, [turn("user", "q")], [turn("user", "q")]),
        (3, None, [turn(None, None)]),
    ]
    kind = "array<struct<role:string,text:string>>"
    found = {r["pair_id"]: r for r in chat.preference(spark.createDataFrame(rows, f"pair_id long, chosen {kind}, rejected {kind}")).collect()}
    assert found[1]["prompt"] == "<|user|>\nq<|end|>\n" and found[1]["n_prompt_turns"] == 1
    for side, text in (("chosen", "good<|end|>\n"), ("rejected", "bad<|end|>\n")):
        assert [found[1][side][s["start"] : s["end"]] for s in found[1][f"{side}_mask"]] == [text]
    assert (found[2]["chosen"], found[2]["rejected"], found[2]["n_prompt_turns"]) == ("", "", 1)
    assert found[3]["prompt"] == "" and found[3]["rejected"] == "<||>\n<|end|>\n"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preference(chat.pairs_from_conversations(empty)).count() == 0


# op8


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    want = Tokenizer.from_file(path)
    want.no_truncation()
    want.no_padding()
    rng = random.Random(8)
    texts = [*ODD, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "ab" * 3000, " " * 500, "it's 12'd\r\n\n x"]
    texts += ["".join(rng.choices("aeth nos i\n  \t'sllre19!é漢\U0001f600ſ", k=rng.randint(1, 80))) for _ in range(300)]
    rows = bpe.encode(docs(spark, texts, extra=True), path).collect()
    for r in rows:
        ids = want.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), want.decode(ids, skip_special_tokens=False))
    back = bpe.decode(spark.createDataFrame([(r["doc_id"], r["ids"]) for r in rows] + [(-1, None), (-2, [10**6])], "doc_id long, ids array<int>"), path)
    decoded = {r["doc_id"]: r["decoded"] for r in back.collect()}
    assert all(decoded[r["doc_id"]] == r["decoded"] for r in rows) and decoded[-1] == decoded[-2] == ""


# op9


def test_secrets(spark):
    def brute(text):
        text = text or ""
        out = [("assign", *m.span()) for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 6]
        out += [("access", *m.span()) for m in secret_scan.ACCESS.finditer(text) if len(m[0]) >= 20]
        out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))

    rng = random.Random(9)
    parts = ["password", "PASSWD", "token", "api_key", " ", "=", ":", '"', "abcdef", "AKIA", "A1B2C3D4E5F6G7H8I9", "deadbeef", "0123456789abcdef", "é", "İ", "K"]
    body = "Q" * 30
    texts = [*ODD, *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(500)), f"x ghp_{body}{secret_scan.checksum(body)}", f"x ghp_{body}000000"]
    rows = {r["doc_id"]: [tuple(s) for s in r["found"]] for r in secret_scan.scan(docs(spark, texts, extra=True)).collect()}
    assert [[s for s in rows[i] if s[0] in secret_scan.KINDS] for i in range(len(texts))] == [brute(t) for t in texts]
    assert rows[len(texts) - 2] == [("github", 2, 42)] and rows[len(texts) - 1] == []


# op10


def brute_contamination(texts, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    owner = defaultdict(set)
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            owner[tuple(w[p : p + window])].add(str(i))
    out = []
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in owner}:
            for p in range(len(w) - n + 1):
                if x := owner.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= x
        out.append((d, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_contamination(spark):
    rng = random.Random(10)
    vocabulary = [*(f"w{i}" for i in range(40)), "É", "é", "Straße"]
    items = [(i, ", ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 9])))) for i in range(12)] + [(12, None), (13, " ... "), (14, "solo")]
    texts = list(ODD)
    for _ in range(120):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))
        texts.append(text + " " + (rng.choice(items)[1] or "").upper() + " end")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.decontaminate(docs(spark, texts, extra=True), benchmark, window=4).drop("text_key")
    assert sorted(tuple(r) for r in found.collect()) == brute_contamination(texts, items, 4)
    assert contamination.decontaminate(docs(spark, texts), benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert contamination.decontaminate(docs(spark, texts).limit(0), benchmark).count() == 0


# the queries against their SQL, and the pipeline


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(want)


def test_pipeline(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet")
    df = base
    for name, stage in P.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in df.collect()}
        df = spark.createDataFrame(stage(spark, df, sf).collect(), base.schema)
        after = {r["doc_id"]: r["text"] for r in df.collect()}
        assert set(after) <= set(before) and df.columns == base.columns
        if name == "near_duplicates":
            ids = sorted(before)
            groups = brute_groups([before[i] for i in ids], P.SHINGLE, P.PERCENT)
            assert set(after) == {ids[i] for i, _, root in groups if i == root}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            ids = sorted(before)
            assert set(after) == {ids[r[0]] for r in brute_contamination([before[i] for i in ids], items, 13) if not r[4]}
    last = P.STAGES[-1][1](spark, df, sf)
    assert {r["doc_id"] for r in last.collect()} == set(after)
    assert isinstance(last.schema["ids"].dataType, T.ArrayType)


def plain_line_dedup(rows):
    """Texts without boilerplate lines, for (source, text); pages of the same lines count once."""
    key = lambda x: x.strip(" \t\r")
    pages = defaultdict(set)
    for source, text in rows:
        pages[source].add(tuple(k for x in (text or "").split("\n") if (k := key(x))))
    bad = {}
    for source, of in pages.items():
        n = Counter(k for page in of for k in set(page))
        bad[source] = {k for k, c in n.items() if c >= 3 and c > 0.1 * len(of)}
    return [text and "\n".join(x for x in text.split("\n") if key(x) not in bad[source]) for source, text in rows]


def test_pipeline_keeps_copied_documents(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet")
    copied = "a copied page of several words\n\nits second line has other words"
    # a third of the source are copies, some with other blanks; "menu" is on every other page
    texts = [copied] * 9 + [copied + "\n \n"] + [f"menu\nbody {i} " + " ".join(f"w{i}x{j}" for j in range(9)) for i in range(20)] + [None, ""]
    template = base.first().asDict()
    rows = [{**template, "doc_id": i, "source": "planted", "text": t, "n_chars": len(t or "")} for i, t in enumerate(texts)]
    docs_ = spark.createDataFrame(rows, base.schema)
    cleaned = P.drop_lines(spark, docs_, sf)
    found = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert [found[i] for i in range(len(texts))] == plain_line_dedup([("planted", t) for t in texts])
    assert found[0] == copied and found[10].startswith("body 0")
    kept = {r["doc_id"]: r["text"] for r in P.drop_near_duplicates(spark, cleaned, sf).collect()}
    assert kept[0] == copied and not set(range(1, 10)) & set(kept)


def test_pipeline_near_duplicates_by_row(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet")
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(40)) for c in "abcd")
    rows = [(5, one), (5, one), (9, one), (None, one), (None, two), (None, two), (9, three), (None, three + " end"), (9, four), (11, None), (None, None)]
    template = base.first().asDict()
    docs_ = spark.createDataFrame([{**template, "doc_id": i, "text": t, "n_chars": len(t or "")} for i, t in rows], base.schema)
    kept = P.drop_near_duplicates(spark, docs_, sf)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(5, one), (None, two), (9, three), (9, four), (11, None), (None, None)])
    assert kept.columns == base.columns
