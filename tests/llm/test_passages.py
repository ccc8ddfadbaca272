"""Passages that documents share, of fewer bytes than op5's window."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from evalflow.llm import suffix
from evalflow.llm.textbatch import Words, blocks


def text(rng: random.Random, n: int) -> list[str]:
    return [f"{rng.randrange(10**6)}" for _ in range(n)]


def test_winnowed_against_every_passage():
    rng = random.Random(5)
    rows = [" ".join(rng.choice("ab") for _ in range(rng.choice((0, 3, 9, 10, 11, 60)))) for _ in range(40)]
    for _, data, offsets in blocks(pa.array(rows)):
        words = Words(data, offsets)
        value, row, first = suffix.winnowed(words, 10, 6)
        hashes = {}
        for h, r, p in zip(value.tolist(), row.tolist(), first.tolist()):
            string = tuple(rows[r].split()[p : p + 6])
            assert len(string) == 6 and hashes.setdefault(h, string) == string
        chosen = set(zip(row.tolist(), first.tolist()))
        for r, x in enumerate(rows):
            n = len(x.split())
            assert (n >= 10) == any(a == r for a, _ in chosen)
            for start in range(n - 9):
                assert any((r, p) in chosen for p in range(start, start + 5))
    assert not any(len(x) for x in suffix.winnowed(Words(np.frombuffer(b"x " * 9, np.uint8), np.array([0, 18])), 10, 6))


def test_short_passages_are_counted_and_kept(spark):
    rng = random.Random(7)
    passage = [f"{rng.randrange(10, 99)}" for _ in range(55)]  # 55 words, 164 bytes
    short = [f"{rng.randrange(10, 99)}" for _ in range(39)]
    copied = " ".join(text(rng, 52))
    rows = [
        (1, " ".join([*text(rng, 70), *passage, *text(rng, 30)])),
        (2, " ".join([*text(rng, 20), *passage])),
        (3, " ".join([*text(rng, 60), *short, *text(rng, 60)])),
        (4, " ".join([*short, *text(rng, 90)])),
        (5, copied), (5, copied), (6, "a b " * 10), (7, "a b " * 10), (8, None), (None, ""),
    ]
    found = suffix.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), passage=50).collect()
    plain = suffix.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, (x[:4] for x in found))) == sorted(map(repr, (x[:4] for x in plain)))
    by = {x["doc_id"]: x["n_shared_words"] for x in found}
    assert len(found) == len(rows)
    assert 40 <= by[1] <= 55 and by[1] == by[2]
    assert by[5] == 52 and all(by[i] == 0 for i in (3, 4, 6, 7, 8, None))
    assert not any(x["spans"] for x in found)
