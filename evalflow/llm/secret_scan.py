"""Secret scan: keyword automaton, anchored patterns at its hits, checksums.

An Aho-Corasick automaton over lower-cased text finds the keywords that a
secret starts with; a pattern is tried only at those places, leftmost
first and without overlap within a kind. Runs of hexadecimal digits have no
keyword: their prefilter looks at every ``HEX_STEP``-th character, of which
each long enough run covers one, and the run is measured around it.

Kinds: assign, access and hex (the base), and checked tokens whose last
six characters are the base-62 CRC-32 of the body (github, npm); a token
with a wrong checksum is no secret. Spans are whole matches in code
points, end exclusive.

Null and empty texts have no spans. Rows keep their other columns; nulls
and repeats included.
"""

from __future__ import annotations

import re
import string
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evalflow.llm.shared import small_batches

#: The base kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Token prefixes with an embedded checksum, all of 36 characters after the prefix.
CHECKED = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
CHECKED_BODY = re.compile(r"[A-Za-z0-9]{36}(?![A-Za-z0-9])", re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
HEX_STEP = 12
HEX_CHARS = frozenset("0123456789abcdef")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
HEX_HIT = re.compile(r"[0-9a-f]{2}")
_LOWER = {i: i + 32 for i in range(65, 91)}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in KEYWORDS:
        a.add_word(word, ("assign", len(word)))
    a.add_word("akia", ("access", 4))
    for kind, prefixes in CHECKED.items():
        for prefix in prefixes:
            a.add_word(prefix, (kind, len(prefix)))
    a.make_automaton()
    return a


def checksum(body: str) -> str:
    """CRC-32 of the body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


def hex_spans(text: str) -> list[tuple[str, int, int]]:
    """Maximal runs of at least MIN_HEX digits: each covers two neighbours in the sample."""
    sample = text[::HEX_STEP]
    out, done = [], 0
    for hit in HEX_HIT.finditer(sample):
        at = hit.start() * HEX_STEP
        while at < hit.end() * HEX_STEP:
            if at >= done and at < len(text) and text[at] in HEX_CHARS:
                start = at
                while start > done and text[start - 1] in HEX_CHARS:
                    start -= 1
                run = HEX_RUN.match(text, start)
                if run:
                    out.append(("hex", start, run.end()))
                    done = run.end()
            at += HEX_STEP
    return out


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end), by start, then kind: base kinds as listed, checked ones after them by name."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lowered
        low = text.translate(_LOWER)
    out = hex_spans(text)
    done: dict[str, int] = {}
    hits = sorted({(end - n + 1, kind, n) for end, (kind, n) in automaton().iter(low)})
    for start, kind, n in hits:
        if start < done.get(kind, 0):
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                done[kind] = m.end()
                if m.end(2) - m.start(2) >= MIN_VALUE:
                    out.append((kind, start, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                done[kind] = m.end()
                if m.end() - start >= MIN_ACCESS:
                    out.append((kind, start, m.end()))
        elif text.startswith(CHECKED[kind], start) and not text[start - 1 : start].isalnum():
            if m := CHECKED_BODY.match(text, start + n):
                body = m.group()
                if body[-6:] == checksum(body[:-6]):
                    done[kind] = m.end()
                    out.append((kind, start, m.end()))
    rank = {k: i for i, k in enumerate((*KINDS, *sorted(CHECKED)))}
    return sorted(out, key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(documents: DataFrame) -> DataFrame:
    """Adds ``found``: array of (kind, start, end); a column of that name is replaced."""
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    rest = small_batches(documents).drop("found")
    schema = T.StructType([*rest.schema.fields, T.StructField("found", T.ArrayType(item))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, len(batch), 512)):
                found = [
                    [{"kind": k, "start": a, "end": b} for k, a, b in spans(x)]
                    for x in part.column(part.schema.get_field_index("text")).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=[f.name for f in schema.fields])

    return rest.mapInArrow(run, schema)
