"""Ingest: document text, chunking, embedding, chunk-store upsert."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalflow.functions.text import SPACE_SPLIT, word_parts, words

# --- fixed values that must equal the reference's output -----------------
# Chunk overlap rule: a quarter of the chunk size, at most 64.
MAX_OVERLAP = 64
# Chunks embedded per model call in the example pipeline.
EMBED_BATCH = 640
# --------------------------------------------------------------------------

# HTML entities decoded by html_to_text (the five XML ones and nbsp).
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def default_overlap(size: int) -> int:
    return int(min(size / 4, MAX_OVERLAP))


def html_to_text(c: str | Column) -> Column:
    """Visible text of an HTML page: script/style/head-title blocks and
    comments removed, tags dropped, entities decoded, whitespace collapsed."""
    x = F.col(c) if isinstance(c, str) else c
    x = F.regexp_replace(x, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    x = F.regexp_replace(x, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for ent, ch in _ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    x = F.regexp_replace(x, SPACE_SPLIT, " ")
    return F.regexp_replace(x, r"^ | $", "")


def document_text(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Check the one-document-per-source rule: a source yielding other than
    exactly one text raises. The check is an aggregate (no collect of texts)."""
    bad = docs.groupBy(id_col).count().where(F.col("count") != 1).limit(1).collect()
    if bad:
        raise ValueError(f"source {bad[0][0]} produced {bad[0][1]} documents, expected 1")
    return docs


def chunk_window(
    docs: DataFrame,
    size: int,
    overlap: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Fixed word windows: words are the non-empty whitespace-separated parts;
    chunk i covers words [i*step, i*step + size) with step = size - overlap;
    the last chunk is the first one that reaches the end. Documents without
    words give no chunk. Output: doc_id, chunk_id, n_words, text.

    Pure expressions plus ``explode``: runs where the documents are, no
    shuffle. The document is split into words once; the chunks are built
    from that array and only they are exploded, so an exploded row never
    carries the whole document (output size is linear in the chunk text).
    """
    overlap = default_overlap(size) if overlap is None else overlap
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    base = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("_w"))
    n = F.size("_w")
    count = F.when(n == 0, F.lit(0)).when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def chunk(i: Column) -> Column:
        piece = F.slice(F.col("_w"), i * step + 1, F.lit(size))
        return F.struct(
            i.cast("int").alias("chunk_id"),
            F.size(piece).cast("int").alias("n_words"),
            F.array_join(piece, " ").alias("text"),
        )

    ex = base.select("doc_id", F.explode(F.transform(starts, chunk)).alias("_c"))
    return ex.select("doc_id", "_c.chunk_id", "_c.n_words", "_c.text")


# ---------------------------------------------------------------- recursive


def word_length(text: str) -> int:
    return len([w for w in text.split() if w])


def _pieces(
    text: str, size: int, length: Callable[[str], int], separators: Sequence[str]
) -> list[tuple[int, int, int]]:
    """``text`` as consecutive (start, end, length) pieces. Only pieces longer
    than ``size`` are cut, by the separators from coarse to fine; a piece
    keeps the separator it ends with, ``""`` cuts between characters."""
    pieces = [(0, len(text), length(text))] if text else []
    for sep in separators:
        finer = []
        for start, end, n in pieces:
            if n <= size:
                finer.append((start, end, n))
                continue
            if sep == "":
                cuts = range(start + 1, end + 1)
            else:
                cuts = [m.end() + start for m in re.finditer(re.escape(sep), text[start:end])]
                cuts = [*cuts, *([] if cuts and cuts[-1] == end else [end])]
            a = start
            for b in cuts:
                finer.append((a, b, length(text[a:b])))
                a = b
        pieces = finer
    return pieces


def split_recursive(
    text: str,
    size: int,
    overlap: int,
    length: Callable[[str], int] = word_length,
    separators: Sequence[str] | None = None,
) -> list[str]:
    """Chunks of at most ``size`` (by ``length``) that end where a separator
    does, the coarsest that serves. Each is a slice of the text from one
    piece's start to another's end, as far as ``size`` allows; the next
    starts at the earliest piece from which the shared part is at most
    ``overlap`` and one more piece fits. Only a piece that no separator can
    cut is longer than ``size``; it is a chunk of its own."""
    pieces = _pieces(text, size, length, SEPARATORS if separators is None else separators)
    before = [0, *accumulate(n for _, _, n in pieces)]
    chunks = []
    first = 0
    while first < len(pieces):
        stop = max(first + 1, bisect_right(before, before[first] + size) - 1)
        chunk = text[pieces[first][0] : pieces[stop - 1][1]].strip()
        if chunk:
            chunks.append(chunk)
        if stop == len(pieces):
            break
        room = max(before[stop] - overlap, before[stop + 1] - size)
        first = min(stop, max(first + 1, bisect_left(before, room)))
    return chunks


#: White space as ``str.split`` and ``str.strip`` know it.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
SEPARATORS = ("\n\n", "\n", " ", "")


def word_count(c: Column) -> Column:
    """``word_length`` of a text column."""
    return F.size(F.array_remove(F.split(c, _BLANK, -1), ""))


#: Any of them but the space.
_ODD_BLANK = _BLANK.replace(r"\x20", r"\x1f")[:-1]


def _counted(text: Column) -> Column:
    return F.struct(text.alias("p"), word_count(text).alias("n"))


def _cut_pieces(pieces: Column, size: int, separator: str) -> Column:
    """Pieces (p, n words) of more than ``size`` words cut after every separator, others as they are."""
    if len(separator) == 1:
        one = re.escape(separator)
        pattern = f"[^{one}]*+{one}|[^{one}]++"
    else:
        pattern = f"(?s).*?{re.escape(separator)}|.+" if separator else "(?s)."

    def cut(piece: Column) -> Column:
        parts = F.regexp_extract_all(piece["p"], F.lit(pattern), F.lit(0))
        counted = F.transform(parts, _counted)
        if separator != " ":
            # one that the separator does not cut keeps its count
            return F.when(F.instr(piece["p"], separator) == 0, F.array(piece)).otherwise(counted) if separator else counted
        # without other blanks, a part is one word or the space alone
        one = F.transform(parts, lambda p: F.struct(p.alias("p"), (p != " ").cast("int").alias("n")))
        return F.when(piece["p"].rlike(_ODD_BLANK), counted).otherwise(one)

    some = F.exists(pieces, lambda x: x["n"] > size)
    return F.when(some, F.flatten(F.transform(pieces, lambda x: F.when(x["n"] <= size, F.array(x)).otherwise(cut(x))))).otherwise(pieces)


def _between(column: str, first: Column, stop: Column) -> Column:
    """Elements [first, stop) of an array column, read one by one: ``slice`` would go through the whole array each time."""
    taken = F.transform(F.sequence(first, stop - 1), lambda j: F.get(F.col(column), j))
    return F.when(first < stop, taken).otherwise(F.slice(F.col(column), 1, 0))


def _chunk_bounds(lengths: str, size: int, overlap: int) -> Column:
    """(first, stop) piece of every chunk: a fold over the pieces' lengths.

    The state holds the number of the next piece, the open chunk's first
    piece and the sum of its lengths. A piece that does not fit closes the
    chunk; the next starts with the longest tail whose sum is at most
    ``overlap`` and leaves room for it.
    """
    bounds = "array<struct<first:int,stop:int>>"
    zero = F.lit(0)
    start = F.struct(zero.alias("i"), zero.alias("first"), zero.alias("sum"), F.array().cast(bounds).alias("done"))

    def tail(state: Column, n: Column) -> Column:
        """Length and sum of the tail that the next chunk takes over."""
        room = F.least(F.lit(overlap), F.lit(size) - n)
        rest = F.reverse(_between(lengths, state["first"] + 1, state["i"]))
        begin = F.struct(zero.alias("k"), zero.alias("sum"), F.lit(True).alias("fits"))

        def take(t: Column, x: Column) -> Column:
            fits = t["fits"] & (t["sum"] + x <= room)
            return F.struct(
                (t["k"] + fits.cast("int")).alias("k"), F.when(fits, t["sum"] + x).otherwise(t["sum"]).alias("sum"), fits.alias("fits")
            )

        return F.aggregate(rest, begin, take)

    def step(state: Column, n: Column) -> Column:
        def closed(t: Column) -> Column:
            own = F.struct(state["first"].alias("first"), state["i"].alias("stop"))
            return F.struct(
                (state["i"] + 1).alias("i"), (state["i"] - t["k"]).alias("first"), (t["sum"] + n).alias("sum"),
                F.concat(state["done"], F.array(own)).alias("done"),
            )

        longer = F.struct((state["i"] + 1).alias("i"), state["first"].alias("first"), (state["sum"] + n).alias("sum"), state["done"].alias("done"))
        full = (state["i"] > state["first"]) & (state["sum"] + n > size)
        # the tail is worked out once: as the only element of an array that is mapped
        return F.when(full, F.get(F.transform(F.array(tail(state, n)), closed), 0)).otherwise(longer)

    last = lambda state: F.concat(state["done"], F.array(F.struct(state["first"].alias("first"), state["i"].alias("stop"))))
    return F.when(F.size(lengths) > 0, F.aggregate(lengths, start, step, last)).otherwise(F.array().cast(bounds))


def chunk_recursive(
    docs: DataFrame,
    size: int,
    overlap: int | None = None,
    length: Callable[[str], int] = word_length,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Recursive separator chunking (``split_recursive`` of every text).

    Measured in words it is array expressions alone: the pieces of each
    level of separators, their lengths, and one fold that cuts them into
    chunks. A length function of the caller's runs per partition with
    ``mapInPandas``.
    """
    overlap = default_overlap(size) if overlap is None else overlap
    if length is word_length:
        # counted once when cut; nothing below counts a piece again
        base = docs.where(F.col(text_col) != "").select(F.col(id_col).alias("doc_id"), F.array(_counted(F.col(text_col))).alias("_p"))
        for separator in SEPARATORS:
            base = base.withColumn("_p", _cut_pieces(F.col("_p"), size, separator))
        # mapped, not taken as fields: Spark would take those anew for every element read
        base = base.select("doc_id", F.transform("_p", lambda x: x["p"]).alias("_p"), F.transform("_p", lambda x: x["n"]).alias("_n"))
        base = base.select("doc_id", "_p", _chunk_bounds("_n", size, overlap).alias("_b"))
        text = lambda b: F.btrim(F.array_join(_between("_p", b["first"], b["stop"]), ""), F.lit(BLANKS))
        chunks = F.array_remove(F.transform("_b", text), "")
        rows = base.select("doc_id", F.posexplode(chunks).alias("chunk_id", "text"))
        return rows.select("doc_id", "chunk_id", word_count(F.col("text")).alias("n_tokens"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, cids, lens, texts = [], [], [], []
            for doc_id, text in zip(b[id_col], b[text_col]):
                if text is None:
                    continue
                for i, ch in enumerate(split_recursive(text, size, overlap, length)):
                    ids.append(doc_id)
                    cids.append(i)
                    lens.append(length(ch))
                    texts.append(ch)
            yield pd.DataFrame({"doc_id": ids, "chunk_id": cids, "n_tokens": lens, "text": texts})

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, chunk_id int, n_tokens int, text string"
    return docs.select(id_col, text_col).mapInPandas(run, schema)


# ---------------------------------------------------------------- embedding


def _bucket_sums(dim: int):
    """Arrow UDF: per row, sum the signs of its distinct words per bucket.
    Input is the text of ASCII rows and ``array<string>`` of the others, whose
    letters and case depend on Unicode; a word's bucket is its hash modulo
    ``dim`` and the sign the hash's bit 32. A batch hashes each of its words
    once, and one ``bincount`` does the scatter-add for every row at once."""
    lower = np.zeros(256, "uint8")  # 0: between words
    for ch in b"abcdefghijklmnopqrstuvwxyz0123456789":
        lower[ch] = lower[ord(chr(ch).upper())] = ch

    def ascii_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, "int32")[texts.offset : texts.offset + len(texts) + 1]
        data = lower[np.frombuffer(data or b"", "uint8")[offsets[0] : offsets[-1]]]
        begin = offsets[:-1] - offsets[0]
        inside = data != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = begin[begin < len(data)]
        first[at] = inside[at]
        first = np.flatnonzero(first)
        ends = np.r_[np.cumsum(inside, dtype="int32")[first] - 1, np.count_nonzero(inside)].astype("int32")
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data[inside]))
        return np.searchsorted(begin, first, "right") - 1, words

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def sums(texts: pa.Array, parts: pa.Array) -> pa.Array:
        texts, parts = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (texts, parts))
        n = len(texts)
        row, words = ascii_words(texts)
        row = np.r_[row, np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))]
        coded = pa.concat_arrays([words, parts.flatten().cast(pa.string())]).dictionary_encode()
        words = coded.dictionary
        known = max(1, len(words))
        # each word once a row
        found = np.sort(row * known + coded.indices.to_numpy(zero_copy_only=False))
        row, word = np.divmod(found[np.r_[True, found[1:] != found[:-1]][: len(found)]], known)
        # the first 60 bits of each word's md5
        digests = b"".join([md5(w).digest()[:8] for w in words.cast(pa.binary()).to_pylist()])
        h = (np.frombuffer(digests, ">u8") >> np.uint64(4)).astype("int64")
        weight = np.where(pc.equal(words, "").to_numpy(zero_copy_only=False), 0.0, 1.0 - 2.0 * ((h >> 32) & 1))
        flat = np.bincount(row * dim + np.mod(h, dim)[word], weights=weight[word], minlength=n * dim)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(0, n * dim + 1, dim, dtype="int32")), pa.array(flat.astype("float32"))
        )

    return sums


def hashing_embedding(c: str | Column, dim: int = 64) -> Column:
    """Signed feature-hashing embedding of the word tokens (counts per
    bucket; cosine similarity normalises, so no L2 step is stored).
    Tokenising stays JVM-side but for texts in ASCII, where it does not
    depend on Unicode tables. The distinct words of a row, their hashes (the
    first 60 bits of each word's md5, so that other engines can reproduce the
    vectors) and the scatter-add are worked out over a whole Arrow batch."""
    text = F.col(c) if isinstance(c, str) else c
    plain = F.octet_length(text) == F.length(text)
    return _bucket_sums(dim)(F.when(plain, text), F.when(~plain, word_parts(text)))


def embed(
    chunks: DataFrame,
    embedder: Callable[[list[str]], np.ndarray] | None = None,
    batch_size: int = EMBED_BATCH,
    dim: int = 64,
    text_col: str = "text",
) -> DataFrame:
    """Adds ``embedding array<float>``. Default: native hashing embedding.
    A model ``embedder(texts) -> (n, dim) array`` runs in an iterator pandas
    UDF, loaded once per task and called on ``batch_size`` texts at a time."""
    if embedder is None:
        return chunks.withColumn("embedding", hashing_embedding(text_col, dim))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            out = []
            vals = s.tolist()
            for i in range(0, len(vals), batch_size):
                part = [v if v is not None else "" for v in vals[i:i + batch_size]]
                out.extend(np.asarray(embedder(part), dtype="float32").tolist())
            yield pd.Series(out)

    return chunks.withColumn("embedding", _embed(F.col(text_col)))


def upsert_chunks(existing: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Replace every chunk of a re-ingested document, keep the others: an
    anti join on the document key plus a union (the de-duplicated key set of
    the new chunks is small next to the store; AQE broadcasts it when it is)."""
    keys = new.select(key).distinct()
    return existing.join(keys, key, "left_anti").unionByName(new)
