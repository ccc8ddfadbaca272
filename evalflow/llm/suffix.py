"""Removal of repeated windows by a depth-limited radix sort of suffixes.

Two positions belong together exactly if the ``WINDOW`` bytes from them are
equal, so suffixes need ordering through that depth only. Passes go from
the most significant digit down; each deals suffixes into groups by one
more digit and drops those that stand alone:

1. The first digit of a suffix is its anchor: of the ``ANCHOR``-byte
   strings inside its window the leftmost of smallest hash. Equal windows
   have equal anchors, and neighbouring suffixes share one, so a run of
   suffixes is one row. Anchors found once drop out.
2. The second digit is the run's whole content (the bytes that its windows
   cover). Runs with a twin are repeated throughout; of each distinct run
   one goes on, if its anchor has several.
3. The last digit is the window itself, hashed for each suffix of the
   runs left. Hashes are packed into rows by radix bucket, after each
   batch has merged its own repeats, so a very common window is one entry
   of a batch. Equal groups are the repeated windows.

Equal texts are one text: identified by a 64-bit hash and length, read once
per task, and removed throughout if they reach the window. Anchors, runs
and windows are compared by 64-bit hashes (a window's within its length).

Passages shorter than the window may be of interest too: ``shared_words``
counts, without removing any, the words of passages that texts share, from
winnowed word strings (of every ``PASSAGE`` consecutive words, the strings
of ``STRING`` words with the smallest hash). Every passage of ``PASSAGE``
words that two texts share has a string that both select; no string is
found in passages of fewer than ``STRING`` words.

Null texts read as empty; texts shorter than the window keep all bytes.
Every input row gives one output row, null ids and repeated rows included.
An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalflow.llm.shared import in_filter, key_filter, returning, small_batches, step
from evalflow.llm.textbatch import Words, blocks, hash_sums, prefix_hash, signed, span_hash
from evalflow.session import materialize

WINDOW = 400
ANCHOR = 200
#: Windows of a radix bucket, about; bounds a task's memory.
BUCKET = 1 << 20
#: Texts merged at a time before the last pass.
BATCH = 500
#: Words of a passage, and of the strings by which passages are told.
PASSAGE, STRING = 50, 40

#: A word, as ``textbatch.SPACED`` parts them.
WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    before = np.minimum.accumulate(grid, 1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def runs(data: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one anchor: its hash, the run's hash, first window and number of windows."""
    prefix = prefix_hash(data)
    at = np.arange(len(data) - anchor + 1)
    value = span_hash(prefix, at, at + anchor)
    least = sliding_min(value, window - anchor + 1)
    # The anchor is the leftmost of equals; once a window starts with it, the next has another.
    first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (value[: len(least) - 1] == least[:-1]))))
    size = np.diff(np.append(first, len(least)))
    return least[first], span_hash(prefix, first, first + size - 1 + window), first, size


def distinct_texts(documents: DataFrame, window: int, wanted: DataFrame) -> DataFrame:
    """(k, n, z) of texts that reach the window and may be among ``wanted`` (k): hash, bytes, zstd text; equal texts once for each task."""
    long_enough = _keyed(documents).where(F.col("n") >= window).select("k", "n", "text")
    maybe = documents.sparkSession.sparkContext.broadcast(key_filter(wanted, "k"))

    def run(batches):
        seen: set[tuple[int, int]] = set()
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            listed = in_filter(maybe.value, np.asarray(batch.column(0)))
            new = [i for i, x in enumerate(keys) if listed[i] and x not in seen and not seen.add(x)]
            part = batch.take(pa.array(new, pa.int64()))
            packed = [pack.compress(x.as_buffer()) for x in part.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], names=["k", "n", "z"])

    return long_enough.mapInArrow(run, "k long, n long, z binary")


def anchored_runs(documents: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, run, k, n, first, size) of the texts that reach the window; equal texts once for each task."""
    long_enough = _keyed(documents).where(F.col("n") >= window).select("k", "n", "text")

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            found, row = [], 0
            for _, data, offsets in blocks(batch.column(2)):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    if keys[row] not in seen:
                        seen.add(keys[row])
                        found.append((keys[row], *runs(data[a:b], window, anchor)))
                    row += 1
            if found:
                count = [len(x[1]) for x in found]
                of = lambda j: np.concatenate([x[j] for x in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(of(1))),
                        pa.array(signed(of(2))),
                        pa.array(np.repeat(np.array([x[0][0] for x in found], np.int64), count)),
                        pa.array(np.repeat(np.array([x[0][1] for x in found], np.int64), count)),
                        pa.array(of(3).astype(np.int64)),
                        pa.array(of(4).astype(np.int32)),
                    ],
                    names=["anchor", "run", "k", "n", "first", "size"],
                )

    return long_enough.mapInArrow(run, "anchor long, run long, k long, n long, first long, size int")


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("k"), F.octet_length(text).cast("long").alias("n"), text.alias("text"))


def text_of(z: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)


def packed_windows(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """The windows of the runs of ``texts`` (k, z, runs), by radix bucket.

    Rows (bucket, hashes, keys, counts, places): hashes of a batch's windows,
    the texts they come from, how many each and where; places below 0 need
    no answer. Windows that the batch itself repeats go out as one hash,
    and as answers, rows with null hashes.
    """

    def emit(bucket, hashes, keys, counts, places):
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int32()), pa.array(hashes, pa.binary()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), pa.array(places, pa.binary())],
            names=["bucket", "hashes", "keys", "counts", "places"],
        )

    def run(batches):
        for whole in batches:
            for part in (whole.slice(i, BATCH) for i in range(0, len(whole), BATCH)):
                rows = part.to_pylist()
                hashes, place, owner, need = [], [], [], []
                for row in rows:
                    prefix = prefix_hash(text_of(row["z"]))
                    at = np.concatenate([np.arange(r["first"], r["first"] + r["size"]) for r in row["runs"]])
                    hashes.append(span_hash(prefix, at, at + window))
                    place.append(at)
                    need.append(np.repeat([r["need"] for r in row["runs"]], [r["size"] for r in row["runs"]]))
                if not rows:
                    continue
                owner = np.repeat(np.array([r["k"] for r in rows], np.int64), [len(x) for x in hashes])
                hashes, place, need = np.concatenate(hashes), np.concatenate(place), np.concatenate(need)
                _, first, of, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                twice = (count > 1)[of]
                bucket = (hashes % np.uint64(buckets)).astype(np.int32)
                once = np.zeros(len(hashes), bool)
                once[first] = True
                out = ([], [], [], [], [])
                for answered, chosen in ((False, np.flatnonzero(once)), (True, np.flatnonzero(twice & need))):
                    order = chosen[np.argsort(bucket[chosen], kind="stable")]
                    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                    for group in np.split(order, cuts):
                        if not len(group):
                            continue
                        start = np.flatnonzero(np.concatenate(([True], owner[group][1:] != owner[group][:-1])))
                        where = place[group] if answered else np.where(need[group] & ~twice[group], place[group], -1)
                        out[0].append(int(bucket[group[0]]))
                        out[1].append(None if answered else hashes[group].tobytes())
                        out[2].append(owner[group][start].tobytes())
                        out[3].append(np.diff(np.append(start, len(group))).astype(np.int32).tobytes())
                        out[4].append(where.astype(np.int64).tobytes())
                yield emit(*out)

    return texts.mapInArrow(run, "bucket int, hashes binary, keys binary, counts binary, places binary")


def repeated_windows(packed: DataFrame) -> DataFrame:
    """(k, places): the windows found more than once, as packed int64 by text."""

    def run(group: pa.Table) -> pa.Table:
        hashes, owner, place, answered = [], [], [], []
        for row in group.to_pylist():
            counts = np.frombuffer(row["counts"], np.int32)
            keys = np.repeat(np.frombuffer(row["keys"], np.int64), counts)
            where = np.frombuffer(row["places"], np.int64)
            owner.append(keys)
            place.append(where)
            answered.append(np.full(len(keys), row["hashes"] is None))
            hashes.append(np.zeros(len(keys), np.uint64) if row["hashes"] is None else np.frombuffer(row["hashes"], np.uint64))
        hashes, owner, place, answered = (np.concatenate(x) for x in (hashes, owner, place, answered))
        asked = np.flatnonzero(~answered)
        _, of, count = np.unique(hashes[asked], return_inverse=True, return_counts=True)
        answered[asked] = (count > 1)[of]
        keep = np.flatnonzero(answered & (place >= 0))
        keep = keep[np.lexsort((place[keep], owner[keep]))]
        owner, place = owner[keep], place[keep]
        start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(keep) else keep
        parts = [x.astype(np.int64).tobytes() for x in np.split(place, start[1:])] if len(keep) else []
        return pa.table({"k": pa.array(owner[start], pa.int64()), "places": pa.array(parts, pa.binary())})

    return packed.groupBy("bucket").applyInArrow(run, "k long, places binary")


def covered_spans(n: int, first: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans covered by windows that start in the given runs."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + size - 1 + window, -1)
    inside = np.cumsum(step[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    return edge[::2], edge[1::2]


def winnowed(words: Words, passage: int, string: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every ``passage`` consecutive words of a row the strings of smallest hash: hash, row and first word in the row."""
    width, count = passage - string + 1, len(words.hash)
    if count < passage:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(count - string + 1)
    value = span_hash(hash_sums(words.hash), at, at + string)
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside = row[: count - passage + 1] == row[passage - 1 :]
    least = np.where(inside, sliding_min(value, width), np.uint64(0))
    # A string is selected if it is the least of some passage: of the passages around it, if the greatest least is its own.
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(~sliding_min(~np.concatenate((edge, least, edge)), width) == value)
    return value[chosen], row[chosen], chosen - words.first[row[chosen]]


def passage_strings(documents: DataFrame, passage: int, string: int, wanted: DataFrame | None = None) -> DataFrame:
    """(h, k, n, first): the texts' selected strings, of those that may be among ``wanted`` (h); equal texts once for each task."""
    long_enough = _keyed(documents).where(F.col("n") >= 2 * passage - 1).select("k", "n", "text")
    maybe = None if wanted is None else documents.sparkSession.sparkContext.broadcast(key_filter(wanted, "h"))

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            k, n = (np.asarray(batch.column(j)) for j in (0, 1))
            new = np.array([x not in seen and not seen.add(x) for x in zip(k.tolist(), n.tolist())], bool)
            for start, data, offsets in blocks(batch.column(2)):
                value, row, first = winnowed(Words(data, offsets), passage, string)
                h, row = signed(value), row + start
                keep = new[row] if maybe is None else new[row] & in_filter(maybe.value, h)
                row = row[keep]
                yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(k[row]), pa.array(n[row]), pa.array(first[keep].astype(np.int64))], names=["h", "k", "n", "first"])

    return long_enough.mapInArrow(returning(run), "h long, k long, n long, first long")


def shared_words(documents: DataFrame, passage: int = PASSAGE, string: int = STRING) -> DataFrame:
    """(k, n, shared): of texts that share selected strings with other texts, the number of words that these strings cover."""
    found = passage_strings(documents, passage, string).groupBy("h").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    often = step(found.where("low <> high").select("h"), "suffix-strings")
    places = passage_strings(documents, passage, string, often).join(often, "h").groupBy("k", "n").agg(F.array_sort(F.collect_set("first")).alias("at"))
    gaps = F.zip_with(F.slice("at", F.lit(2), F.size("at")), F.slice("at", F.lit(1), F.size("at") - 1), lambda x, y: F.least(x - y, F.lit(string).cast("long")))
    return step(places.select("k", "n", F.aggregate(gaps, F.lit(string).cast("long"), lambda t, x: t + x).alias("shared")), "suffix-shared")


def repeated_spans(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256), a row for each row of ``documents``; with ``passage``, n_shared_words too.

    spans: maximal byte ranges (start, end) covered by windows that also
    start elsewhere; kept_sha256: of the bytes outside them. n_shared_words:
    words of passages of so many that another row's text holds
    (``shared_words``); of a text that another row repeats, all.
    """
    spark = small_batches(documents).sparkSession
    shared = shared_words(documents, passage) if passage else None
    all_runs = anchored_runs(documents, window, anchor)
    # Counts are written before they are joined back: a very common anchor or run is then split like any skewed join key.
    often = all_runs.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    found = materialize(all_runs.join(materialize(often, "suffix-anchors"), "anchor"), "suffix-runs")

    same = found.groupBy("anchor", "run").agg(F.count("*").alias("c"), F.min(F.struct("k", "n", "first", "size")).alias("lead"))
    same = materialize(same, "suffix-kinds")
    kinds = same.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where("kinds > 1 and least = 1").select("anchor")
    twins = found.join(same.where("c > 1").select("anchor", "run"), ["anchor", "run"]).groupBy("k", "n").agg(F.collect_list(F.struct("first", "size")).alias("twins"))
    open_runs = (
        same.join(kinds, "anchor")
        .select("lead.k", "lead.n", "lead.first", "lead.size", (F.col("c") == 1).alias("need"))
        .groupBy("k", "n")
        .agg(F.collect_list(F.struct("first", "size", "need")).alias("runs"), F.sum("size").alias("windows"))
    )
    wanted = found.select("k", "n").distinct().join(twins, ["k", "n"], "left").join(open_runs, ["k", "n"], "left")
    texts = materialize(distinct_texts(documents, window, found.select("k").distinct()).join(wanted, ["k", "n"]).dropDuplicates(["k", "n"]), "suffix-texts")

    total = texts.agg(F.sum("windows").alias("w")).first()["w"] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    answers = repeated_windows(packed_windows(texts.where("runs is not null").select("k", "z", "runs"), window, buckets))
    answers = answers.groupBy("k").agg(F.collect_list("places").alias("places"))

    def cut(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = text_of(row["z"])
                first = np.concatenate([np.array([x["first"] for x in row["twins"] or []], np.int64), *(np.frombuffer(x, np.int64) for x in row["places"] or [])])
                size = np.ones(len(first), np.int64)
                size[: len(row["twins"] or [])] = [x["size"] for x in row["twins"] or []]
                start, end = covered_spans(len(data), first, size, window)
                kept, at = hashlib.sha256(), 0
                for a, b in zip(start.tolist(), end.tolist()):
                    kept.update(data[at:a].tobytes())
                    at = b
                kept.update(data[at:].tobytes())
                out.append((row["k"], row["n"], [{"start": int(a), "end": int(b)} for a, b in zip(start, end)], kept.hexdigest()))
            k, n, spans, sha = zip(*out) if out else ((), (), (), ())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(sha, pa.string())], names=["k", "n", "spans", "kept"])

    parts = texts.select("k", "n", "z", "twins").join(answers, "k", "left")
    spans = parts.mapInArrow(cut, "k long, n long, spans array<struct<start:long,end:long>>, kept string")

    n_words = [F.when(F.col("n") >= 2 * passage - 1, F.regexp_count("text", F.lit(WORD))).otherwise(0).alias("n_words")] if passage else []
    rows = _keyed(documents).select("doc_id", "k", "n", F.sha2("text", 256).alias("own"), *n_words)
    least = min(window, 2 * passage - 1) if passage else window
    copies = rows.where(F.col("n") >= least).groupBy("k", "n").agg(F.count("*").alias("c")).where("c > 1").select("k", "n", F.lit(True).alias("copied"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    gone = F.col("copied") & (F.col("n") >= window)
    joined = rows.join(copies, ["k", "n"], "left").join(spans, ["k", "n"], "left")
    more = []
    if passage:
        joined = joined.join(shared, ["k", "n"], "left")
        more = [F.when(F.col("copied") & (F.col("n_words") >= passage), F.col("n_words")).otherwise(F.coalesce("shared", F.lit(0))).cast("long").alias("n_shared_words")]
    return joined.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(gone, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(gone, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept", "own")).alias("kept_sha256"),
        *more,
    )


def remove_spans(rows: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Adds ``kept``: the bytes of ``text`` outside ``spans``, as binary (a cut may fall inside a character)."""

    @F.pandas_udf("binary")
    def cut(texts, cuts):
        import pandas as pd

        out = []
        for x, found in zip(texts, cuts):
            data, at, kept = (x or "").encode(), 0, []
            for s in found if found is not None else []:
                kept.append(data[at : s["start"]])
                at = s["end"]
            out.append(b"".join([*kept, data[at:]]))
        return pd.Series(out)

    return rows.withColumn("kept", cut(F.col(text), F.col(spans)))
