"""Periodic runs of words, by scale-tiled distribution.

A run is a maximal stretch of consecutive words with smallest period q and
at least ``least`` and 2 * q words. Places i whose word equals that q words
on form intervals; a run of period q is such an interval, of max(q, least -
q) places or more, and the q words after it.

Each octave of periods has its own tiles: overlapping parts of the document
around centres so far apart that every run's interval holds one. Around a
centre the interval reaches as far on as the Z-function of the words after
it says, and as far back as that of the reversed words before it says, for
all periods of the octave in one linear pass each; at most one distance of
centres is asked for, so a longer interval comes in fragments of
neighbouring tiles. A tile is only cut where an interval can be: half of
one would repeat a number of words at a distance in the octave (told by
exact ids of such word sequences, doubled from octave to octave).

Tiles of small octaves are solved where the text is; those of ``DEALT``
words and more become rows that any task solves, so a very long document
is many tasks' work. Fragments are shuffled by document and period and
stitched where they overlap. Multiples of a period have the same stretch:
tiles drop a period whose word is a power of a shorter one, and of equal
stretches the smallest period stays.

Null, empty and blank texts have no words and no runs. Rows are told apart
by doc_id and text: repeated rows each get the result, null ids included.
Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalflow.llm.shared import in_filter, key_filter, small_batches, step

#: Words that a run has at least.
LEAST = 12
#: Tiles of periods from this many words on are dealt to other tasks.
DEALT = 4096
#: Words of dealt tiles that leave a task at a time.
TILE_WORDS = 1 << 20

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "period", "length")])
#: Changes a document's words before they are searched: (doc_id, words) -> words.
Prepare = Callable[[object, list[bytes]], list[bytes]]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at the six ASCII blanks


def repeated_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of ``op13``'s documents: one in ten gets a periodic tail; rows without an id are left as they are."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def z_function(x: list[int]) -> list[int]:
    """z[i]: how many items from i on equal those from 0 on."""
    n = len(x)
    z = [n] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve(tile: list[int], centre: int, periods: list[int], reach: int, open_left: bool, open_right: bool, least: int) -> Iterator[tuple[int, int, int]]:
    """(period, low, high): fragments around ``centre``, as places of the tile.

    The tile has up to ``reach`` words before the centre, after it as many
    and the longest period. open_left and open_right say that the document
    goes on there, so an interval may as well.
    """
    after = z_function(tile[centre:])
    before = tile[max(0, centre - reach) : centre][::-1]
    stop = min(len(tile), centre + periods[-1])
    back = z_function([*before, -1, *tile[max(0, centre - reach) : stop][::-1]])
    periodic = np.arange(len(after)) + np.asarray(after)
    periodic[0] = 0
    periodic = np.maximum.accumulate(periodic)  # how far a period of at most i holds
    for p in periods:
        if centre + p > stop:
            break
        d = int(np.searchsorted(periodic[: p + 1], p))
        if d < p and p % d == 0:
            continue
        on = min(reach, after[p]) if p < len(after) else 0
        off = min(back[len(before) + 1 + stop - centre - p], len(before))
        cut = (on == reach and (open_right or centre + reach + p < len(tile))) or (off == reach and open_left)
        if on + off and (cut or on + off >= max(p, least - p)):
            yield p, centre - off, centre + on


def octaves(n: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(first period, first not, distance of centres) of each octave."""
    first = 1
    while first <= n // 2:
        stop = min(2 * first, n // 2 + 1)
        shortest = min(max(p, least - p) for p in range(first, min(stop, least + first + 1)))
        yield first, stop, 1 << (shortest.bit_length() - 1)
        first *= 2


def candidates(codes: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(longest period, distance, centres, which of the octave's periods) of the tiles that may hold a run."""
    n = len(codes)
    if n < least:
        return
    ids = {1: codes}  # ids of the sequences of a power of two words at every place
    distinct: int | None = None

    def sequences(size: int) -> np.ndarray:
        if size not in ids:
            half = sequences(size // 2)
            pair = half[: n - size + 1] * np.int64(n + 1) + half[size // 2 : n - size // 2 + 1]
            ids[size] = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        return ids[size]

    for first, stop, distance in octaves(n, least):
        size = max(1, distance // 2)
        if distinct is not None and size >= distinct:
            continue
        own = sequences(size)
        if len(own) and int(own.max()) + 1 == len(own):
            distinct = size  # nor does any longer sequence repeat
            continue
        for old in [s for s in ids if 4 < s < size]:
            del ids[old]
        ends = np.full(n + stop + size, -2, np.int64)
        ends[: len(own)] = own
        centres = np.arange(0, n, distance)
        on = np.where(centres < len(own), ends[centres], -1)
        off = np.where(centres >= size, ends[np.maximum(centres - size, 0)], -1)
        # Rows of the comparison are taken in parts, so that it stays in bounds for long documents.
        rows = max(1, (1 << 20) // (stop - first))
        for part in range(0, len(centres), rows):
            at = centres[part : part + rows, None] + np.arange(first, stop)
            alike = ends[at] == on[part : part + rows, None]
            alike |= ends[np.maximum(at - size, 0)] == off[part : part + rows, None]
            found = np.flatnonzero(alike.any(1))
            if len(found):
                yield first, distance, centres[part : part + rows][found], alike[found]


def fragments(codes: np.ndarray, least: int, dealt: int) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """Fragments (period, low, high) of a document, neighbours stitched, and the tiles to be dealt."""
    n, listed = len(codes), codes.tolist()
    found, tiles = [], []
    held: dict[int, list[int]] = {}
    for first, distance, centres, alike in candidates(codes, least):
        for c, row in zip(centres.tolist(), alike):
            periods = (np.flatnonzero(row) + first).tolist()
            low, high = max(0, c - distance), min(n, c + distance + periods[-1])
            if first >= dealt:
                tiles.append((low, c - low, distance, low > 0, high < n, periods, codes[low:high]))
                continue
            for p, a, b in solve(listed[low:high], c - low, periods, distance, low > 0, high < n, least):
                last = held.get(p)
                if last is not None and low + a <= last[1]:
                    last[1] = max(last[1], low + b)
                else:
                    if last is not None:
                        found.append((p, *last))
                    held[p] = [low + a, low + b]
    return found + [(p, *x) for p, x in held.items()], tiles


def coded(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)


_TILE = ("low", "centre", "reach", "open_left", "open_right", "periods", "tile")


def keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))


def document_fragments(documents: DataFrame, prepare: Prepare | None, least: int, dealt: int) -> DataFrame:
    """(row_key, doc_id, period, low, high) of every fragment; rows with a tile instead of a period are still to be solved."""
    fields = "period long, low long, high long, centre long, reach long, open_left boolean, open_right boolean, periods array<int>, tile array<int>"
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.list_(pa.int32())] * 2
    names = ["period", "low", "high", "centre", "reach", "open_left", "open_right", "periods", "tile"]

    def rows(keys, ids, table: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*table)) if table else [()] * len(names)
        return pa.RecordBatch.from_arrays([keys, ids, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["row_key", "doc_id", *names])

    def run(batches):
        seen = set()
        for batch in batches:
            owner, found, waiting, tiles = [], [], [], []
            id_column, texts, keys = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "row_key"))
            for i, key in enumerate(keys.to_pylist()):
                text = texts[i].as_py()
                if not text:
                    continue
                doc_id = id_column[i].as_py()
                words = prepare(doc_id, words_of(text)) if prepare else words_of(text)
                if len(words) < max(least, 2):
                    continue
                mine, far = fragments(coded(words), least, dealt)
                found += [(p, a, b, None, None, None, None, None, None) for p, a, b in mine]
                owner += [i] * len(mine)
                for low, centre, reach, left, right, periods, tile in far:
                    tiles.append((None, low, None, centre, reach, left, right, periods, tile))
                    waiting.append(i)
                    if sum(len(t[-1]) for t in tiles) > TILE_WORDS:
                        at = pa.array(waiting)
                        yield rows(keys.take(at), id_column.take(at), tiles)
                        waiting, tiles = [], []
            for at, table in ((owner, found), (waiting, tiles)):
                at = pa.array(at, pa.int64())
                yield rows(keys.take(at), id_column.take(at), table)

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return keyed(documents).mapInArrow(run, f"row_key long, doc_id {id_type}, {fields}")


def solved_tiles(tiles: DataFrame, least: int) -> DataFrame:
    """Fragments of the dealt tiles."""

    def run(batches):
        for batch in batches:
            owner, found = [], []
            for i, row in enumerate(batch.select(["low", "centre", "reach", "open_left", "open_right", "periods", "tile"]).to_pylist()):
                for p, a, b in solve(row["tile"], row["centre"], row["periods"], row["reach"], row["open_left"], row["open_right"], least):
                    owner.append(i)
                    found.append((p, row["low"] + a, row["low"] + b))
            at = pa.array(owner, pa.int64())
            columns = list(zip(*found)) if found else [(), (), ()]
            keys = [batch.column(batch.schema.get_field_index(c)).take(at) for c in ("row_key", "doc_id")]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.int64()) for c in columns)], names=["row_key", "doc_id", "period", "low", "high"])

    id_type = tiles.schema["doc_id"].dataType.simpleString()
    return tiles.mapInArrow(run, f"row_key long, doc_id {id_type}, period long, low long, high long")


def periodic_runs(documents: DataFrame, prepare: Prepare | None = None, least: int = LEAST, dealt: int = DEALT) -> DataFrame:
    """(row_key, doc_id, runs): the runs (start, period, length), in that order, of every document that has some."""
    parts = step(document_fragments(small_batches(documents), prepare, least, dealt), "period-parts")
    names = ["row_key", "doc_id", "period", "low", "high"]
    tiles = parts.where("tile is not null").repartition("row_key", "low", "centre", "reach")
    pieces = parts.where("tile is null").select(*names).unionByName(solved_tiles(tiles, least))
    by_low = Window.partitionBy("row_key", "doc_id", "period").orderBy("low", "high")
    before = F.max("high").over(by_low.rowsBetween(Window.unboundedPreceding, -1))
    begins = pieces.distinct().withColumn("begins", F.when(before.isNull() | (F.col("low") > before), 1).otherwise(0))
    stretch = (
        begins.withColumn("stretch", F.sum("begins").over(by_low))
        .groupBy("row_key", "doc_id", "period", "stretch")
        .agg(F.min("low").alias("start"), F.max("high").alias("high"))
        .where((F.col("high") - F.col("start") >= F.greatest(F.col("period"), F.lit(least) - F.col("period"))))
        .withColumn("length", F.col("high") + F.col("period") - F.col("start"))
    )
    smallest = stretch.groupBy("row_key", "doc_id", "start", "length").agg(F.min("period").alias("period"))
    runs = smallest.groupBy("row_key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    return step(runs, "period-runs")


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, period, length in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
    return b" ".join([words[i] for i in kept])


def collapse(documents: DataFrame, prepare: Prepare | None = None, least: int = LEAST, dealt: int = DEALT, digest: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed): every row's runs and its words without the repeats, one space between them.

    With ``digest`` collapsed is the SHA-256 of that text, in lowercase hex;
    then only texts of documents with runs meet them in a join, the others
    are done in the scan, told by a key filter of fixed size.
    """

    def result(text: bytes) -> str:
        return sha256(text).hexdigest() if digest else text.decode()

    rows = small_batches(documents)
    runs = periodic_runs(rows, prepare, least, dealt)
    maybe = documents.sparkSession.sparkContext.broadcast(key_filter(runs, "row_key"))
    id_type = documents.schema["doc_id"].dataType

    def scan(batches):
        for batch in batches:
            ids, texts, keys = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "row_key"))
            meets = in_filter(maybe.value, keys.to_numpy()).tolist()
            whole, done = [], []
            for doc_id, text, meet in zip(ids.to_pylist(), texts.to_pylist(), meets):
                words = None if meet else words_of(text)
                done.append(None if meet else result(b" ".join(prepare(doc_id, words) if prepare else words)))
                whole.append(text if meet else None)
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(whole, pa.string()), pa.array(done, pa.string())], names=["doc_id", "row_key", "text", "collapsed"])

    def finish(batches):
        for batch in batches:
            ids, texts, done, listed = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "collapsed", "runs"))
            out = []
            for doc_id, text, ready, found in zip(ids.to_pylist(), texts.to_pylist(), done.to_pylist(), listed.to_pylist()):
                if ready is None:
                    words = prepare(doc_id, words_of(text)) if prepare else words_of(text)
                    ready = result(collapsed(words, [(r["start"], r["period"], r["length"]) for r in found or []]))
                out.append(ready)
            yield pa.RecordBatch.from_arrays([ids, listed, pa.array(out, pa.string())], names=["doc_id", "runs", "collapsed"])

    scanned = keyed(rows).mapInArrow(scan, f"doc_id {id_type.simpleString()}, row_key long, text string, collapsed string")
    of = runs.select(F.col("row_key").alias("run_key"), F.col("doc_id").alias("run_id"), "runs")
    joined = scanned.join(of.hint("merge"), (F.col("row_key") == F.col("run_key")) & F.col("doc_id").eqNullSafe(F.col("run_id")), "left")
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    done = joined.select("doc_id", "text", "collapsed", "runs").mapInArrow(finish, schema)
    return done.withColumn("runs", F.coalesce("runs", F.array().cast(T.ArrayType(RUN))))
