"""Ranked lexical search by Block-Max MaxScore over a sharded index.

``build_index`` reads every document: a shard is up to ``SHARD_ROWS`` rows
or ``SHARD_BYTES`` of text of one task, its rows numbered by ascending
doc_id (nulls last). A term's list in a shard is cut into blocks of
``BLOCK`` postings, each a document number (as the distance from the one
before) and the term's impact there in five bytes; a block's last number
and greatest impact stand beside it. An impact is what a term adds to a
document's score, but for the term's weight: it needs no more than the
corpus counts N and L, taken in a pass before.

``search`` brings the lists of the queries' terms, and no other, to their
shards and works through a shard in windows of documents. With the tenth
best score so far as threshold, lists whose greatest scores together do
not exceed it are not essential: a document in none of the others cannot
rank. So essential lists are read, and of a window's documents so found
the others' block maxima reject all that cannot pass the threshold any
more, before a block of theirs is decoded. The shards' best are merged.

Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z
lowered. A shard tells terms apart by a 64-bit hash; lists and queries meet
on the terms themselves. Null, empty and blank texts have no terms: such
documents count nowhere, such items get no rows. Repeated documents each
count and rank; documents without an id too, after their equals. Items are
told apart by item_id and text, repeated ones are one. Other columns are
not read. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalflow.llm.shared import small_batches, step
from evalflow.llm.textbatch import Words, blocks, word_table

SHARD_ROWS = 1 << 15
SHARD_BYTES = 32 << 20
BLOCK = 128
#: Bytes of a posting: two of the distance (numbers stay below 2 ** 16), three of the impact (below 10 ** 6).
POSTING = 5
#: First and largest window, in documents.
WINDOWS = 512, 8192
#: Items searched together.
ITEMS = 512
#: Parts that a term's lists are dealt to where they meet the queries' terms.
SALTS = 32
TOP = 10

#: Fixed value: the ASCII characters between terms.
TABLE = word_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


@dataclass
class Index:
    """lists: (shard, term, n, lasts, tops, payload); shards: (shard, ids); n_documents, n_terms: N and L."""

    lists: DataFrame
    shards: DataFrame
    n_documents: int
    n_terms: int
    block: int = BLOCK


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def corpus_counts(documents: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""

    def run(batches):
        for batch in batches:
            sizes = [np.diff(Words(data, offsets, TABLE).first) for _, data, offsets in blocks(batch.column(0))]
            n, terms = sum(int((x > 0).sum()) for x in sizes), sum(int(x.sum()) for x in sizes)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([terms], pa.int64())], names=["n", "terms"])

    row = documents.select("text").mapInArrow(run, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


class Shard:
    """Postings of a task's documents until they are written."""

    def __init__(self, n_documents: int, n_terms: int):
        self.counts = n_documents, max(1, n_terms)
        self.names: dict[int, bytes] = {}
        self.ids: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = self.size = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        for row, data, offsets in blocks(texts):
            words = Words(data, offsets, TABLE)
            n = np.diff(words.first)
            self.size += len(data)
            if not len(words.hash):
                continue
            hashes, first, term = np.unique(words.hash, return_index=True, return_inverse=True)
            owner = np.repeat(np.arange(len(n)), n)
            pair, tf = np.unique(owner * np.int64(len(hashes)) + term, return_counts=True)
            owner, term = np.divmod(pair, len(hashes))
            m = 100 - 75 + 75 * n * self.counts[0] // self.counts[1]
            self.parts.append((hashes[term], (owner + self.rows + row).astype(np.int32), impact(tf, m[owner]).astype(np.int32)))
            raw = words.text.tobytes()
            for h, a, b in zip(hashes.tolist(), words.start[first].tolist(), words.end[first].tolist()):
                if h not in self.names:
                    self.names[h] = raw[a:b]
        self.ids.append(ids)
        self.rows += len(ids)

    def tables(self, shard: int, block: int):
        """The shard's rows, its ids first."""
        ids = pa.concat_arrays(self.ids).cast(pa.int64())
        order = pc.sort_indices(ids, null_placement="at_end")
        number = np.empty(self.rows, np.int32)
        number[order.to_numpy()] = np.arange(self.rows)
        none = pa.nulls(1, pa.int64())
        yield (
            pa.array([shard], pa.int64()), pa.nulls(1, pa.string()), none, pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, self.rows], pa.int32()), ids.take(order)),
        )
        if not self.parts:
            return
        term, doc, worth = (np.concatenate([p[j] for p in self.parts]) for j in range(3))
        self.parts.clear()
        doc = number[doc]
        order = np.lexsort((doc, term))
        term, doc, worth = term[order], doc[order], worth[order]
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        sizes = np.diff(np.append(starts, len(term)))
        place = np.arange(len(term)) - np.repeat(starts, sizes)
        opens = np.flatnonzero(place % block == 0)
        ends = np.append(opens[1:], len(term)) - 1
        gap = np.diff(doc, prepend=np.int32(0))
        gap[opens] = doc[opens]
        packed = np.empty((len(term), POSTING), np.uint8)
        packed[:, :2] = gap.astype("<u2")[:, None].view(np.uint8).reshape(-1, 2)
        packed[:, 2:] = worth.astype("<u4")[:, None].view(np.uint8).reshape(-1, 4)[:, :3]
        lasts, tops = doc[ends], np.maximum.reduceat(worth, opens)
        block_at = np.append(np.searchsorted(opens, starts), len(opens))
        hashes = term[starts].tolist()
        for a in range(0, len(starts), 1 << 14):
            b = min(len(starts), a + (1 << 14))
            low, high = int(starts[a]), int(starts[b - 1] + sizes[b - 1])
            at = np.append(starts[a:b], high) - low
            of = block_at[a : b + 1]
            listed = lambda x: pa.ListArray.from_arrays(pa.array((of - of[0]).astype(np.int32)), pa.array(x[of[0] : of[-1]], pa.int32()))
            payload = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at * POSTING).astype(np.int32).tobytes()), pa.py_buffer(packed[low:high].tobytes())])
            names = pa.array([self.names[h] for h in hashes[a:b]], pa.binary()).cast(pa.string())
            yield pa.array(np.full(b - a, shard)), names, pa.array(sizes[a:b], pa.int64()), listed(lasts), listed(tops), payload, pa.nulls(b - a, pa.list_(pa.int64()))


def build_index(documents: DataFrame, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> Index:
    """Written under the checkpoint folder; holds every row of ``documents`` (doc_id an integer, text)."""
    if shard_rows >= 1 << 16:
        raise ValueError("a shard's document numbers have 16 bits")
    rows = small_batches(documents.select("doc_id", "text"))
    n_documents, n_terms = corpus_counts(rows)
    names = ["shard", "term", "n", "lasts", "tops", "payload", "ids"]

    def run(batches):
        first, count = TaskContext.get().partitionId() << 32, 0
        shard = Shard(n_documents, n_terms)
        for batch in batches:
            for at in range(0, len(batch), shard_rows):
                part = batch.slice(at, min(shard_rows, len(batch) - at))
                if shard.rows + len(part) > shard_rows:
                    yield from (pa.RecordBatch.from_arrays(list(x), names=names) for x in shard.tables(first + count, block))
                    shard, count = Shard(n_documents, n_terms), count + 1
                shard.add(part.column(0), part.column(1))
                if shard.size >= shard_bytes:
                    yield from (pa.RecordBatch.from_arrays(list(x), names=names) for x in shard.tables(first + count, block))
                    shard, count = Shard(n_documents, n_terms), count + 1
        if shard.rows:
            yield from (pa.RecordBatch.from_arrays(list(x), names=names) for x in shard.tables(first + count, block))

    schema = "shard long, term string, n long, lasts array<int>, tops array<int>, payload binary, ids array<long>"
    written = step(rows.mapInArrow(run, schema), "ranked-index")
    return Index(written.where("term is not null").drop("ids"), written.where("term is null").select("shard", "ids"), n_documents, n_terms, block)


def query_terms(items: DataFrame) -> DataFrame:
    """(item_key, term, times) of every item."""

    def run(batches):
        for batch in batches:
            keys, found, times = [], [], []
            for i, text in enumerate(batch.column(1)):
                own: dict[bytes, int] = {}
                for _, data, offsets in blocks(pa.array([text.as_py()], pa.string())):
                    words = Words(data, offsets, TABLE)
                    raw = words.text.tobytes()
                    for a, b in zip(words.start.tolist(), words.end.tolist()):
                        own[raw[a:b]] = own.get(raw[a:b], 0) + 1
                keys += [i] * len(own)
                found += own
                times += own.values()
            columns = [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(found, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item_key", "term", "times"])

    return items.select("item_key", "text").mapInArrow(run, "item_key long, term string, times long")


class Postings:
    """A term's list in a shard; ``decoded`` counts the blocks read."""

    def __init__(self, weight: int, lasts: np.ndarray, tops: np.ndarray, payload: bytes, n: int, block: int):
        self.weight, self.lasts, self.tops = weight, lasts, tops.astype(np.int64)
        self.bound = weight * int(tops.max())
        self.raw, self.n, self.block = np.frombuffer(payload, np.uint8).reshape(-1, POSTING), n, block
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.decoded = 0

    def read(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and scores of a block."""
        found = self.kept.get(b)
        if found is None:
            self.decoded += 1
            x = self.raw[b * self.block : (b + 1) * self.block].astype(np.int64)
            found = self.kept[b] = np.cumsum(x[:, 0] | x[:, 1] << 8), (x[:, 2] | x[:, 3] << 8 | x[:, 4] << 16) * self.weight
        return found


def best_of(lists: list[tuple[Postings, int]], n_rows: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` document numbers and scores of a query, given as (list, times)."""
    lists = sorted(lists, key=lambda x: x[0].bound * x[1])
    upto = np.cumsum([p.bound * times for p, times in lists])  # greatest score from lists 0 .. i alone
    docs, scores, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    low, width = 0, WINDOWS[0]
    while low < n_rows:
        high = min(n_rows, low + width)
        spare = int(np.searchsorted(upto, threshold, "right"))  # lists that are not essential
        if spare == len(lists):
            break
        sums = np.zeros(high - low, np.int64)
        for p, times in lists[spare:]:
            for b in range(int(np.searchsorted(p.lasts, low)), min(len(p.lasts), int(np.searchsorted(p.lasts, high - 1)) + 1)):
                d, s = p.read(b)
                inside = slice(*np.searchsorted(d, (low, high)))
                sums[d[inside] - low] += s[inside] * times
        found = np.flatnonzero(sums)
        for i in range(spare - 1, -1, -1):
            found = found[sums[found] + upto[i] > threshold]
            if not len(found):
                break
            p, times = lists[i]
            at = np.searchsorted(p.lasts, found + low)
            inside = at < len(p.lasts)
            most = np.where(inside, p.tops[np.minimum(at, len(p.lasts) - 1)] * (p.weight * times), 0)
            passes = sums[found] + most + (upto[i - 1] if i else 0) > threshold
            found, at, inside = found[passes], at[passes], inside[passes]
            for b in np.unique(at[inside]).tolist():
                d, s = p.read(b)
                mine = found[at == b]
                k = np.minimum(np.searchsorted(d, mine + low), len(d) - 1)
                same = d[k] == mine + low
                sums[mine[same]] += s[k[same]] * times
        found = found[sums[found] > threshold]
        if len(found):
            docs, scores = np.append(docs, found + low), np.append(scores, sums[found])
            order = np.lexsort((docs, -scores))[:top]
            docs, scores = docs[order], scores[order]
            if len(docs) == top:
                threshold = int(scores[-1])
        low, width = high, min(2 * width, WINDOWS[1])
    return docs, scores


def search(index: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the documents of highest score above 0 for every item, equal scores by ascending doc_id."""
    items = items.select("item_id", "text", F.xxhash64("item_id", "text").alias("item_key")).dropDuplicates(["item_key"])
    n_blocks = max(1, -(-items.count() // ITEMS))
    asked = query_terms(items).withColumn("part", F.pmod("item_key", F.lit(n_blocks)))
    askers = asked.groupBy("part", "term").agg(F.collect_list(F.struct("item_key", "times")).alias("askers"))
    salted = askers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = index.lists.withColumn("salt", F.pmod(F.hash("shard"), F.lit(SALTS))).join(salted, ["term", "salt"]).drop("salt")
    met = step(met, "ranked-lists")
    df = met.groupBy("part", "term").agg(F.sum("n").alias("df"))
    block = index.block
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2 * index.n_documents + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weighted = met.join(df.select("part", "term", weight.alias("weight")), ["part", "term"]).select(
        "shard", "part", "term", "n", "lasts", "tops", "payload", "askers", "weight", F.lit(None).cast("array<long>").alias("ids")
    )
    parts = index.shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")))
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in weighted.schema.fields}
    numbers = parts.select(*(F.col(c) if c in ("shard", "part", "ids") else empty[c] for c in weighted.columns))

    def shard(group: pa.Table) -> pa.Table:
        out = [[], [], []]
        ids, by_item = None, {}
        for batch in group.to_batches():
            for row in range(len(batch)):
                value = lambda c: batch.column(c)[row]  # noqa: E731, B023
                if not value("term").is_valid:
                    ids = value("ids").values
                    continue
                lasts, tops = (value(c).values.to_numpy() for c in ("lasts", "tops"))
                p = Postings(value("weight").as_py(), lasts, tops, value("payload").as_py(), value("n").as_py(), block)
                if p.weight:
                    for asker in value("askers").as_py():
                        by_item.setdefault(asker["item_key"], []).append((p, asker["times"]))
        for key, lists in by_item.items():
            docs, scores = best_of(lists, len(ids), top)
            out[0] += [key] * len(docs)
            out[1] += ids.take(pa.array(docs)).to_pylist()
            out[2] += scores.tolist()
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("item_key", "doc_id", "score"), out)})

    found = weighted.unionByName(numbers).groupBy("shard", "part").applyInArrow(shard, "item_key long, doc_id long, score long")
    order = Window.partitionBy("item_key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(items.select("item_key", "item_id"), "item_key").select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL for op11_ranked_search, with the parameters above.
ORACLE_SQL = r"""
WITH dt AS (
  SELECT d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)),
qt AS (
  SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
len AS (SELECT d, count(*)::BIGINT AS n FROM dt GROUP BY d),
c AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM len),
tf AS (SELECT d, any_value(doc_id) AS doc_id, t, count(*)::BIGINT AS tf FROM dt WHERE t IN (SELECT t FROM qt) GROUP BY d, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY t),
p AS (
  SELECT d, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l))) AS s
  FROM tf JOIN len USING (d) JOIN w USING (t), c),
s AS (SELECT item_id, text, d, any_value(doc_id) AS doc_id, sum(s)::BIGINT AS score FROM qt JOIN p USING (t) GROUP BY item_id, text, d)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) <= 10
"""
