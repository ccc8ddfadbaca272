"""Exact top-k retrieval by cosine similarity, and context lists.

Both sides stay distributed. Chunks are dealt to clusters around at most
``CLUSTERS`` centres (found on a bounded sample), each with the angle that
holds all its chunks; large clusters are cut into hash blocks of bounded
size, small ones lie together in shards of that size. No chunk of a cluster
can be closer to a query than the cluster's angle allows. So every query
first meets the clusters of highest bound that hold k chunks, and then, of
the others, only those whose bound reaches the k-th best similarity found:
on clustered vectors few, at worst all.

A query block and a shard meet in one cogroup; a query goes there once, with
the clusters that it is to meet. NumPy multiplies tiles of bounded size in
single precision; what may reach a query's k-th best, by the bound of that
product's error, is multiplied again in double precision, and each query
keeps its first k of that shard in the final order (similarity desc, chunk
id asc). The global top k lies in the union of the shards' top k under that
order, so the result is exact and ties cannot pile up. The final
``row_number() <= k`` is cut to k rows per query in each task before the
shuffle (Spark's window group limit). Row counts, the sample and one row for
each cluster reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evalflow.session import materialize

# Bytes of vectors (doubles) in one block, and of similarities (singles) in
# one tile, which is of so many queries.
BLOCK_BYTES = 32 << 20
TILE_BYTES = 2 << 20
TILE_QUERIES = 1024
# Clusters at most, and vectors that the centre of each is drawn from.
CLUSTERS = 1024
SAMPLE = 8
# Bytes of that sample.
SAMPLE_BYTES = 64 << 20
# Candidates of a tile that are ranked together with those found before.
PENDING = 1 << 14


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        return m / np.where(n > 0, n, np.nan)


def _vectors(col: pa.ChunkedArray) -> np.ndarray:
    arr = pa.concat_arrays(col.chunks) if col.num_chunks else col.combine_chunks()
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return _unit_rows(flat.reshape(len(arr), -1))


def _slack(dim: int) -> float:
    """How far a product of two unit vectors in single precision may be from that in double precision."""
    return (dim + 16) * 2.0**-24


def _first_k(r: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates that are, per query row ``r``, the first k by similarity, then by ``c``; in that order."""
    o = np.lexsort((c, -s, r))
    r = r[o]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]][: len(r)])
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    o = o[rank < k]
    return r[rank < k], c[o], s[o]


def _wanted(lists: pa.ChunkedArray, names: np.ndarray) -> np.ndarray:
    """Which of the clusters ``names`` (sorted) each query is to meet; an empty list stands for all."""
    lists = lists.combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), size)
    out = np.repeat((size == 0)[:, None], len(names), axis=1)
    value = lists.flatten().to_numpy(zero_copy_only=False)
    if not len(value):
        return out
    at = np.minimum(np.searchsorted(names, value), len(names) - 1)
    held = names[at] == value
    out[row[held], at[held]] = True
    return out


def _runs(used: np.ndarray, start: np.ndarray, stop: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Columns of the used clusters, neighbours together, at most ``width`` at a time."""
    j = np.flatnonzero(used)
    first = np.r_[True, j[1:] != j[:-1] + 1]
    for lo, hi in zip(start[j[first]], stop[j[np.r_[first[1:], True]]]):
        for a in range(lo, hi, width):
            yield a, min(a + width, hi)


def _tile_topk(q: np.ndarray, c: np.ndarray, singles: np.ndarray, wanted: np.ndarray, cluster: np.ndarray, runs, same: np.ndarray, place: np.ndarray, least: np.ndarray, k: int):
    """(query row, place, similarity) of the first k chunks of each query.

    ``runs`` are the columns to multiply; ``cluster`` has the column of
    ``wanted`` of each chunk, ``same`` the query row it must not meet.
    ``least`` is a similarity that k chunks of each query are known to reach.
    """
    slack = _slack(q.shape[1])
    q4 = q.astype("float32")
    beat = (least - slack).astype("float32")
    every = bool(wanted.all())
    room = np.empty(0, "float32")
    best = np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)
    pending = [best]

    def allowed(r: np.ndarray, col: np.ndarray) -> np.ndarray:
        fine = same[col] != r
        return fine if every else fine & wanted[r, cluster[col]]

    for n, (lo, hi) in enumerate(runs, 1):
        if len(room) < len(q) * (hi - lo):
            room = np.empty(len(q) * (hi - lo), "float32")
        s = np.matmul(q4, singles[lo:hi].T, out=room[: len(q) * (hi - lo)].reshape(len(q), -1))
        may = s.max(axis=1) >= beat
        if not every:
            may &= wanted[:, cluster[lo] : cluster[hi - 1] + 1].any(axis=1)
        rows = np.flatnonzero(may)
        if len(rows):
            s = s if len(rows) == len(s) else s[rows]
            hit = s >= beat[rows, None]
            many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * k)
            if len(many) and hi - lo > k:
                # raise the mark first: most of these are not among the first k
                top = np.where(allowed(rows[many, None], np.arange(lo, hi)[None]), s[many], np.float32(-np.inf))
                kth = np.partition(top, hi - lo - k, axis=1)[:, hi - lo - k]
                beat[rows[many]] = np.maximum(beat[rows[many]], kth - np.float32(2 * slack))
                hit[many] = top >= beat[rows[many], None]
            r, col = np.divmod(np.flatnonzero(hit), hi - lo)
            r, col = rows[r], col + lo
            fine = allowed(r, col)
            r, col = r[fine], col[fine]
            exact = np.empty(len(r))
            for b in range(0, len(r), 1 << 16):
                part = slice(b, b + (1 << 16))
                exact[part] = np.einsum("ij,ij->i", q[r[part]], c[col[part]])
            pending.append((r, place[col], exact))
        if sum(len(x[0]) for x in pending) - len(best[0]) >= PENDING or n % 64 == 0:
            best = _first_k(*(np.concatenate(x) for x in zip(*pending)), k)
            pending = [best]
            last = np.flatnonzero(np.r_[best[0][1:] != best[0][:-1], True][: len(best[0])])
            full = last[np.bincount(best[0], minlength=len(q))[best[0][last]] == k]
            at = best[0][full]
            beat[at] = np.maximum(beat[at], (best[2][full] - slack).astype("float32"))
    return _first_k(*(np.concatenate(x) for x in zip(*pending)), k)


def _block_topk(k: int, exclude_self: bool, schema: pa.Schema):
    def usable(table: pa.Table, name: str, by: str) -> tuple[pa.Table, np.ndarray]:
        order = pc.sort_indices(table[by])
        v = _vectors(table[name])[order.to_numpy()]
        table = table.drop_columns([name]).take(order)
        fine = np.isfinite(v).all(axis=1)
        return (table, v) if fine.all() else (table.filter(pa.array(fine)), v[fine])

    def run(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        if not queries.num_rows or not chunks.num_rows:
            return schema.empty_table()
        # queries of one neighbourhood and chunks of one cluster follow each other
        queries, q = usable(queries, "qv", "home")
        chunks, c = usable(chunks, "cv", "cluster")
        if not len(q) or not len(c):
            return schema.empty_table()
        # a chunk's place in the order of ids settles ties
        order = pc.sort_indices(chunks["c"]).to_numpy()
        place = np.empty(len(c), dtype="int64")
        place[order] = np.arange(len(c))
        names, start = np.unique(chunks["cluster"].to_numpy(), return_index=True)
        stop = np.r_[start[1:], len(c)]
        number = np.repeat(np.arange(len(names)), stop - start)
        least = pc.fill_null(queries["least"], -np.inf).to_numpy()
        same = np.full(len(c), -1)
        if exclude_self:
            at = pc.index_in(chunks["c"], value_set=queries["q"], skip_nulls=True)
            same = pc.fill_null(at, -1).to_numpy().astype("int64")
        singles = c.astype("float32")
        found = []
        # at first, queries meet few clusters, and the fewer the fewer of them are in a tile
        size = TILE_QUERIES if np.isfinite(least).all() else TILE_QUERIES // 8
        for a in range(0, len(q), size):
            tile = q[a : a + size]
            wanted = _wanted(queries["clusters"].slice(a, len(tile)), names)
            runs = _runs(wanted.any(axis=0), start, stop, max(1, TILE_BYTES // (4 * TILE_QUERIES)))
            own = np.where((same >= a) & (same < a + len(tile)), same - a, -1) if exclude_self else same
            r, at, s = _tile_topk(tile, c, singles, wanted, number, runs, own, place, least[a : a + len(tile)], k)
            found.append((r + a, order[at], s))
        r, col, sims = (np.concatenate(x) for x in zip(*found))
        return pa.Table.from_arrays(
            [
                queries["q"].take(pa.array(r)).combine_chunks().cast(schema.field("q").type),
                chunks["c"].take(pa.array(col)).combine_chunks().cast(schema.field("c").type),
                pa.array(sims),
            ],
            schema=schema,
        )

    return run


def usable_vector(v: Column) -> Column:
    """Present, not empty, every component finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def _blocks(rows: int, dim: int | None, block_rows: int | None) -> int:
    size = block_rows or max(1, BLOCK_BYTES // (8 * (dim or 1)))
    return max(1, -(-rows // size))


def _centres(sample: list[list[float]], n: int, rounds: int = 4) -> dict[int, np.ndarray]:
    """Unit centres by vector length, in proportion to the sample."""
    out = {}
    for dim in sorted({len(v) for v in sample}):
        m = _unit_rows(np.array([v for v in sample if len(v) == dim], dtype="float64"))
        m = m[np.isfinite(m).all(axis=1)]
        if not len(m):
            continue
        c = m[: max(1, n * len(m) // len(sample))]
        for _ in range(rounds):
            near = np.argmax(m @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, m)
            c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit_rows(sums), c)
            c = c[np.isfinite(c).all(axis=1)]
        out[dim] = c
    return out


def _by_length(vectors: pa.Array, run) -> None:
    """``run(dim, rows, unit vectors)`` for the rows of each vector length, in tiles."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        for a in range(0, len(rows), 1024):
            at = rows[a : a + 1024]
            run(int(dim), at, _vectors(pa.chunked_array([vectors.take(pa.array(at))])))


def _dealt(chunks: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``chunks`` (c, cv) with dim, cluster (-1: of a length without centres) and the cosine to the centre, but not those that nothing can find."""
    singles = {dim: m.astype("float32") for dim, m in centres.items()}

    def run(batches):
        for batch in batches:
            fine, cluster, cosine = np.zeros(len(batch), bool), np.full(len(batch), -1, "int32"), np.full(len(batch), -1.0)

            def near(dim, at, v):
                fine[at] = np.isfinite(v).all(axis=1)
                if dim in centres:
                    v = np.nan_to_num(v)
                    cluster[at] = np.argmax(v.astype("float32") @ singles[dim].T, axis=1)
                    cosine[at] = np.einsum("ij,ij->i", v, centres[dim][cluster[at]])

            _by_length(batch.column(1), near)
            dim = pc.list_value_length(batch.column(1)).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, dim, pa.array(cluster), pa.array(cosine)], names=["c", "cv", "dim", "cluster", "cosine"]).filter(pa.array(fine))

    extra = [T.StructField("dim", T.IntegerType()), T.StructField("cluster", T.IntegerType()), T.StructField("cosine", T.DoubleType())]
    return chunks.select("c", "cv").mapInArrow(run, T.StructType([*chunks.select("c", "cv").schema.fields, *extra]))


def _chain(centre: np.ndarray) -> list[int]:
    """Clusters in an order in which neighbours are close."""
    left, order = np.ones(len(centre), bool), [0]
    for _ in range(len(centre) - 1):
        left[order[-1]] = False
        order.append(int(np.argmax(np.where(left, centre @ centre[order[-1]], -np.inf))))
    return order


class _Bounds:
    """Per vector length: clusters, how many chunks and blocks each has, its first shard, and the highest cosine it allows a query."""

    def __init__(self, rows, centres: dict[int, np.ndarray], block_rows: int):
        self.of: dict[int, tuple] = {}
        self.shards = 0
        for dim in sorted({r["dim"] for r in rows}):
            mine = sorted((r["cluster"], r["low"], r["n"]) for r in rows if r["dim"] == dim)
            if dim in centres:
                mine = [mine[i] for i in _chain(centres[dim][[m[0] for m in mine]])]
            blocks = [-(-m[2] // block_rows) for m in mine]
            shard, room = [], 0
            for (_, _, n), b in zip(mine, blocks):
                if n > room:
                    room = block_rows if b == 1 else 0
                    self.shards += b
                room -= n if b == 1 else 0
                shard.append(self.shards - b)
            cluster = np.array([m[0] for m in mine])
            self.of[dim] = (
                cluster, np.clip([m[1] for m in mine], -1.0, 1.0), np.array([m[2] for m in mine]), np.array(blocks),
                centres[dim][cluster] if dim in centres else None, np.array(shard),
            )

    def table(self) -> list[tuple[int, int, int, int]]:
        """(dim, cluster, first shard, blocks) of every cluster."""
        return [(int(dim), *map(int, x)) for dim, of in self.of.items() for x in zip(of[0], of[5], of[3])]

    def bound(self, dim: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest cosine that each cluster allows, and that to its centre."""
        low, centre = self.of[dim][1], self.of[dim][4]
        if centre is None:
            one = np.where(np.isfinite(v).all(axis=1, keepdims=True), 1.0, np.nan)
            return one, one
        s = np.clip(v @ centre.T, -1.0, 1.0)
        # the angle between query and centre, less that of the cluster
        apart = s * low + np.sqrt(1 - s * s) * np.sqrt(1 - low * low)
        return np.where(s >= low, 1.0, apart) + (s - s), s

    def places(self, dim: int, chosen: np.ndarray, short: bool = False) -> pa.ListArray:
        """Per query the shards it goes to, each with the clusters to meet there; if ``short``, with none instead of all."""
        cluster, _, _, blocks, _, shard = self.of[dim]
        of = np.repeat(np.arange(len(cluster)), blocks)  # a column for each block
        to = np.repeat(shard, blocks) + np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        row, at = np.nonzero(chosen[:, of])
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (to[at[1:]] != to[at[:-1]])]) if len(row) else row
        size = np.diff(np.r_[new, len(row)])
        if short:
            whole = size == np.bincount(to, minlength=self.shards)[to[at[new]]]
            held, size = at[np.repeat(~whole, size)], np.where(whole, 0, size)
        else:
            held = at
        inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype("int32")), pa.array(cluster[of[held]].astype("int32")))
        struct = pa.StructArray.from_arrays([pa.array(to[at[new]].astype("int32")), inner], names=["shard", "clusters"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[new], np.arange(len(chosen) + 1)).astype("int32")), struct)


_PLACES = T.ArrayType(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("clusters", T.ArrayType(T.IntegerType()))]))


def _with_places(queries: DataFrame, bounds: _Bounds, need: int, later: bool) -> DataFrame:
    """``queries`` (q, qv, dim, least, before) with the shards to go to:
    first for the clusters of highest bound, then nearest centre, that hold
    ``need`` chunks; ``later`` for all the others, which are not ``before``,
    that may reach the similarity ``least``. ``home`` is the first of these
    clusters, ``before`` the numbers of those met, ``met`` of the blocks to
    meet."""
    names = ["q", "qv", "dim", "least"]

    def run(batches):
        for batch in batches:
            before = batch.column("before")
            batch = batch.select(names)
            beat = pc.fill_null(batch.column("least"), -2.0).to_numpy(zero_copy_only=False)
            out = []

            def choose(dim, at, v):
                if dim not in bounds.of:
                    return
                top, near = bounds.bound(dim, v)
                first = np.zeros(top.shape, bool)
                if later:
                    met = before.take(pa.array(at))
                    first[np.repeat(np.arange(len(at)), pc.list_value_length(met).to_numpy(zero_copy_only=False)), met.flatten().to_numpy()] = True
                    home, chosen = np.argmax(near, axis=1), ~first & (top >= beat[at, None] - 1e-7)
                else:
                    # equal bounds, such as those of clusters the query lies in, by the centre
                    order = np.argsort(-np.where(top < 1, top, 2 + near), axis=1, kind="stable")
                    held = np.cumsum(bounds.of[dim][2][order], axis=1)
                    np.put_along_axis(first, order, np.c_[np.zeros(len(at), "int64"), held[:, :-1]] < need, axis=1)
                    home, chosen = order[:, 0], first & np.isfinite(top)
                row, col = np.nonzero(chosen if not later else first)
                met = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(at) + 1)).astype("int32")), pa.array(col.astype("int32")))
                more = [met, pa.array(home.astype("int32")), pa.array(chosen @ bounds.of[dim][3]), bounds.places(dim, chosen, short=True)]
                out.append(pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, *more], names=[*names, "before", "home", "met", "places"]))

            _by_length(batch.column("qv"), choose)
            yield from out

    more = [T.StructField("before", T.ArrayType(T.IntegerType())), T.StructField("home", T.IntegerType()), T.StructField("met", T.LongType()), T.StructField("places", _PLACES)]
    return queries.select(*names, "before").mapInArrow(run, T.StructType([*(queries.schema[n] for n in names), *more]))


def search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    query_id: str = "query_id",
    chunk_id: str = "vec_id",
    vec_col: str = "embedding",
    block_rows: int | None = None,
    exclude_self: bool = False,
) -> tuple[DataFrame, dict[str, int]]:
    """``retrieve_topk``, and how many meetings of a query with a chunk block it took: ``first``, ``second``, and ``all`` there could be."""
    if block_rows is not None and block_rows < 1:
        raise ValueError("block_rows must be at least 1")

    def vec(df: DataFrame) -> Column:
        """The vector as it is, if single precision holds it; Python makes doubles of it."""
        single = df.schema[vec_col].dataType.simpleString() == "array<float>"
        return F.col(vec_col) if single else F.col(vec_col).cast("array<double>")

    q = queries.select(F.col(query_id).alias("q"), vec(queries).alias("qv")).where(usable_vector(F.col("qv"))).dropDuplicates(["q"])
    # their components are looked at where they are dealt
    c = chunks.select(F.col(chunk_id).alias("c"), vec(chunks).alias("cv")).where(F.col("cv").isNotNull() & (F.size("cv") > 0))
    n_q, dim_q = q.agg(F.count(F.lit(1)), F.max(F.size("qv"))).first()
    n_c, dim_c = c.agg(F.count(F.lit(1)), F.max(F.size("cv"))).first()
    q_blocks = _blocks(n_q, dim_q, block_rows)
    given, block_rows = block_rows, block_rows or max(1, BLOCK_BYTES // (8 * (dim_c or 1)))
    n = min(CLUSTERS, int(np.ceil(np.sqrt(n_c))), max(1, SAMPLE_BYTES // (8 * SAMPLE * (dim_c or 1))))
    sample = [r["cv"] for r in c.orderBy(F.xxhash64("c")).limit(n * SAMPLE).select("cv").collect()]
    centres = _centres(sample, n)
    dealt = materialize(_dealt(c, centres), "retrieval-chunks")
    held = dealt.groupBy("dim", "cluster").agg(F.min("cosine").alias("low"), F.count(F.lit(1)).alias("n")).collect()
    bounds = _Bounds(held, centres, block_rows)
    types = [q.schema["q"].dataType, c.schema["c"].dataType]
    if not bounds.of:
        names = zip((query_id, chunk_id, "rank", "similarity"), (*types, T.IntegerType(), T.DoubleType()))
        return queries.sparkSession.createDataFrame([], T.StructType([T.StructField(*x) for x in names])), {"first": 0, "second": 0, "all": 0}

    spark = queries.sparkSession
    width = spark.sparkContext.defaultParallelism
    if given is None:  # enough meetings for every core, as long as a block has some tiles
        q_blocks = max(q_blocks, min(-(-3 * width // bounds.shards), -(-n_q // (4 * TILE_QUERIES))))
    table = spark.createDataFrame(bounds.table(), "dim int, cluster int, first int, blocks int")
    shard = (F.col("first") + F.pmod(F.xxhash64("c"), F.col("blocks"))).cast("int").alias("shard")
    right = dealt.join(F.broadcast(table), ["dim", "cluster"]).select("c", "cv", "dim", "cluster", shard)
    left = q.select("q", "qv", F.size("qv").alias("dim"))
    left = left.repartition(max(width, q_blocks), "q").withColumns({"least": F.lit(None).cast("double"), "before": F.lit(None).cast("array<int>")})
    # few rows, much work on each: their bytes do not say how many tasks there
    # are to be; more than there are meetings, so that few of these share one
    meetings = q_blocks * bounds.shards
    tasks = max(width, min(16 * width, 8 * meetings), meetings // 2)
    schema = T.StructType(
        [
            T.StructField("q", types[0]),
            T.StructField("c", types[1]),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    run = _block_topk(k, exclude_self, to_arrow_schema(schema))
    order = Window.partitionBy("q").orderBy(F.col("similarity").desc(), F.col("c"))

    def meet(placed: DataFrame, name: str) -> tuple[DataFrame, int, DataFrame]:
        """The first k of every query among its blocks, the number of meetings, and the queries with their places."""
        placed = materialize(placed.where(F.size("places") > 0), f"{name}-places")
        keys = ["dim", "qb", "shard"]
        own = placed.select("q", "qv", "dim", "least", "home", F.explode("places").alias("p"))
        own = own.select("q", "qv", "dim", "least", "home", "p.shard", "p.clusters")
        # a shard is copied once for each block of the queries that go there
        blocks = F.ceil(F.count(F.lit(1)) / F.lit(-(-n_q // q_blocks))).alias("blocks")
        load = materialize(own.groupBy("dim", "shard").agg(blocks), f"{name}-blocks")
        own = own.join(F.broadcast(load), ["dim", "shard"]).withColumn("qb", F.pmod(F.xxhash64("q"), F.col("blocks"))).drop("blocks")
        meetings = load.select("dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("qb"))
        theirs = right.join(F.broadcast(meetings), ["dim", "shard"])
        sides = [side.repartition(tasks, *keys).groupBy(*keys) for side in (own, theirs)]
        hits = sides[0].cogroup(sides[1]).applyInArrow(run, schema)
        best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
        return materialize(best, name, tidy=True), placed.agg(F.sum("met")).first()[0] or 0, placed

    first, met, asked = meet(_with_places(left, bounds, k + exclude_self, False), "retrieval-first")
    beat = first.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("least"))
    # a query meets none again of the clusters that it was dealt first
    rest = asked.drop("least").join(beat, "q", "left")
    second, more, _ = meet(_with_places(rest, bounds, k + exclude_self, True), "retrieval-second")
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    counts = {"first": met, "second": more, "all": n_q * sum(int(of[3].sum()) for of in bounds.of.values())}
    return ranked.select(F.col("q").alias(query_id), F.col("c").alias(chunk_id), "rank", "similarity"), counts


def retrieve_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    query_id: str = "query_id",
    chunk_id: str = "vec_id",
    vec_col: str = "embedding",
    block_rows: int | None = None,
    exclude_self: bool = False,
) -> DataFrame:
    """query_id, vec_id, rank (1..k), similarity (cosine, double).

    Ids may have any type that sorts; one list comes back per query id (of
    repeated ids one vector counts) and chunk ids are taken as unique. Rows
    whose vector is null, empty, zero or not finite find nothing and are not
    found; vectors of different lengths never meet. ``exclude_self`` drops
    pairs with equal ids (a self-search of one table). Ties go to the smaller
    chunk id. A block holds at most about ``block_rows`` rows (by default 32
    MB of vectors).
    """
    return search(queries, chunks, k, query_id, chunk_id, vec_col, block_rows, exclude_self)[0]


def contexts_for(hits: DataFrame, chunks: DataFrame | None = None, query_id: str = "query_id", chunk_id: str = "vec_id") -> DataFrame:
    """Ordered context list per query (by rank). With ``chunks`` given
    (chunk_id, text, metadata) the list holds page_content/metadata structs,
    else the chunk ids. A query's list has at most k entries."""
    if chunks is not None:
        hits = hits.join(chunks, chunk_id, "left")
        item = F.struct(F.col("rank"), F.col("text").alias("page_content"), F.col("metadata"))
        grouped = hits.groupBy(query_id).agg(F.array_sort(F.collect_list(item)).alias("_l"))
        return grouped.select(
            query_id,
            F.transform("_l", lambda x: F.struct(x["page_content"].alias("page_content"), x["metadata"].alias("metadata"))).alias("contexts"),
        )
    grouped = hits.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", chunk_id))).alias("_l"))
    return grouped.select(query_id, F.transform("_l", lambda x: x[chunk_id]).alias("context_ids"))
