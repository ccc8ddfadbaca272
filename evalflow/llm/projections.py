"""Embedding near-dedup by collision counting on one-dimensional projections.

Vectors of one label (and length) are projected on ``DIRECTIONS`` random
directions. Sorted by the leading one they are cut into blocks of equal
depth; two blocks meet in a tile unless the gap between them exceeds the
leading window. In a tile every vector centres a window on its own value
in each projection; the collisions of a pair are counted over all
directions, and pairs that reach the calibrated count are verified by
cosine in double precision.

The window is ``WIDTH`` deviations that a projection has at the threshold's
distance. A linked pair then collides in a direction with known
probability at least, and the count is the largest that a binomial of it
reaches with ``RECALL``. A window holds a constant share of a label, so
counting is quadratic in a label's distinct vectors, by tiles of bounded
memory; a tile gives sums of links and a spanning forest, never pairs.

Equal vectors are one vector with a count. Null labels, and vectors that
are null, zero or hold null or non-finite components, link with nothing;
so do vectors of different lengths. Every input row gives one output row;
rows without a vec_id are their own, without links. Other columns go.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalflow.llm.shared import components
from evalflow.session import materialize

THRESHOLD = 0.93
DIRECTIONS = 24
WIDTH = 2.0
RECALL = 0.9999
#: Deviations of the leading window, for pairs of blocks.
LEAD = 4.0
BLOCK = 1024
QUANTILES = 256
#: Pairs verified at a time.
CHUNK = 1 << 15


def window(threshold: float) -> float:
    return WIDTH * sqrt(2 - 2 * threshold)


def least_count(directions: int = DIRECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """Largest count that a linked pair reaches with probability ``recall`` or more."""
    p, tail = erf(width / sqrt(2)), 0.0
    for c in range(directions, -1, -1):
        tail += comb(directions, c) * p**c * (1 - p) ** (directions - c)
        if tail >= recall:
            return c
    return 0


def directions(length: int) -> np.ndarray:
    return np.random.default_rng(20 + length).standard_normal((length, DIRECTIONS))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, length)


def tile_links(left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (row of left, row of right); within one block each pair once."""
    size = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (left, right)]
    axes = directions(left.shape[1])
    a, b = ((x / s[:, None] @ axes).astype(np.float32) for x, s in zip((left, right), size))
    w = np.float32(window(threshold))
    count = np.zeros((len(a), len(b)), np.int8)
    for j in range(DIRECTIONS):
        count += np.abs(a[:, j, None] - b[None, :, j]) <= w
    u, v = np.nonzero(count >= least_count())
    if same:
        u, v = u[u < v], v[u < v]
    keep = np.zeros(len(u), bool)
    for i in range(0, len(u), CHUNK):
        x, y = u[i : i + CHUNK], v[i : i + CHUNK]
        keep[i : i + CHUNK] = np.einsum("ij,ij->i", left[x], right[y]) / (size[0][x] * size[1][y]) >= threshold
    return u[keep], v[keep]


def lowest(nodes: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node that each reaches over the pairs (u, v)."""
    low = np.arange(nodes)
    while True:
        new = low.copy()
        np.minimum.at(new, u, low[v])
        np.minimum.at(new, v, low[u])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def links(rows: DataFrame, vec_id: str, label: str, embedding: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors (label, embedding, rep, copies), and (node, n, to): links of each and its spanning edges, by tile."""
    usable = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    e = F.col(embedding).cast("array<double>")
    vectors = rows.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), e.alias("e")).where(F.col("label").isNotNull() & F.col("e").isNotNull() & usable)
    distinct = vectors.groupBy("label", "e").agg(F.min("id").alias("rep"), F.count("id").alias("copies")).where("rep is not null")
    distinct = materialize(distinct.withColumn("size", F.size("e")), "vectors")

    def lead(batches):
        for batch in batches:
            size, column = np.asarray(batch.column(1)), batch.column(0)
            out = np.empty(len(size))
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = matrix(column.take(pa.array(at)), int(n))
                out[at] = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] @ directions(int(n))[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "p"])

    kind = distinct.schema["label"].dataType.simpleString()
    id_type = distinct.schema["rep"].dataType.simpleString()
    placed = distinct.select("e", "size", "label", "rep", "copies").mapInArrow(lead, f"e array<double>, size int, label {kind}, rep {id_type}, copies long, p double")
    cuts = placed.groupBy("label", "size").agg(
        F.percentile_approx("p", [i / QUANTILES for i in range(1, QUANTILES)], 10000).alias("cuts"), F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")
    )
    quantile = F.size(F.filter("cuts", lambda c: c < F.col("p")))
    fine = F.ceil(F.col("blocks") / QUANTILES)  # blocks within a quantile, dealt by hash
    block = F.when(F.col("blocks") <= QUANTILES, F.floor(quantile * F.col("blocks") / QUANTILES)).otherwise(
        quantile * fine + F.pmod(F.xxhash64("rep"), fine)
    )
    placed = materialize(placed.join(cuts, ["label", "size"]).withColumn("block", block.cast("long")).drop("cuts", "blocks"), "vectors")

    ends = placed.groupBy("label", "size", "block").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    reach = LEAD / WIDTH * window(threshold)
    one = ends.select("label", "size", F.col("block").alias("x"), F.col("high").alias("x_high"), F.col("low").alias("x_low"))
    two = ends.select("label", "size", F.col("block").alias("y"), F.col("low").alias("y_low"), F.col("high").alias("y_high"))
    tiles = one.join(two, ["label", "size"]).where((F.col("x") <= F.col("y")) & (F.col("y_low") - F.col("x_high") <= reach) & (F.col("x_low") - F.col("y_high") <= reach))
    tiles = tiles.select("label", "size", "x", "y")
    side = placed.select("label", "size", "block", "rep", "copies", "e")
    dealt = (
        side.withColumnRenamed("block", "x").join(tiles, ["label", "size", "x"]).select("label", "size", "x", "y", F.lit(0).alias("side"), "rep", "copies", "e")
    ).unionByName(
        side.withColumnRenamed("block", "y")
        .join(tiles.where("x < y"), ["label", "size", "y"])
        .select("label", "size", "x", "y", F.lit(1).alias("side"), "rep", "copies", "e")
    )

    def tile(group: pa.Table) -> pa.Table:
        size = group.column("size")[0].as_py()
        same = group.column("x")[0] == group.column("y")[0]
        part = np.asarray(group.column("side"))
        at = [np.flatnonzero(part == s) for s in (0, 1)]
        if same:
            at[1] = at[0]
        x, y = (matrix(group.column("e").take(pa.array(i)), size) for i in at)
        u, v = tile_links(x, y, same, threshold)
        u, v = at[0][u], at[1][v]
        copies = np.asarray(group.column("copies"))
        n = np.bincount(u, copies[v], len(part)) + np.bincount(v, copies[u], len(part))
        node = np.flatnonzero(n)
        to = lowest(len(part), u, v)[node]
        rep = group.column("rep")
        return pa.table({"node": rep.take(pa.array(node)), "n": pa.array(n[node].astype(np.int64)), "to": rep.take(pa.array(to))})

    found = dealt.groupBy("label", "size", "x", "y").applyInArrow(tile, f"node {id_type}, n long, to {id_type}")
    return distinct, materialize(found, "vector-links")


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``rows``."""
    distinct, found = links(rows, vec_id, label, embedding, threshold)
    near = found.groupBy("node").agg(F.sum("n").alias("n"))
    linked = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")), "vector-components").withColumnRenamed("node", "member")
    of = distinct.select("label", "e", "rep", "copies").withColumnsRenamed({"label": "of_label", "e": "of_e"})
    mine = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    own = mine.join(of, (F.col("label") == F.col("of_label")) & (F.col("e") == F.col("of_e")) & F.col("vec_id").isNotNull(), "left")
    out = own.join(near, F.col("rep") == F.col("node"), "left").join(linked, F.col("rep") == F.col("member"), "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id",
        (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
