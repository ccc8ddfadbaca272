"""Tables, shared-folder steps and connected components for the operators."""

from __future__ import annotations

import gc
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalflow.session import materialize


def step(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, after which the driver drops what the job leaves behind.

    Spark deletes the shuffle files of a finished job once the driver's
    garbage collector has found them unused, which may be half an hour
    later; an operator of many steps would hold them all.
    """
    table_ = materialize(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return table_


#: Rounds of ``components``; each at least halves the depth, so 64 outlast any graph.
MAX_ROUNDS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns, *names: str) -> list[str]:
    """``names``, changed where needed, so that none is a column's (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of whole texts that go to a Python worker at a time.
BATCH_ROWS = 1000


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, after bounding the session's Arrow batches: texts are long, and batches stand in memory on both sides of a worker's pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return rows


#: Functions whose last result a worker keeps between its tasks, see ``kept_by_worker``.
_KEPT: list = []


def kept_by_worker(make):
    """``make``, of which a worker keeps the last result for its next tasks, until a run that does not name it lets it go (``returning``)."""
    kept = lru_cache(maxsize=1)(make)
    _KEPT.append(kept)
    return kept


def give_back(*own) -> None:
    """Lets go what the worker keeps but for ``own``, and gives back what Arrow and the allocator hold free."""
    import ctypes

    import pyarrow as pa

    for kept in _KEPT:
        if kept not in own:
            kept.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another allocator than glibc's
        pass


def returning(run, *own):
    """``run`` over batches, before and after which its worker gives back the memory that it does not use.

    Workers outlive their tasks and serve later stages; what they hold of
    one stage would count against the others. ``own`` are the functions
    ``kept_by_worker`` that ``run`` calls.
    """

    def wrapped(batches):
        from evalflow.llm import shared

        shared.give_back(*own)
        yield from run(batches)
        shared.give_back(*own)

    return wrapped


def held_out() -> F.Column:
    """The rows no classifier may learn from: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


#: Bits of a key filter: 1 MB, whatever the input.
FILTER_BITS = 1 << 23


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size with a bit set for every long of ``column``.

    A scan that looks keys up in it before its rows are shuffled to the
    real join sends few in vain while keys are fewer than bits, and loses
    none ever. Its words, at most FILTER_BITS / 64 rows, go to the driver.
    """
    bit = F.pmod(column, F.lit(FILTER_BITS))
    words = keys.select(F.floor(bit / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("b"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        out[row["w"]] = row["b"]
    return out


def in_filter(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (int64) may be in the filter; those left out are not."""
    bit = np.mod(keys, FILTER_BITS)
    return (words[bit >> 6] >> (bit & 63)) & 1 == 1


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest
    node reachable.

    Alternating large-star and small-star rounds: every node points its
    larger (smaller) neighbours at the smallest node it sees, until each
    component is a star. Both steps are a pre-aggregated minimum and a
    join, so a node with very many neighbours is split like any skewed
    join key. Each round is written to the shared folder, which bounds
    the lineage; only a row count and a checksum reach the driver.
    """
    e = materialize(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        name,
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = large.where("u > v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            e.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
        )
        e = materialize(small.where("u > v").distinct(), name)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components of {name} did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
