"""Quality classifier: Naive Bayes support vectors over byte n-grams.

A document is the set of its hashed byte 3- and 4-grams, with one more
indicator for how many n-grams it has and which share of them is distinct
(text that repeats itself). Each indicator is scaled by the log ratio of
its smoothed class counts, n-grams also by the root of their number, and a
linear hinge-loss model is fitted on them by dual coordinate descent. A logistic curve fitted on the margins gives scores of 0 to 1.

The model is fitted on at most ``SAMPLE_ROWS`` labelled documents a class,
of ``SAMPLE_BYTES`` together at most (documented bounds: the first in hash
order of their ids); scoring reads every whole text. Null and empty texts have no n-grams and get the score
of the bias alone. Every input row gives one output row, repeated rows and
null ids included; other columns pass through under their names. Without
labelled rows of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalflow.llm.shared import held_out, returning, small_batches
from evalflow.llm.textbatch import blocks

SAMPLE_ROWS = 3000
SAMPLE_BYTES = 48 << 20
THRESHOLD = 0.3
BITS = 18
#: Steps of the distinct share, and of the number of n-grams (powers of 4).
SHARES, SIZES = 20, 8
FEATURES = (1 << BITS) + SHARES * SIZES
EPOCHS = 12
SMOOTHING = 1.0
COST = 4.0


@dataclass
class Model:
    weight: np.ndarray  # hinge weight times log-count ratio, by n-gram
    bias: float
    slope: float
    offset: float


def ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Per row the hashed 3- and 4-grams of its bytes, with repeats."""
    wide = data.astype(np.uint32)
    with np.errstate(over="ignore"):
        three = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
        four = three[:-1] | wide[3:] << 24
        shift = np.uint32(32 - BITS)
        three = ((three * np.uint32(0x9E3779B1)) ^ (three >> np.uint32(15))) * np.uint32(0x85EBCA77) >> shift
        four = ((four ^ (four >> np.uint32(13))) * np.uint32(0xC2B2AE3D) ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) >> shift
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield np.concatenate((three[a : max(a, b - 2)], four[a : max(a, b - 3)])) if b - a > 2 else three[:0]


def indicator_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row its indicators and their scales. Each n-gram writes its position under its number; the positions that stay are one for each."""
    last = np.empty(1 << BITS, np.int32)
    for _, data, offsets in blocks(column):
        for grams in ngrams(data, offsets):
            at = np.arange(len(grams), dtype=np.int32)
            last[grams] = at
            own = grams[last[grams] == at]
            share = min(SHARES - 1, SHARES * len(own) // max(1, len(grams)))
            size = min(SIZES - 1, len(grams).bit_length() // 2)
            scale = np.full(len(own) + 1, 1 / np.sqrt(max(1, len(own))))
            scale[-1] = 1.0
            yield np.append(own, (1 << BITS) + size * SHARES + share), scale


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Dual coordinate descent on rows scaled by log-count ratios."""
    y = np.where(np.asarray(labels) == 1, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return Model(np.zeros(FEATURES, np.float32), 0.0, 0.0, 0.0)
    rows = [x.astype(np.int32) for t in texts for x, _ in indicator_sets(pa.array([t], pa.large_string()))]
    counts = {c: np.full(FEATURES, SMOOTHING) for c in (1.0, -1.0)}
    for x, c in zip(rows, y):
        counts[c][x] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    ratio[(counts[1.0] + counts[-1.0]) == 2 * SMOOTHING] = 0.0

    def value(x: np.ndarray) -> np.ndarray:
        v = ratio[x]
        v[:-1] /= np.sqrt(max(1, len(x) - 1))
        return v

    square = np.array([v @ v + 1.0 for v in map(value, rows)])
    w, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(y))
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * COST
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            x, v = rows[i], value(rows[i])
            gradient = y[i] * (w[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    margin = np.array([w[x] @ value(x) + bias for x in rows])
    slope, offset = logistic(margin, (y > 0).astype(float), cost / COST)
    return Model((w * ratio).astype(np.float32), float(bias), slope, offset)


def logistic(margin: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a class-balanced logistic curve, by damped Newton steps."""
    theta = np.array([1.0, 0.0])
    design = np.stack((margin, np.ones_like(margin)), 1)
    target = target * 0.98 + 0.01
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (weight * (target - p)))
        theta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def score_column(model: Model, column: pa.Array) -> np.ndarray:
    out = np.empty(len(column))
    for i, (x, scale) in enumerate(indicator_sets(column)):
        margin = model.weight[x] @ scale + model.bias
        out[i] = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30)))
    return out


def training_rows(
    documents: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES
) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``rows`` labelled, not held out documents of each class, of ``text_bytes`` together at most.

    Chosen in hash order among the labelled ids that have a document; rows
    equal in id and text are one. Only keys are joined and ordered; the
    chosen texts are read last.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    rest = documents.select("doc_id", "text", F.xxhash64("text").alias("k"))
    keyed = rest.select("doc_id", "k", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    found = keyed.join(known, "doc_id").groupBy("doc_id", "k").agg(F.first("y").alias("y"), F.max("n").alias("n"))
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.col("k")
    upto = F.sum("n").over(Window.orderBy(*order))  # of at most ``rows`` rows
    chosen = [found.where(F.col("y") == y).orderBy(*order).limit(rows).withColumn("upto", upto).where(F.col("upto") <= text_bytes) for y in (1, 0)]
    picked = F.broadcast(chosen[0].union(chosen[1]).select("doc_id", "k", "y"))
    texts = rest.join(picked, ["doc_id", "k"]).groupBy("doc_id", "k", "y").agg(F.first("text").alias("text")).collect()
    texts.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return [r["text"] or "" for r in texts], np.array([r["y"] for r in texts], np.int64)


def score(documents: DataFrame, model: Model, output: str = "score") -> DataFrame:
    """``documents`` with a double column ``output``, replacing one of that name."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rest = small_batches(documents).drop(output)
    schema = T.StructType([*rest.schema.fields, T.StructField(output, T.DoubleType())])

    def run(batches):
        for batch in batches:
            scores = score_column(shared.value, batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, output])

    return rest.mapInArrow(returning(run), schema)


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``documents`` with held_out, score and predicted."""
    model = fit(*training_rows(documents, labels, label))
    return score(documents, model).withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
