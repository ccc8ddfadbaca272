"""Toxicity classifier: a bidirectional gated recurrent network with attention pooling.

Words (runs of ASCII letters, digits and non-ASCII characters, lower-cased)
enter as two views side by side: the word's embedding, if ``MIN_DOCUMENTS``
training documents or more hold it, and the mean of hashed
character-trigram embeddings. Two gated recurrent layers read each window
of ``WINDOW`` words, one in each direction; attention pools their states
into one logit. Windows overlap by half and cover the whole text; a
document's logit is that of its highest window.

The network is trained in numpy on at most ``SAMPLE_ROWS`` labelled rows a
class, of ``SAMPLE_BYTES`` together at most (documented bounds), by Adam on
each document's highest window. So that few labels are not learned by
heart, words are left out at random while training, embeddings decay, and
the parameters kept are those of the epoch that does best on a part of the
rows which is not trained on (with ``CHECKED`` rows of a class or more
there; else those of the last).

Null and empty texts, and texts without a word, have the score of an empty
window. Every input row gives one output row; null ids and repeated rows
are scored like any other, other columns pass through. Without labelled
rows of both classes every score is 0.5; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalflow.llm.quality import training_rows
from evalflow.llm.shared import held_out, returning, small_batches
from evalflow.llm.textbatch import BYTE_VALUE, Words, blocks, mix, word_table

SAMPLE_ROWS = 1500
THRESHOLD = 0.5
WINDOW, STRIDE = 32, 16
HIDDEN, EMBED = 8, 12
#: Words with an embedding of their own at most, and training documents that hold each at least.
WORD_ROWS, MIN_DOCUMENTS = 1 << 14, 3
GRAM_ROWS = 1 << 12
EPOCHS, BATCH, RATE = 10, 48, 0.01
#: Training steps at least; few rows are read more often.
STEPS = 640
#: Share of words left out in a training step, and what embeddings lose of themselves in one, as a multiple of its rate.
LEFT_OUT, DECAY = 0.5, 0.02
#: Scale of the log ratios that embeddings start from.
START = 0.3
#: One labelled row in so many is kept for choosing the epoch, if that leaves so many of each class.
CHECK_SHARE, CHECKED = 6, 20
#: Windows of a scoring step, which bounds its memory.
TILE = 2048

TABLE = word_table(bytes(b for b in range(128) if not chr(b).isalnum()))
Params = dict[str, np.ndarray]


def known_words(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words that ``MIN_DOCUMENTS`` texts or more hold, the most widespread up to ``WORD_ROWS`` - 1,
    and for each the log ratio of the shares of label 1 and label 0 texts that hold it."""
    found, owner, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for _, data, offsets in blocks(pa.array(texts, pa.large_string())):
        words = Words(data, offsets, TABLE)
        for a, b in zip(words.first[:-1], words.first[1:]):
            found.append(np.unique(words.hash[a:b]))
            owner.append(np.full(len(found[-1]), labels[at]))
            at += 1
    word, of, documents = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    one = np.bincount(of, np.concatenate(owner), len(word))
    order = np.lexsort((word, -documents))[: WORD_ROWS - 1]
    keep = np.sort(order[documents[order] >= MIN_DOCUMENTS])
    one, documents = one[keep], documents[keep]
    n_one = labels.sum()
    ratio = np.log((one + 0.5) / (n_one + 1)) - np.log((documents - one + 0.5) / (len(texts) - n_one + 1))
    return word[keep], ratio.astype(np.float32)


def start_params(known: np.ndarray, ratio: np.ndarray, seed: int = 11) -> Params:
    """Random, but for the words' first component, which starts at their log ratio."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {
        "known": known,
        "word": (0.1 * rng.standard_normal((len(known) + 1, EMBED))).astype(np.float32),  # row 0: all other words
        "gram": (0.3 * rng.standard_normal((GRAM_ROWS, EMBED))).astype(np.float32),
        "attend": draw(2 * HIDDEN, HIDDEN),
        "focus": draw(HIDDEN),
        "out": draw(2 * HIDDEN),
        "bias": np.zeros(1, np.float32),
    }
    p["word"][1:, 0] = START * ratio
    p["word"][0] = 0
    for d in "fb":
        p[f"in_{d}"] = draw(2 * EMBED, 3 * HIDDEN)
        p[f"step_{d}"] = draw(HIDDEN, 3 * HIDDEN)
        p[f"base_{d}"] = np.zeros(3 * HIDDEN, np.float32)
    return p


class Vocabulary:
    """Distinct words of a block: word row and character-trigram rows of each."""

    def __init__(self, words: Words, known: np.ndarray):
        distinct, first, self.of = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(known, distinct)
        own = known[np.minimum(at, len(known) - 1)] == distinct if len(known) else np.zeros(len(distinct), bool)
        self.word = np.where(own, at + 1, 0).astype(np.int32)
        start, end = words.start[first], words.end[first]
        size = end - start
        # trigrams of the word between two marks: positions -1 .. size - 2
        n = np.maximum(size, 1)
        self.owner = np.repeat(np.arange(len(size)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) - 1
        begin, stop = np.repeat(start, n), np.repeat(end, n)
        code = np.zeros(len(inside), np.uint64)
        text = words.text if len(words.text) else np.zeros(1, np.uint8)
        with np.errstate(over="ignore"):
            for j in range(3):
                at = begin + inside + j
                ok = (at >= begin) & (at < stop)
                byte = np.where(ok, BYTE_VALUE[text[np.clip(at, 0, len(text) - 1)]], np.uint64(0x5851F42D4C957F2D))
                code = mix(code + byte)
        self.gram = (code % np.uint64(GRAM_ROWS)).astype(np.int32)
        self.starts = np.cumsum(n) - n
        self.count = n.astype(np.float32)

    def inputs(self, p: Params) -> np.ndarray:
        if not len(self.word):
            return np.zeros((0, 2 * EMBED), np.float32)
        grams = np.add.reduceat(p["gram"][self.gram], self.starts, axis=0) / self.count[:, None]
        return np.concatenate((p["word"][self.word], grams), 1)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of every window, and each row's first window. Rows without words have one empty window."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    begin = np.cumsum(count) - count
    k = np.arange(count.sum()) - np.repeat(begin, count)
    start = np.repeat(first[:-1], count) + k * STRIDE
    return start, np.clip(np.repeat(first[1:], count) - start, 0, WINDOW), begin


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: Params, gates: dict[str, np.ndarray], ids: np.ndarray, size: np.ndarray, keep: bool = False):
    """Logits of windows. gates: each word's input part by direction. ids: word number of each step. keep: also what ``backward`` needs."""
    rows = len(ids)
    mask = (np.arange(WINDOW)[None, :] < size[:, None]).astype(np.float32)
    states = np.zeros((WINDOW, rows, 2 * HIDDEN), np.float32)
    trace: dict[str, list] = {"f": [], "b": []}
    for d, order, part in (("f", range(WINDOW), slice(0, HIDDEN)), ("b", range(WINDOW - 1, -1, -1), slice(HIDDEN, None))):
        h = np.zeros((rows, HIDDEN), np.float32)
        step = p[f"step_{d}"]
        for t in order:
            x = gates[d][ids[:, t]]
            u = h @ step
            rz = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            m = mask[:, t : t + 1]
            new = h + m * (1 - z) * (n - h)
            if keep:
                trace[d].append((t, h, r, z, n, u[:, 2 * HIDDEN :], m))
            h = new
            states[t][:, part] = h
    hidden = np.tanh(states @ p["attend"])
    raw = hidden @ p["focus"] + (mask.T - 1) * 1e4
    weight = np.exp(raw - raw.max(0)) * mask.T
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    logit = pooled @ p["out"] + p["bias"][0]
    return (logit, (states, hidden, weight, pooled, trace)) if keep else logit


def backward(p: Params, vocabulary: Vocabulary, x: np.ndarray, ids: np.ndarray, kept, slope: np.ndarray) -> Params:
    """Gradients of all parameters. slope: the loss's by logit."""
    states, hidden, weight, pooled, trace = kept
    g = {"out": pooled.T @ slope, "bias": np.array([slope.sum()])}
    d_pooled = slope[:, None] * p["out"][None, :]
    d_states = weight[:, :, None] * d_pooled[None]
    d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
    d_raw = weight * (d_weight - (weight * d_weight).sum(0))
    g["focus"] = np.einsum("tb,tbh->h", d_raw, hidden)
    d_hidden = d_raw[:, :, None] * p["focus"] * (1 - hidden**2)
    g["attend"] = np.einsum("tbi,tbj->ij", states, d_hidden)
    d_states = d_states + d_hidden @ p["attend"].T
    d_x = np.zeros_like(x)
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        step, d_step, d_gates = p[f"step_{d}"], np.zeros_like(p[f"step_{d}"]), np.zeros((len(x), 3 * HIDDEN), np.float32)
        d_h = np.zeros((len(ids), HIDDEN), np.float32)
        for t, h, r, z, n, u, m in reversed(trace[d]):
            d_h = d_h + d_states[t][:, part]
            d_n = d_h * m * (1 - z) * (1 - n**2)
            d_z = d_h * m * (h - n) * z * (1 - z)
            d_r = d_n * u * r * (1 - r)
            d_u = np.concatenate((d_r, d_z, d_n * r), 1)
            np.add.at(d_gates, ids[:, t], np.concatenate((d_r, d_z, d_n), 1))
            d_step += h.T @ d_u
            d_h = d_h * (1 - m * (1 - z)) + d_u @ step.T
        g[f"step_{d}"], g[f"in_{d}"], g[f"base_{d}"] = d_step, x.T @ d_gates, d_gates.sum(0)
        d_x += d_gates @ p[f"in_{d}"].T
    d_x *= x.any(1)[:, None]  # words left out
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    np.add.at(g["word"], vocabulary.word, d_x[:, :EMBED])
    np.add.at(g["gram"], vocabulary.gram, (d_x[:, EMBED:] / vocabulary.count[:, None])[vocabulary.owner])
    return g


def word_gates(p: Params, x: np.ndarray) -> dict[str, np.ndarray]:
    """Input parts by word and direction; the last row stands for no word."""
    x = np.concatenate((x, np.zeros((1, 2 * EMBED), np.float32)))
    return {d: x @ p[f"in_{d}"] + p[f"base_{d}"] for d in "fb"}


def window_ids(vocabulary: Vocabulary, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)[None, :]
    of = np.append(vocabulary.of, len(vocabulary.word))
    return np.where(np.arange(WINDOW)[None, :] < size[:, None], of[np.minimum(at, len(of) - 1)], len(vocabulary.word))


def block_windows(p: Params, data: np.ndarray, offsets: np.ndarray, rng: np.random.Generator | None = None) -> tuple:
    """Vocabulary, inputs, gates, windows and their logits; with ``rng`` some words are left out."""
    words = Words(data, offsets, TABLE)
    vocabulary = Vocabulary(words, p["known"])
    start, size, begin = windows(words.first)
    x = vocabulary.inputs(p)
    if rng is not None:
        x = x * (rng.random((len(x), 1)) >= LEFT_OUT).astype(np.float32)
    gates = word_gates(p, x)
    logits = np.empty(len(start), np.float32)
    for a in range(0, len(start), TILE):
        part = slice(a, a + TILE)
        logits[part] = forward(p, gates, window_ids(vocabulary, start[part], size[part]), size[part])
    return vocabulary, x, gates, start, size, begin, logits


def train(texts: list[str], labels: np.ndarray, seed: int = 5) -> Params | None:
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    kept = np.zeros(len(y), bool)
    for c in (0, 1):
        mine = rng.permutation(np.flatnonzero(y == c))
        kept[mine[: len(mine) // CHECK_SHARE]] = True
    if min((y[kept] == c).sum() for c in (0, 1)) < CHECKED:
        kept[:] = False
    learn, held = np.flatnonzero(~kept), np.flatnonzero(kept)
    p = start_params(*known_words([texts[i] for i in learn], y[learn]))
    fitted = [k for k in p if k != "known"]
    first, second = ({k: np.zeros_like(p[k]) for k in fitted} for _ in range(2))
    share = [max(1.0, float((y[learn] == c).sum())) for c in (0, 1)]
    balance = np.where(y == 1, len(learn) / (2 * share[1]), len(learn) / (2 * share[0])).astype(np.float32)
    step, epochs = 0, max(EPOCHS, -(-STEPS // -(-len(learn) // BATCH)))
    check = pa.array([texts[i] for i in held], pa.large_string())
    best, least, mean, passed = None, np.inf, None, 0
    for epoch in range(epochs):
        order = rng.permutation(learn)
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            column = pa.array([texts[i] for i in rows], pa.large_string())
            for _, data, offsets in blocks(column, 1 << 40):
                vocabulary, x, gates, start, size, begin, logits = block_windows(p, data, offsets, rng)
                end = np.append(begin[1:], len(start))
                if not epoch:  # before the network can tell, the window with the word of highest ratio
                    first_parts = np.append(x[:, 0], -np.inf)
                    logits = np.concatenate([first_parts[window_ids(vocabulary, start[i : i + TILE], size[i : i + TILE])].max(1) for i in range(0, len(start), TILE)])
                pick = np.array([b + int(np.argmax(logits[b:e])) for b, e in zip(begin, end)])
                ids = window_ids(vocabulary, start[pick], size[pick])
                logit, trace = forward(p, gates, ids, size[pick], keep=True)
                slope = (sigmoid(logit) - y[rows]) * balance[rows] / len(rows)
                padded = np.concatenate((x, np.zeros((1, 2 * EMBED), np.float32)))
                gradient = backward(p, _with_blank(vocabulary), padded, ids, trace, slope.astype(np.float32))
                gradient["word"][0] = 0
                step += 1
                speed = RATE * (1 - 0.9 * epoch / epochs)
                rate = speed * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, v in gradient.items():
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.001 * (v * v - second[k])
                    p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-7)).astype(np.float32)
                for k in ("word", "gram"):
                    p[k] *= np.float32(1 - DECAY * speed)
                if 2 * epoch >= epochs and not len(held):  # the mean of the second half stays
                    passed += 1
                    mean = {k: p[k].copy() for k in fitted} if mean is None else {k: mean[k] + (p[k] - mean[k]) / np.float32(passed) for k in fitted}
        if len(held):
            score = np.clip(score_column(p, check), 1e-6, 1 - 1e-6)
            loss = -float((balance[held] * np.log(np.where(y[held] == 1, score, 1 - score))).mean())
            if loss <= least:
                best, least = {k: v.copy() for k, v in p.items()}, loss
    if mean is not None:
        best = {**p, **mean}
    return best or p


class _with_blank:
    """A vocabulary whose last input row, no word, takes no gradient into the embeddings."""

    def __init__(self, v: Vocabulary):
        self.word = np.append(v.word, 0)
        self.gram, self.owner = v.gram, v.owner
        self.count = np.append(v.count, np.float32(1))


def score_column(p: Params | None, column: pa.Array) -> np.ndarray:
    if p is None:
        return np.full(len(column), 0.5)
    out = [np.zeros(0)]
    for _, data, offsets in blocks(column):
        *_, begin, logits = block_windows(p, data, offsets)
        out.append(np.maximum.reduceat(logits, begin))
    return sigmoid(np.clip(np.concatenate(out).astype(np.float64), -30, 30))


def score(documents: DataFrame, params: Params | None, output: str = "score") -> DataFrame:
    """``documents`` with a double column ``output``, replacing one of that name."""
    shared = documents.sparkSession.sparkContext.broadcast(params)
    rest = small_batches(documents).drop(output)
    schema = T.StructType([*rest.schema.fields, T.StructField(output, T.DoubleType())])

    def run(batches):
        for batch in batches:
            scores = score_column(shared.value, batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, output])

    return rest.mapInArrow(returning(run), schema)


def classify(documents: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``documents`` with held_out, score and predicted."""
    params = train(*training_rows(documents, labels, label, SAMPLE_ROWS))
    return score(documents, params).withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
