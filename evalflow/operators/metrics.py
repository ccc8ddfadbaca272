"""The four RAG metrics, the feedback rows they produce, and judge plumbing.

Default judge: lexical word overlap, written as native array expressions so
it runs inside whole-stage code generation, needs no network and is
deterministic. With ``T(x)`` = distinct lower-case word tokens:

* groundedness       share of T(output) found in the union of T(context)
* answer_relevance   share of T(input) found in T(output)
* context_relevance  mean over contexts of the share of T(input) in T(context)
* answer_correctness token F1 of T(output) against T(ground_truth)

An empty token set gives a null score. These scores are ours; an LLM judge
plugs in through ``Judge`` / ``evaluate_with_judge``.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalflow.functions.text import tokens
from evalflow.sources.questions import golden_lookup

METRIC_NAMES = ("answer_correctness", "answer_relevance", "context_relevance", "groundedness")
REC_KEYS = ("recipe", "dataset", "record_id")

CALL = T.StructType(
    [
        T.StructField("reason", T.StringType()),
        T.StructField("reasons", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def _call(reason: Column, score: Column, context: Column | None = None, reasons: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        reason.alias("reason"),
        (reasons if reasons is not None else null).alias("reasons"),
        (context if context is not None else null).alias("context"),
        score.cast("double").alias("score"),
    )


def _overlap_reason(hit: Column, total: Column, what: str) -> Column:
    return F.concat(
        F.lit("Criteria: word overlap of the " + what + "\nSupporting Evidence: "),
        hit.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" words match"),
    )


#: Working columns of ``scored``: every text is cut into tokens once, and
#: every overlap counted once; scores and reasons read these.
_IN, _OUT, _GT, _CTX, _ALL = "__input_t", "__output_t", "__truth_t", "__context_t", "__contexts_t"


def _overlap(a: str, b: str) -> Column:
    return F.size(F.array_intersect(F.col(a), F.col(b)))


def _ratio(hits: Column, of: str) -> Column:
    return F.when(F.size(of) > 0, hits.cast("double") / F.size(of))


def _groundedness(hits: Column) -> tuple[Column, Column]:
    score = _ratio(hits, _OUT)
    reasons = _overlap_reason(hits, F.size(_OUT), "answer with the contexts")
    return score, F.array(_call(F.lit(None).cast("string"), score, reasons=reasons))


def _answer_relevance(hits: Column) -> tuple[Column, Column]:
    score = _ratio(hits, _IN)
    return score, F.array(_call(_overlap_reason(hits, F.size(_IN), "question with the answer"), score))


def _context_relevance(hits: Column) -> tuple[Column, Column]:
    """``hits`` holds one count per context."""
    total = F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + _ratio(h, _IN))
    score = F.when(F.size(hits) > 0, total / F.size(hits))
    calls = F.zip_with(
        "contexts",
        hits,
        lambda c, h: _call(
            _overlap_reason(h, F.size(_IN), "question with the context"), _ratio(h, _IN), context=c["page_content"]
        ),
    )
    return score, calls


def _answer_correctness(hits: Column) -> tuple[Column, Column]:
    some = F.col("ground_truth").isNotNull() & (F.size(_OUT) > 0) & (F.size(_GT) > 0)
    score = F.when(some, (2.0 * hits) / (F.size(_OUT) + F.size(_GT)))
    return score, F.array(_call(_overlap_reason(hits, F.size(_GT), "answer with the ground truth"), score))


def select_metrics(metrics: Sequence[str] | Mapping[str, Any] | None) -> list[str]:
    """Metric selection: a list of names, or ``{name: {"enabled": bool, "judge": ...}}``."""
    if metrics is None:
        return list(METRIC_NAMES)
    if isinstance(metrics, Mapping):
        chosen = [m for m, cfg in metrics.items() if not isinstance(cfg, Mapping) or cfg.get("enabled", True)]
    else:
        chosen = list(metrics)
    unknown = [m for m in chosen if m not in METRIC_NAMES]
    if unknown:
        raise ValueError(f"unknown metric(s) {unknown}; choices are {list(METRIC_NAMES)}")
    return [m for m in METRIC_NAMES if m in chosen]


def with_ground_truth(records: DataFrame, questions: DataFrame | None) -> DataFrame:
    if "ground_truth" in records.columns or questions is None:
        return records if "ground_truth" in records.columns else records.withColumn("ground_truth", F.lit(None).cast("string"))
    gt = golden_lookup(questions).withColumnRenamed("query", "input")
    return records.join(gt, ["dataset", "input"], "left")


def scored(records: DataFrame, questions: DataFrame | None = None, metrics=None) -> tuple[DataFrame, list[str]]:
    """Records plus one ``(result, calls)`` struct column per selected
    metric, and the names of those. Null contexts count as none."""
    chosen = select_metrics(metrics)
    df = _no_null_contexts(with_ground_truth(records, questions))
    df = df.withColumns(
        {
            _IN: tokens("input"),
            _OUT: tokens("output"),
            _GT: tokens("ground_truth"),
            _CTX: F.transform("contexts", lambda c: tokens(c["page_content"])),
        }
    )
    df = df.withColumn(_ALL, F.array_distinct(F.flatten(_CTX)))
    hits = {
        "answer_correctness": _overlap(_OUT, _GT),
        "answer_relevance": _overlap(_IN, _OUT),
        "context_relevance": F.transform(_CTX, lambda t: F.size(F.array_intersect(F.col(_IN), t))),
        "groundedness": _overlap(_OUT, _ALL),
    }
    fns = {
        "answer_correctness": _answer_correctness,
        "answer_relevance": _answer_relevance,
        "context_relevance": _context_relevance,
        "groundedness": _groundedness,
    }
    df = df.withColumns({f"__hits_{m}": hits[m] for m in chosen})
    cols = {}
    for m in chosen:
        score, calls = fns[m](F.col(f"__hits_{m}"))
        cols[m] = F.struct(score.alias("result"), calls.alias("calls"))
    work = [_IN, _OUT, _GT, _CTX, _ALL, *[f"__hits_{m}" for m in chosen]]
    return df.withColumns(cols).drop(*work), chosen


def _no_null_contexts(records: DataFrame) -> DataFrame:
    none = F.array().cast(records.schema["contexts"].dataType)
    return records.withColumn("contexts", F.coalesce("contexts", none))


def evaluate(
    records: DataFrame,
    questions: DataFrame | None = None,
    metrics=None,
    last_ts: Column | None = None,
) -> DataFrame:
    """Feedback rows (recipe, dataset, record_id, name, status, result,
    calls, last_ts) for every record and selected metric, with the lexical
    judge: an optional join for the ground truth (the records are shuffled by
    question only if the golden set is too large to broadcast), then per-row
    array expressions and an ``explode``."""
    df, chosen = scored(records, questions, metrics)
    entries = F.array(*[F.struct(F.lit(m).alias("name"), F.col(m)["result"].alias("result"), F.col(m)["calls"].alias("calls")) for m in chosen])
    ts = last_ts if last_ts is not None else F.current_timestamp()
    ex = df.select(*REC_KEYS, F.explode(entries).alias("f"))
    return ex.select(
        *REC_KEYS,
        F.col("f.name").alias("name"),
        F.lit("done").alias("status"),
        F.col("f.result").alias("result"),
        F.col("f.calls").alias("calls"),
        ts.alias("last_ts"),
    )


# ---------------------------------------------------------------- judges


class Judge:
    """Batch judge: ``score_batch`` receives a pandas frame with columns
    name, input, output, context, ground_truth and returns one with score
    and reason (str), same length and order. In ``score`` (object type) NaN
    fails the row and None means "no score". When it raises, the rows of the
    batch are scored one at a time and only those that raise again fail."""

    def score_batch(self, batch: pd.DataFrame) -> pd.DataFrame:  # pragma: no cover - interface
        raise NotImplementedError


class LexicalJudge(Judge):
    """The lexical judge as a Python ``Judge`` (same scores as the native
    expressions); useful to test the external-judge path."""

    def __init__(self) -> None:
        import regex

        self._split = regex.compile(r"[^\p{L}\p{N}]+")

    def _t(self, text):
        if text is None or (isinstance(text, float) and pd.isna(text)):
            return set()
        return {t for t in self._split.split(text.lower()) if t}

    def score_batch(self, batch: pd.DataFrame) -> pd.DataFrame:
        scores, reasons = [], []
        for name, inp, out, ctx, gt in zip(batch["name"], batch["input"], batch["output"], batch["context"], batch["ground_truth"]):
            s = None
            if name == "answer_relevance":
                a, b = self._t(inp), self._t(out)
                s = len(a & b) / len(a) if a else None
            elif name == "context_relevance":
                a, b = self._t(inp), self._t(ctx)
                s = len(a & b) / len(a) if a else None
            elif name == "groundedness":
                a, b = self._t(out), self._t(ctx)
                s = len(a & b) / len(a) if a else None
            elif name == "answer_correctness":
                a, b = self._t(out), self._t(gt)
                s = 2.0 * len(a & b) / (len(a) + len(b)) if gt is not None and a and b else None
            scores.append(s)
            reasons.append("lexical overlap")
        return pd.DataFrame({"score": pd.Series(scores, dtype=object), "reason": reasons})


_VERDICT_SCHEMA = "judge string, key string, score double, reason string, error string, seconds double"


def judge_requests(records: DataFrame, questions: DataFrame | None = None, metrics=None) -> DataFrame:
    """One row per judge call: a record's answer/question pair, or one row
    per context for context relevance; groundedness sees all contexts
    joined. A record without contexts has one context-relevance row with a
    null ``call_pos``: nothing to ask, but the metric is accounted for."""
    df = _no_null_contexts(with_ground_truth(records, questions))
    chosen = select_metrics(metrics)
    all_ctx = F.array_join(F.transform("contexts", lambda c: c["page_content"]), "\n")
    null = F.lit(None).cast("string")
    reqs = []
    for m in chosen:
        if m == "context_relevance":
            ctx = F.transform("contexts", lambda c, i: F.struct(i.alias("pos"), c["page_content"].alias("text")))
        elif m == "groundedness":
            ctx = F.array(F.struct(F.lit(0).alias("pos"), all_ctx.alias("text")))
        else:
            ctx = F.array(F.struct(F.lit(0).alias("pos"), null.alias("text")))
        reqs.append(F.struct(F.lit(m).alias("name"), ctx.alias("ctx")))
    ex = df.select(*REC_KEYS, "input", "output", "ground_truth", F.explode(F.array(*reqs)).alias("r"))
    ex = ex.select(*REC_KEYS, "input", "output", "ground_truth", F.col("r.name").alias("name"), F.explode_outer("r.ctx").alias("c"))
    return ex.select(
        *REC_KEYS, "name", F.col("c.pos").cast("int").alias("call_pos"),
        "input", "output", F.col("c.text").alias("context"), "ground_truth",
    )


_JUDGED = ["name", "input", "output", "context", "ground_truth"]


def _verdicts(judge: Judge, rows: pd.DataFrame) -> list[tuple[float | None, str | None, str | None]]:
    """(score, reason, error) per row; after an exception row by row."""
    rows = rows.reset_index(drop=True)
    try:
        res = judge.score_batch(rows)
        out = []
        for score, reason in zip(res["score"].astype(object), res["reason"], strict=True):
            if score is None:
                out.append((None, reason, None))
            elif pd.isna(score):
                out.append((None, reason, "the judge gave no number"))
            else:
                out.append((float(score), reason, None))
        if len(out) != len(rows):
            raise ValueError(f"{len(out)} scores for {len(rows)} rows")
        return out
    except Exception as exc:  # noqa: BLE001 - a failing row becomes failed feedback
        if len(rows) == 1:
            return [(None, None, f"{type(exc).__name__}: {exc}")]
    return [v for i in range(len(rows)) for v in _verdicts(judge, rows.iloc[i : i + 1])]


def judge_of_metrics(judge: Judge | Mapping[str, Judge], metrics=None) -> tuple[dict[str, str], dict[str, Judge]]:
    """The name of each metric's judge, and the judges by name.

    ``judge`` is one judge for all metrics, or judges by name. A metric's
    settings may name its own, ``{metric: {"judge": name}}``, or hold it;
    the others go to the one called ``default``, or to the first.
    """
    named = dict(judge) if isinstance(judge, Mapping) else {"default": judge}
    if not named:
        raise ValueError("no judge")
    default = "default" if "default" in named else next(iter(named))
    routes = {}
    for m in select_metrics(metrics):
        own = metrics[m].get("judge") if isinstance(metrics, Mapping) and isinstance(metrics[m], Mapping) else None
        if isinstance(own, Judge):
            named[f"{m}'s own"], own = own, f"{m}'s own"
        if own is not None and own not in named:
            raise ValueError(f"metric {m} names a judge {own!r}; there are {sorted(named)}")
        routes[m] = own or default
    return routes, named


def routed_requests(records: DataFrame, routes: Mapping[str, str], questions: DataFrame | None = None) -> DataFrame:
    """``judge_requests`` with the name of the judge to ask and the key of what
    it is asked: equal requests to one judge have one key; rows with nothing to ask have none."""
    req = judge_requests(records, questions, list(routes))
    names = F.create_map(*[x for m, j in routes.items() for x in (F.lit(m), F.lit(j))])
    req = req.withColumn("judge", names[F.col("name")])
    key = F.sha2(F.to_json(F.struct("judge", *_JUDGED)), 256)
    return req.withColumn("key", F.when(F.col("call_pos").isNotNull(), key))


def judge_verdicts(requests: DataFrame, judges: Mapping[str, Judge], parallelism: int | None = None) -> DataFrame:
    """(judge, key, score, reason, error, seconds): one row for each key, asked
    once. Requests are brought together before they are sent, so equal ones
    cost one call however many records share them."""
    asked = requests.where(F.col("key").isNotNull()).groupBy("key").agg(*[F.first(c).alias(c) for c in ("judge", *_JUDGED)])
    if parallelism:
        asked = asked.repartition(parallelism)
    judges = dict(judges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rows in batch.groupby("judge", sort=False):
                t0 = time.perf_counter()
                given = _verdicts(judges[name], rows[_JUDGED])
                out = pd.DataFrame({"judge": name, "key": rows["key"].to_numpy()})
                for n, col in enumerate(("score", "reason", "error")):
                    out[col] = pd.Series([v[n] for v in given], dtype="float64" if col == "score" else object)
                out["seconds"] = (time.perf_counter() - t0) / len(rows)
                yield out

    return asked.mapInPandas(run, _VERDICT_SCHEMA)


def evaluate_with_judge(
    records: DataFrame,
    judge: Judge | Mapping[str, Judge],
    questions: DataFrame | None = None,
    metrics=None,
    parallelism: int | None = None,
    materialize: bool = True,
) -> DataFrame:
    """Feedback rows scored by external judges (``mapInPandas``).

    Each metric goes to its judge (``judge_of_metrics``); equal requests are
    asked once and the verdict is given to all of them. Judge calls cost
    money and are not deterministic, so their output is written once under
    the checkpoint folder (``materialize``) before anything downstream can
    recompute it. A failed call makes its feedback ``failed`` with a null
    result. Context relevance is the mean over its per-context calls;
    without contexts it is ``done`` with a null result and no calls.
    """
    routes, judges = judge_of_metrics(judge, metrics)
    req = routed_requests(records, routes, questions)
    verdicts = judge_verdicts(req, judges, parallelism)
    if materialize:
        from evalflow.session import materialize as write_once

        verdicts = write_once(verdicts, "judge-calls")
    res = req.select(*REC_KEYS, "name", "call_pos", "context", "key").join(verdicts.drop("judge"), "key", "left")
    grouped = res.groupBy(*REC_KEYS, "name").agg(
        F.avg(F.when(~F.isnan("score"), F.col("score"))).alias("result"),
        F.max(F.col("error").isNotNull().cast("int")).alias("_failed"),
        F.array_sort(
            F.collect_list(
                F.when(F.col("call_pos").isNotNull(), F.struct(F.col("call_pos").alias("pos"), "reason", "context", "score"))
            )
        ).alias("_calls"),
    )
    failed = F.col("_failed") == 1
    return grouped.select(
        *REC_KEYS, "name",
        F.when(failed, F.lit("failed")).otherwise(F.lit("done")).alias("status"),
        F.when(failed, F.lit(None).cast("double")).otherwise(F.col("result")).alias("result"),
        F.transform("_calls", lambda c: _call(c["reason"], c["score"], context=c["context"])).alias("calls"),
        F.current_timestamp().alias("last_ts"),
    )
