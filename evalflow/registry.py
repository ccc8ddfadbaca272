"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the whole given tables; ``ORACLE`` holds the DuckDB SQL for the same result.

Floating columns are rounded to 6 decimals on both sides so that the
comparison does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalflow import oracle as O
from evalflow.functions.json import metadata_predicate
from evalflow.functions.text import build_prompt, decode_text, encode_text
from evalflow.operators import details, frames, ingest, options, retrieval, stats
from evalflow.operators import metrics as met
from evalflow.plans import pipeline as pipe
from evalflow.plans import planning
from evalflow.session import scratch_path
from evalflow.sources import documents as sources
from evalflow.sources import fixtures as fx
from evalflow.sources import questions as qs
from evalflow.sources.store import RunStore
from evalflow.streaming import evaluate as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

METRICS = list(fx.METRICS)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def finish(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), 6).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fx.records(spark, sf_dir), fx.feedbacks(spark, sf_dir)


def _chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec, fb = _store(spark, sf_dir)
    return frames.chart_data(rec, fb, metrics=METRICS)


M4 = "answer_correctness, answer_relevance, context_relevance, groundedness"
R4 = ", ".join(f"round({m}, 6) AS {m}" for m in M4.split(", "))


# ---------------------------------------------------------------- frames
@register(
    "run_frame",
    O.with_ctes(*O.FRAMES)
    + f"SELECT recipe, dataset, record_id, metadata, total_tokens, round(latency, 6) AS latency, {R4} FROM run_frame",
)
def q_run_frame(spark, sf_dir):
    rec, fb = _store(spark, sf_dir)
    return frames.run_frame(rec, fb, metrics=METRICS)


@register(
    "run_frame_dataset",
    O.with_ctes(*O.FRAMES)
    + f"SELECT recipe, dataset, record_id, metadata, total_tokens, round(latency, 6) AS latency, {R4}, input, output FROM run_frame WHERE recipe = 'click' AND dataset = 'ds1'",
)
def q_run_frame_dataset(spark, sf_dir):
    """One recipe on one dataset, with its questions and answers."""
    rec, fb = _store(spark, sf_dir)
    return frames.run_frame(rec, fb, ["click"], "ds1", include_io=True, metrics=METRICS)


@register(
    "chart_data",
    O.with_ctes(*O.CHARTS)
    + f"SELECT recipe, dataset, record_id, metadata, total_tokens, round(latency, 6) AS latency, {R4} FROM chart",
)
def q_chart_data(spark, sf_dir):
    return _chart(spark, sf_dir)


@register(
    "metrics_long",
    O.with_ctes(*O.CHARTS)
    + """SELECT record_id, recipe, dataset, metric, round(value, 6) AS value FROM (
         SELECT record_id, recipe, dataset, answer_correctness, answer_relevance,
                context_relevance, groundedness, latency FROM chart)
         UNPIVOT INCLUDE NULLS (value FOR metric IN (answer_correctness, answer_relevance,
                                context_relevance, groundedness, latency))""",
)
def q_metrics_long(spark, sf_dir):
    return frames.metrics_long(_chart(spark, sf_dir), METRICS)


# ---------------------------------------------------------------- stats
_LONG_NO_LAT = """
long AS (
  SELECT * FROM (SELECT record_id, recipe, dataset, answer_correctness, answer_relevance,
                        context_relevance, groundedness FROM chart)
  UNPIVOT INCLUDE NULLS (value FOR metric IN (answer_correctness, answer_relevance,
                                               context_relevance, groundedness))
),
facets AS (
  SELECT r.recipe, d.dataset, m.metric FROM (SELECT DISTINCT recipe FROM long) r
  CROSS JOIN (SELECT DISTINCT dataset FROM long) d CROSS JOIN (SELECT DISTINCT metric FROM long) m
),
box0 AS (
  SELECT recipe, dataset, metric, max(value) AS high, min(value) AS low,
    quantile_cont(value, 0.5) AS median, fsum(value) / count(value) AS mean,
    quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM long GROUP BY recipe, dataset, metric
),
box AS (SELECT * FROM facets LEFT JOIN box0 USING (recipe, dataset, metric))"""

_BOX_COLS = "round(high, 6) AS high, round(low, 6) AS low, round(median, 6) AS median, round(mean, 6) AS mean, round(q1, 6) AS q1, round(q3, 6) AS q3"


@register(
    "box_stats",
    O.with_ctes(*O.CHARTS, _LONG_NO_LAT) + f"SELECT recipe, dataset, metric, {_BOX_COLS} FROM box",
)
def q_box_stats(spark, sf_dir):
    return stats.box_stats(_chart(spark, sf_dir), METRICS)


@register(
    "box_plot_table",
    O.with_ctes(*O.CHARTS, _LONG_NO_LAT)
    + f"""SELECT dataset, recipe, metric,
        CAST(dense_rank() OVER (PARTITION BY dataset ORDER BY lower(recipe), recipe) AS BIGINT) AS recipe_pos,
        CAST(dense_rank() OVER (PARTITION BY dataset ORDER BY metric DESC) AS BIGINT) AS metric_pos,
        {_BOX_COLS} FROM box""",
)
def q_box_plot_table(spark, sf_dir):
    return stats.box_plot_table(stats.box_stats(_chart(spark, sf_dir), METRICS))


def _hist_sql(metric_filter: str, edges: str, nbins: int) -> str:
    return O.with_ctes(*O.CHARTS) + f"""
, long AS (
  SELECT * FROM (SELECT record_id, recipe, dataset, answer_correctness, answer_relevance,
                        context_relevance, groundedness, latency FROM chart)
  UNPIVOT INCLUDE NULLS (value FOR metric IN (answer_correctness, answer_relevance,
                                               context_relevance, groundedness, latency))
),
sel AS (SELECT * FROM long WHERE {metric_filter}),
e AS (SELECT {edges} AS edges),
binned AS (
  SELECT dataset, recipe, metric,
    least(len(list_filter(e.edges, lambda x: x <= value)) - 1, {nbins - 1}) AS bin
  FROM sel, e
  WHERE value IS NOT NULL AND NOT isnan(value) AND value < 'inf'::DOUBLE AND value >= 0
    AND value <= e.edges[{nbins + 1}]
),
counts AS (SELECT dataset, recipe, metric, bin, count(*) AS n FROM binned GROUP BY ALL),
facets AS (
  SELECT d.dataset, r.recipe, m.metric FROM (SELECT DISTINCT recipe FROM sel) r
  CROSS JOIN (SELECT DISTINCT dataset FROM sel) d CROSS JOIN (SELECT DISTINCT metric FROM sel) m
),
grid AS (SELECT f.*, b.bin FROM facets f CROSS JOIN (SELECT range AS bin FROM range({nbins})) b),
dense AS (
  SELECT g.dataset, g.recipe, g.metric, g.bin, coalesce(c.n, 0) AS n
  FROM grid g LEFT JOIN counts c USING (dataset, recipe, metric, bin)
)
SELECT d.dataset, d.recipe, d.metric, CAST(d.bin AS BIGINT) AS bin,
  round(e.edges[d.bin + 1], 6) AS lo, round(e.edges[d.bin + 2], 6) AS hi, CAST(d.n AS BIGINT) AS n,
  round(CASE WHEN sum(d.n) OVER w > 0 THEN d.n * 100.0 / sum(d.n) OVER w END, 6) AS percent
FROM dense d, e
WINDOW w AS (PARTITION BY d.dataset, d.recipe, d.metric)
"""


_SCORE_EDGES = "list_transform(range(10), lambda i: i * CAST(0.1 AS DOUBLE)) || [CAST(1.0 AS DOUBLE)]"
_LAT_EDGES = (
    "list_transform(range(49), lambda i: i * (CAST(15.0 AS DOUBLE) / 49)) || [CAST(15.0 AS DOUBLE), CAST('inf' AS DOUBLE)]"
)


@register("histogram_scores", _hist_sql("metric <> 'latency'", _SCORE_EDGES, 10))
def q_histogram_scores(spark, sf_dir):
    return stats.histogram(_chart(spark, sf_dir), METRICS, latency=False)


@register("histogram_latency", _hist_sql("metric = 'latency'", _LAT_EDGES, 50))
def q_histogram_latency(spark, sf_dir):
    return stats.histogram(_chart(spark, sf_dir), [], latency=True)


@register(
    "status_counts",
    O.with_ctes(*O.STORE) + "SELECT status, count(*) AS n FROM feedbacks GROUP BY status",
)
def q_status_counts(spark, sf_dir):
    return stats.status_counts(fx.feedbacks(spark, sf_dir))


@register(
    "metric_names",
    O.with_ctes(*O.STORE)
    + """SELECT name, 'union' AS how FROM (SELECT DISTINCT name FROM feedbacks)
         UNION ALL
         SELECT name, 'intersection' AS how FROM feedbacks GROUP BY name
         HAVING count(DISTINCT recipe) = (SELECT count(DISTINCT recipe) FROM feedbacks)""",
)
def q_metric_names(spark, sf_dir):
    fb = fx.feedbacks(spark, sf_dir)
    u = frames.metric_names(fb).withColumn("how", F.lit("union"))
    i = frames.metric_names(fb, how="intersection").withColumn("how", F.lit("intersection"))
    return u.unionByName(i)


# ---------------------------------------------------------------- compare

PAIR = ["click", "view"]


def _recipes(spark, sf_dir) -> list[str]:
    """Every recipe of the store (its output columns), in name order."""
    types = fx.read_table(spark, sf_dir, "events").select("event_type").distinct().collect()
    return sorted(r[0] for r in types)



def _compare_sql(recipes: list[str], tail: str = "") -> str:
    per = []
    for r in recipes:
        for c in ["record_id", "total_tokens", "latency", "output", *METRICS]:
            per.append(f"max({c}) FILTER (WHERE recipe = '{r}') AS {c}_{r}")
    diffs = []
    if len(recipes) == 2:
        a, b = recipes
        diffs = [f"{m}_{a} - {m}_{b} AS {m}__diff" for m in [*METRICS, "total_tokens", "latency"]]
    outs = [f"w.output_{r}" for r in recipes]
    rest = ["metadata"] + [f"{c}_{r}" for r in recipes for c in ["record_id", "total_tokens", "latency", *METRICS]]
    rest += [f"{m}__diff" for m in ([*METRICS, "total_tokens", "latency"] if len(recipes) == 2 else [])]

    def shown(c: str) -> str:
        numeric = not (c == "metadata" or c.startswith("record_id_") or c.startswith("total_tokens"))
        return f"round(w.{c}, 6) AS {c}" if numeric else f"w.{c}"

    return (
        O.with_ctes(*O.FRAMES, O.GOLDEN)
        + f""", occ AS (
  SELECT *, row_number() OVER (PARTITION BY recipe, dataset, input ORDER BY start_time NULLS FIRST, record_id) AS _occ
  FROM run_frame WHERE recipe IN ({", ".join(f"'{r}'" for r in recipes)})
),
cwide0 AS (
  SELECT dataset, input, _occ, max(metadata) FILTER (WHERE recipe = '{recipes[0]}') AS metadata,
    {", ".join(per)}
  FROM occ GROUP BY dataset, input, _occ
),
cwide AS (SELECT *{", " + ", ".join(diffs) if diffs else ""} FROM cwide0),
gt AS (SELECT dataset, query, arg_max(ground_truth, pos) AS ground_truth FROM golden GROUP BY dataset, query),
cmp AS (
  SELECT w.dataset, w.input, gt.ground_truth, {", ".join(outs)}, {", ".join(shown(c) for c in sorted(rest))}
  FROM cwide w LEFT JOIN gt ON gt.dataset = w.dataset AND gt.query = w.input
)
"""
        + (tail or "SELECT * FROM cmp")
    )


def _compare(spark, sf_dir, recipes):
    rec, fb = _store(spark, sf_dir)
    return frames.compare_runs(rec, fb, recipes, None, golden=fx.golden_items(spark, sf_dir))


# the SQL text needs the column names written out; the query reads them from the table
@register("compare_runs", _compare_sql(["click", "error", "purchase", "signup", "view"]))
def q_compare_runs(spark, sf_dir):
    return _compare(spark, sf_dir, _recipes(spark, sf_dir))


@register("compare_diff", _compare_sql(PAIR))
def q_compare_diff(spark, sf_dir):
    return _compare(spark, sf_dir, PAIR)


_PAGE_ORDER = "latency__diff DESC NULLS LAST, dataset NULLS FIRST, input NULLS FIRST, record_id_click NULLS FIRST, record_id_view NULLS FIRST"


@register(
    "compare_page",
    _compare_sql(
        PAIR,
        f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY {_PAGE_ORDER}) AS BIGINT) AS row_pos
        FROM cmp WHERE answer_relevance__diff > 0) WHERE row_pos BETWEEN 11 AND 20""",
    ),
)
def q_compare_page(spark, sf_dir):
    cmp = _compare(spark, sf_dir, PAIR)
    return frames.compare_page(
        cmp,
        where=F.col("answer_relevance__diff") > 0,
        order_by=[F.col("latency__diff").desc_nulls_last()],
        page=1,
        size=10,
        tie_break=["dataset", "input", "record_id_click", "record_id_view"],
    )


@register(
    "compare_page_far",
    _compare_sql(
        PAIR,
        f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY {_PAGE_ORDER}) AS BIGINT) AS row_pos
        FROM cmp) WHERE row_pos BETWEEN 31 AND 35""",
    ),
)
def q_compare_page_far(spark, sf_dir):
    """A page read from the ranges that hold it."""
    return frames.compare_page(
        _compare(spark, sf_dir, PAIR),
        order_by=[F.col("latency__diff").desc_nulls_last()],
        page=6,
        size=5,
        tie_break=["dataset", "input", "record_id_click", "record_id_view"],
        top_rows=0,
    )


# ---------------------------------------------------------------- filters / options
_FILTERS = {
    "seg_hot": {"seg": "s3", "hot": True},
    "k_number": {"k": 69},
    "k_as_text": {"k": "69"},
}
_FILTER_SQL = {
    "seg_hot": "json_type(metadata, '$.seg') = 'VARCHAR' AND json_extract_string(metadata, '$.seg') = 's3' "
    "AND json_type(metadata, '$.hot') = 'BOOLEAN' AND json_extract_string(metadata, '$.hot') = 'true'",
    "k_number": "json_type(metadata, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') "
    "AND CAST(json_extract_string(metadata, '$.k') AS DOUBLE) = 69",
    "k_as_text": "json_type(metadata, '$.k') = 'VARCHAR' AND json_extract_string(metadata, '$.k') = '69'",
}


@register(
    "metadata_filter",
    O.with_ctes(*O.FRAMES)
    + " UNION ALL ".join(
        f"SELECT '{name}' AS filter, recipe, dataset, record_id, round(latency, 6) AS latency, "
        f"round(answer_relevance, 6) AS answer_relevance FROM run_frame WHERE {cond}"
        for name, cond in _FILTER_SQL.items()
    ),
)
def q_metadata_filter(spark, sf_dir):
    rec, fb = _store(spark, sf_dir)
    # one frame for every filter: each record is tagged with the names of the
    # filters it passes, so records and scores are read and joined once
    passed = F.array(*[F.when(metadata_predicate("metadata", filt), F.lit(name)) for name, filt in _FILTERS.items()])
    tagged = rec.select("*", F.explode(F.filter(passed, lambda n: n.isNotNull())).alias("filter"))
    rf = frames.run_frame(tagged, fb, metrics=METRICS, keep=["filter"])
    return rf.select("filter", "recipe", "dataset", "record_id", "latency", "answer_relevance")


@register(
    "metadata_options",
    O.with_ctes(*O.STORE)
    + """, vals AS (
  SELECT DISTINCT r.dataset, j.key,
    CASE WHEN j.type = 'VARCHAR' THEN j.value ->> '$'
         WHEN j.type = 'BOOLEAN' THEN CAST(j.value AS VARCHAR)
         ELSE CAST(CAST(j.value AS DOUBLE) AS VARCHAR) END AS value,
    CASE WHEN j.type = 'VARCHAR' THEN 's' WHEN j.type = 'BOOLEAN' THEN 'b' ELSE 'n' END AS kind
  FROM records r, json_each(r.metadata) j
  WHERE j.type IN ('VARCHAR', 'BOOLEAN', 'BIGINT', 'UBIGINT', 'DOUBLE')
)
SELECT dataset, key, CASE kind WHEN 's' THEN 'string' WHEN 'b' THEN 'boolean' ELSE 'number' END AS value_type,
  CAST(count(*) AS BIGINT) AS n_values, '<all>|' || array_to_string(list_sort(list(value)), '|') AS "values"
FROM vals WHERE (dataset, key) IN (SELECT (dataset, key) FROM vals GROUP BY dataset, key HAVING count(*) <= 50)
GROUP BY dataset, key, kind""",
)
def q_metadata_options(spark, sf_dir):
    opts = options.metadata_options(fx.records(spark, sf_dir))
    return opts.select("dataset", "key", "value_type", "n_values", F.array_join("values", "|").alias("values"))


@register(
    "recipe_catalog",
    O.with_ctes(*O.STORE)
    + """, runs AS (SELECT DISTINCT recipe, dataset FROM records),
cat AS (SELECT dataset, list_sort(list(recipe)) AS recipes FROM runs GROUP BY dataset)
SELECT r.dataset, r.recipe,
  'ingredients,llm_provider,method_name,model_name,script_path' AS visible_keys,
  CAST(length(r.recipe) * 50 AS BIGINT) AS chunk_size,
  array_to_string(c.recipes, ',') AS recipes
FROM runs r JOIN cat c USING (dataset)""",
)
def q_recipe_catalog(spark, sf_dir):
    cat = options.recipe_catalog(fx.runs(spark, sf_dir))
    return cat.select(
        "dataset", "recipe",
        F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("visible_keys"),
        F.try_variant_get(F.col("metadata")["ingredients"], "$.chunk_size", "long").alias("chunk_size"),
        F.array_join("recipes", ",").alias("recipes"),
    )


# ---------------------------------------------------------------- drill-down

_CALLS_SQL = """
, calls0 AS (
  SELECT recipe, dataset, record_id, name, last_ts,
    generate_subscripts(calls, 1) - 1 AS pos, unnest(calls) AS call
  FROM feedbacks
),
calls AS (
  SELECT recipe, dataset, record_id, name, last_ts, pos,
    call.reason AS reason, call.reasons AS reasons, call.context AS context, call.score AS score
  FROM calls0
)
"""


def _split_sql(r: str) -> tuple[str, str]:
    """Criteria / Supporting Evidence split of a reason, in DuckDB SQL."""
    ws = r"'^\s+|\s+$', '', 'g'"
    p1 = f"strpos({r}, 'Criteria:')"
    n1 = f"strpos({r}, 'Supporting Evidence:')"
    end1 = f"(CASE WHEN {n1} > 0 THEN {n1} - 1 ELSE length({r}) END)"
    s1 = f"({p1} - 1 + 9)"
    crit = f"CASE WHEN {p1} > 0 THEN regexp_replace(substr({r}, {s1} + 1, greatest({end1} - {s1}, 0)), {ws}) END"
    rest = f"(CASE WHEN {p1} > 0 THEN substr({r}, {end1} + 1) ELSE {r} END)"
    p2 = f"strpos({rest}, 'Supporting Evidence:')"
    s2 = f"({p2} - 1 + 20)"
    evid = (
        f"CASE WHEN {p2} > 0 THEN regexp_replace(substr({rest}, {s2} + 1, "
        f"greatest(length({rest}) - {s2}, 0)), {ws}) END"
    )
    return crit, evid


_CRIT, _EVID = _split_sql("reason")


@register(
    "record_details",
    O.with_ctes(*O.STORE)
    + _CALLS_SQL
    + """SELECT recipe, dataset, record_id, name,
  CAST(row_number() OVER (PARTITION BY recipe, dataset, record_id, name ORDER BY last_ts, pos) AS BIGINT) AS call_idx,
  reason, reasons, context, round(score, 6) AS score
FROM calls""",
)
def q_record_details(spark, sf_dir):
    d = details.record_details(fx.feedbacks(spark, sf_dir))
    ex = d.select(*details.REC_KEYS, "name", F.posexplode("calls").alias("i", "c"))
    return ex.select(
        *details.REC_KEYS, "name", (F.col("i") + 1).cast("long").alias("call_idx"),
        "c.reason", "c.reasons", "c.context", "c.score",
    )


@register(
    "record_selection",
    O.with_ctes(*O.STORE)
    + _CALLS_SQL
    + """SELECT recipe, dataset, record_id, name,
  CAST(row_number() OVER (PARTITION BY recipe, dataset, record_id, name ORDER BY last_ts, pos) AS BIGINT) AS call_idx,
  reason, reasons, context, round(score, 6) AS score
FROM calls WHERE (recipe, record_id) IN (SELECT (recipe, record_id) FROM records WHERE n_tokens > 800)""",
)
def q_record_selection(spark, sf_dir):
    """The calls of the selected records: those with the longest answers."""
    rec, fb = _store(spark, sf_dir)
    d = details.record_details(fb, rec.where(F.col("n_tokens") > 800).select("recipe", "record_id"))
    ex = d.select(*details.REC_KEYS, "name", F.posexplode("calls").alias("i", "c"))
    return ex.select(
        *details.REC_KEYS, "name", (F.col("i") + 1).cast("long").alias("call_idx"),
        "c.reason", "c.reasons", "c.context", "c.score",
    )


@register(
    "record_contexts",
    O.with_ctes(*O.STORE)
    + """SELECT recipe, dataset, record_id, CAST(chunk AS BIGINT) AS chunk, substr(c.page_content, 1, 200) AS preview,
  c.page_content AS page_content, c.metadata AS metadata
FROM (SELECT recipe, dataset, record_id, generate_subscripts(contexts, 1) AS chunk, unnest(contexts) AS c FROM records)""",
)
def q_record_contexts(spark, sf_dir):
    return details.record_contexts(fx.records(spark, sf_dir))


@register(
    "reason_split",
    O.with_ctes(*O.STORE)
    + _CALLS_SQL
    + f"""SELECT recipe, dataset, record_id, name, CAST(pos AS BIGINT) AS pos,
  {_CRIT} AS criteria, {_EVID} AS supporting_evidence
FROM calls WHERE reason IS NOT NULL""",
)
def q_reason_split(spark, sf_dir):
    calls = details.record_calls(fx.feedbacks(spark, sf_dir)).where(F.col("reason").isNotNull())
    out = details.reason_fields(calls)
    return out.select(*details.REC_KEYS, "name", F.col("pos").cast("long").alias("pos"), "criteria", "supporting_evidence")


@register(
    "context_reasons",
    O.with_ctes(*O.STORE)
    + _CALLS_SQL
    + f""", ctx AS (
  SELECT recipe, dataset, record_id, generate_subscripts(contexts, 1) - 1 AS pos, unnest(contexts).page_content AS context
  FROM records
),
idx AS (SELECT recipe, dataset, record_id, context, max(pos) AS context_index FROM ctx GROUP BY ALL)
SELECT c.recipe, c.dataset, c.record_id, CAST(c.pos AS BIGINT) AS pos, CAST(i.context_index AS BIGINT) AS context_index,
  {_CRIT.replace("reason", "c.reason")} AS criteria, {_EVID.replace("reason", "c.reason")} AS supporting_evidence,
  round(c.score, 6) AS score
FROM calls c LEFT JOIN idx i ON i.recipe = c.recipe AND i.dataset = c.dataset AND i.record_id = c.record_id
  AND i.context = c.context
WHERE c.name = 'context_relevance'""",
)
def q_context_reasons(spark, sf_dir):
    out = details.context_reasons(fx.records(spark, sf_dir), fx.feedbacks(spark, sf_dir))
    return out.drop("last_ts").withColumn("pos", F.col("pos").cast("long"))


_MEASURES = [*METRICS, "total_tokens", "latency"]
_REPORT_KEYS = ["dataset", "input", "record_id_click", "record_id_view"]


def _report_sql() -> str:
    esc = r"""replace(regexp_replace(coalesce(output_{r}, ''), '([\\`*_{{}}\[\]()#+,\-.!|])', '\\\1', 'g'), chr(10), ' ')"""
    keys = ", ".join(_REPORT_KEYS)
    parts = [f"SELECT {keys}, 'Answer' AS legend, " + ", ".join(f"{esc.format(r=r)} AS {r}" for r in PAIR) + " FROM cmp"]
    for m in _MEASURES:
        if m == "total_tokens":
            cells = ", ".join(f"coalesce(CAST({m}_{r} AS VARCHAR), '') AS {r}" for r in PAIR)
        else:
            cells = ", ".join(f"coalesce(printf('%.2f', {m}_{r}), '') AS {r}" for r in PAIR)
        parts.append(f"SELECT {keys}, '{m}' AS legend, {cells} FROM cmp")
    return " UNION ALL ".join(parts)


def _compare_raw_sql(recipes: list[str], tail: str) -> str:
    """Comparison without output rounding (report cells format raw values)."""
    sql = _compare_sql(recipes, tail)
    for c in ["latency", *METRICS]:
        for r in recipes:
            sql = sql.replace(f"round(w.{c}_{r}, 6) AS {c}_{r}", f"w.{c}_{r}")
    return sql


@register("report_cells", _compare_raw_sql(PAIR, _report_sql()))
def q_report_cells(spark, sf_dir):
    rec, fb = _store(spark, sf_dir)
    cmp = frames.compare_runs(rec, fb, PAIR, None, golden=fx.golden_items(spark, sf_dir))
    return details.report_cells(cmp, PAIR, _MEASURES, keys=_REPORT_KEYS)


@register("decode_text", "SELECT conv_id, turn, role, text FROM conversations")
def q_decode_text(spark, sf_dir):
    conv = fx.read_table(spark, sf_dir, "conversations")
    stored = conv.select("conv_id", "turn", "role", encode_text("text").alias("stored"))
    return stored.select("conv_id", "turn", "role", decode_text("stored").alias("text"))


# ---------------------------------------------------------------- planning

_SUBSETS = ["simple", "comparison", "multi-hop"]
_KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in qs.QUESTION_KINDS) + "]"


@register(
    "questions_load",
    f"""SELECT concat('conv', u.conv_id % 2) AS dataset, u.conv_id * 100 + u.turn AS pos, u.text AS query,
  a.text AS ground_truth,
  to_json({{'conv_id': u.conv_id, 'question_type': {_KINDS_SQL}[((u.conv_id + u.turn) % 8) + 1], 'turn': u.turn}}) AS metadata
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user' AND a.text IS NOT NULL AND u.text IS NOT NULL
  AND {_KINDS_SQL}[((u.conv_id + u.turn) % 8) + 1] IN ({", ".join(f"'{s}'" for s in _SUBSETS)})""",
)
def q_questions_load(spark, sf_dir):
    raw = fx.conversation_questions(spark, sf_dir)
    ds = F.concat(F.lit("conv"), (F.col("conv_id") % 2).cast("string"))
    pos = F.col("conv_id") * 100 + F.col("turn")
    return qs.questions_from_frame(raw, ds, pos, _SUBSETS)


_QI = O.with_ctes(O.QUERY_ITEMS)


@register(
    "sample_exact",
    _QI
    + """SELECT dataset, pos, query FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset
      ORDER BY CAST('0x' || substr(md5(concat('42:', pos)), 1, 15) AS BIGINT), pos) AS rn,
    count(*) OVER (PARTITION BY dataset) AS n
  FROM query_items) WHERE rn <= floor(CAST(0.5 AS DOUBLE) * n)""",
)
def q_sample_exact(spark, sf_dir):
    qi = fx.query_items(spark, sf_dir)
    return planning.sample_exact(qi, 0.5, seed=42).select("dataset", "pos", "query")


def _plans(spark, sf_dir):
    rec = fx.recipes(spark, sf_dir)
    ingest = planning.pipeline_keys(rec, ["chunk_size"], "ingest", "pipelines/ingest.py", "ingest_documents")
    query = planning.pipeline_keys(rec, ["chunk_size", "k"], "query", "pipelines/query.py", "query_pipeline")
    return ingest, query


@register(
    "recipe_plan",
    O.with_ctes(O.RECIPES)
    + """SELECT step, pipeline_key, count(*) AS n_recipes, string_agg(recipe, ',' ORDER BY recipe) AS recipes
FROM plan GROUP BY step, pipeline_key""",
)
def q_recipe_plan(spark, sf_dir):
    ingest, query = _plans(spark, sf_dir)
    both = ingest.unionByName(query)
    return both.select(
        "step", "pipeline_key", F.size("recipes").cast("long").alias("n_recipes"),
        F.array_join("recipes", ",").alias("recipes"),
    )


_WORK_SQL = O.with_ctes(O.QUERY_ITEMS, O.RECIPES) + """,
work AS (
  SELECT k.pipeline_key AS recipe, q.dataset, q.pos, q.query, q.conv_id, q.turn
  FROM query_items q CROSS JOIN (SELECT DISTINCT pipeline_key FROM plan WHERE step = 'query') k
),
recorded AS (
  SELECT w.recipe, w.dataset, w.query FROM work w
  WHERE w.recipe LIKE '%chunk_size_100%'
    AND w.pos // 100 IN (SELECT conv_id FROM conversations WHERE role = 'system')
),
remaining AS (
  SELECT * FROM work w WHERE NOT EXISTS (
    SELECT 1 FROM recorded r WHERE r.recipe = w.recipe AND r.dataset = w.dataset AND r.query IS NOT DISTINCT FROM w.query)
)
"""


def _work(spark, sf_dir):
    _, query = _plans(spark, sf_dir)
    meta = F.to_json(F.struct("conv_id", "turn")).alias("metadata")
    qi = fx.query_items(spark, sf_dir).select("dataset", "pos", "query", "conv_id", meta)
    work = planning.work_plan(qi, query)
    conv = fx.read_table(spark, sf_dir, "conversations")
    system = conv.where(F.col("role") == "system").select("conv_id").distinct()
    recorded = (
        work.where(F.col("recipe").contains("chunk_size_100"))
        .join(system, "conv_id", "left_semi")
        .select("recipe", "dataset", encode_text("query").alias("input"), "pos")
    )
    return work.drop("conv_id"), recorded


@register("work_plan", _WORK_SQL + "SELECT recipe, dataset, pos, query FROM work")
def q_work_plan(spark, sf_dir):
    work, _ = _work(spark, sf_dir)
    return work.select("recipe", "dataset", "pos", "query")


@register("resume_pending", _WORK_SQL + "SELECT recipe, dataset, pos, query FROM remaining")
def q_resume_pending(spark, sf_dir):
    work, recorded = _work(spark, sf_dir)
    return planning.pending(work, recorded).select("recipe", "dataset", "pos", "query")


@register(
    "run_progress",
    _WORK_SQL
    + """, scored AS (
  SELECT recipe, dataset, sum(CASE WHEN pos % 3 = 0 THEN 3 ELSE 4 END)::BIGINT AS n FROM work
  WHERE recipe LIKE '%chunk_size_100%' AND pos // 100 IN (SELECT conv_id FROM conversations WHERE role = 'system')
  GROUP BY recipe, dataset
), t AS (
  SELECT w.recipe, w.dataset, count(*) AS questions,
    count(*) - (SELECT count(*) FROM remaining r WHERE r.recipe = w.recipe AND r.dataset = w.dataset) AS finished,
    count(*) * 4 AS feedbacks
  FROM work w GROUP BY w.recipe, w.dataset
)
SELECT t.*, coalesce(n, 0) AS feedbacks_done, questions = finished AND coalesce(n, 0) >= feedbacks AS complete
FROM t LEFT JOIN scored USING (recipe, dataset)""",
)
def q_run_progress(spark, sf_dir):
    """Feedback of one metric failed for every third question; every row is there twice."""
    work, recorded = _work(spark, sf_dir)
    name = F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("name")
    fb = recorded.select("recipe", "dataset", F.col("pos").cast("string").alias("record_id"), "pos", name)
    failed = (F.col("name") == "groundedness") & (F.col("pos") % 3 == 0)
    fb = fb.withColumn("status", F.when(failed, F.lit("failed")).otherwise(F.lit("done")))
    return planning.progress(work, recorded, fb.unionByName(fb))


# ---------------------------------------------------------------- metrics


def _t(x: str) -> str:
    return rf"coalesce(list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')), [])"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len({a}) END"


_MET_SQL = {
    "answer_correctness": (
        f"CASE WHEN e.ground_truth IS NOT NULL AND len({_t('e.output')}) > 0 AND len({_t('e.ground_truth')}) > 0 "
        f"THEN CAST(2 AS DOUBLE) * len(list_intersect({_t('e.output')}, {_t('e.ground_truth')})) "
        f"/ (len({_t('e.output')}) + len({_t('e.ground_truth')})) END",
        "1",
    ),
    "answer_relevance": (_share(_t("e.input"), _t("e.output")), "1"),
    "context_relevance": (
        f"CASE WHEN len(e.contexts) > 0 THEN list_reduce(list_transform(e.contexts, lambda c: "
        f"{_share(_t('e.input'), _t('c.page_content'))}), lambda a, b: a + b) / len(e.contexts) END",
        "len(e.contexts)",
    ),
    "groundedness": (
        _share(_t("e.output"), f"list_distinct(flatten(list_transform(e.contexts, lambda c: {_t('c.page_content')})))"),
        "1",
    ),
}

_EVAL_BASE = O.with_ctes(O.QUERY_ITEMS, O.EVAL_RECORDS) + """,
gt AS (SELECT dataset, query, arg_max(ground_truth, pos) AS gt FROM query_items GROUP BY dataset, query),
e AS (
  SELECT r.recipe, r.dataset, r.record_id, r.input, r.output, r.contexts, gt.gt AS ground_truth
  FROM eval_records r LEFT JOIN gt ON gt.dataset = r.dataset AND gt.query = r.input
)
"""


def _eval_records(spark, sf_dir):
    return fx.eval_records(spark, sf_dir).drop("ground_truth", "pos")


def _metric_query(name: str):
    expr, ncalls = _MET_SQL[name]
    sql = _EVAL_BASE + (
        f"SELECT e.recipe, e.dataset, e.record_id, round({expr}, 6) AS result, CAST({ncalls} AS BIGINT) AS n_calls FROM e"
    )

    def q(spark, sf_dir):
        fb = met.evaluate(_eval_records(spark, sf_dir), fx.query_items(spark, sf_dir), metrics=[name])
        return fb.select(*met.REC_KEYS, "result", F.size("calls").cast("long").alias("n_calls"))

    register(f"metric_{name}", sql)(q)


for _m in met.METRIC_NAMES:
    _metric_query(_m)

_EVAL_ALL_SQL = _EVAL_BASE + " UNION ALL ".join(
    f"SELECT e.recipe, e.dataset, e.record_id, '{m}' AS name, 'done' AS status, round({expr}, 6) AS result, "
    f"CAST({ncalls} AS BIGINT) AS n_calls FROM e"
    for m, (expr, ncalls) in _MET_SQL.items()
)


@register("evaluate", _EVAL_ALL_SQL)
def q_evaluate(spark, sf_dir):
    fb = met.evaluate(_eval_records(spark, sf_dir), fx.query_items(spark, sf_dir))
    return fb.select(*met.REC_KEYS, "name", "status", "result", F.size("calls").cast("long").alias("n_calls"))


@register("evaluate_udf", _EVAL_ALL_SQL)
def q_evaluate_udf(spark, sf_dir):
    fb = met.evaluate_with_judge(_eval_records(spark, sf_dir), met.LexicalJudge(), fx.query_items(spark, sf_dir))
    return fb.select(*met.REC_KEYS, "name", "status", "result", F.size("calls").cast("long").alias("n_calls"))


def _words_sql(hit: str, total: str, what: str) -> str:
    return f"'Criteria: word overlap of the {what}' || chr(10) || 'Supporting Evidence: ' || {hit} || ' of ' || {total} || ' words match'"


def _both(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


_I, _O, _G = _t("e.input"), _t("e.output"), _t("e.ground_truth")
_ALL_CTX = f"list_distinct(flatten(list_transform(e.contexts, lambda c: {_t('c.page_content')})))"


@register(
    "evaluate_calls",
    _EVAL_BASE
    + f"""SELECT recipe, dataset, record_id, 'answer_correctness' AS name, 0::BIGINT AS pos,
  {_words_sql(_both(_O, _G), f"len({_G})", "answer with the ground truth")} AS reason, NULL AS reasons, NULL AS context, round({_MET_SQL["answer_correctness"][0]}, 6) AS score FROM e
UNION ALL SELECT recipe, dataset, record_id, 'answer_relevance', 0, {_words_sql(_both(_I, _O), f"len({_I})", "question with the answer")}, NULL, NULL,
  round({_MET_SQL["answer_relevance"][0]}, 6) FROM e
UNION ALL SELECT recipe, dataset, record_id, 'groundedness', 0, NULL, {_words_sql(_both(_O, _ALL_CTX), f"len({_O})", "answer with the contexts")}, NULL,
  round({_MET_SQL["groundedness"][0]}, 6) FROM e
UNION ALL SELECT recipe, dataset, record_id, 'context_relevance', pos, {_words_sql(_both(_I, _t("context")), f"len({_I})", "question with the context")}, NULL, context,
  round({_share(_I, _t("context"))}, 6) FROM (SELECT *, generate_subscripts(contexts, 1) - 1 AS pos, unnest(contexts).page_content AS context FROM e) e""",
)
def q_evaluate_calls(spark, sf_dir):
    """What every metric's calls say."""
    fb = met.evaluate(_eval_records(spark, sf_dir), fx.query_items(spark, sf_dir))
    ex = fb.select(*met.REC_KEYS, "name", F.posexplode("calls").alias("pos", "c"))
    return ex.select(*met.REC_KEYS, "name", F.col("pos").cast("long").alias("pos"), "c.reason", "c.reasons", "c.context", "c.score")


class HalfJudge(met.LexicalJudge):
    """Half the lexical score."""

    def score_batch(self, batch):
        out = super().score_batch(batch)
        out["score"] = pd.Series([None if x is None else x / 2 for x in out["score"]], dtype=object)
        return out


_ROUTED = {"groundedness": {"judge": "half"}, "context_relevance": {"judge": "half"}, "answer_relevance": {"enabled": True}}


@register(
    "evaluate_routed",
    _EVAL_BASE
    + " UNION ALL ".join(
        f"SELECT e.recipe, e.dataset, e.record_id, '{m}' AS name, 'done' AS status, round(({expr}) / {2 if 'judge' in _ROUTED[m] else 1}, 6) AS result, "
        f"CAST({ncalls} AS BIGINT) AS n_calls FROM e"
        for m, (expr, ncalls) in _MET_SQL.items()
        if m in _ROUTED
    ),
)
def q_evaluate_routed(spark, sf_dir):
    """Two metrics go to a judge of their own."""
    judges = {"default": met.LexicalJudge(), "half": HalfJudge()}
    fb = met.evaluate_with_judge(_eval_records(spark, sf_dir), judges, fx.query_items(spark, sf_dir), metrics=_ROUTED)
    return fb.select(*met.REC_KEYS, "name", "status", "result", F.size("calls").cast("long").alias("n_calls"))


_CONTENT = {
    "groundedness": "e.input, e.output, coalesce(array_to_string(list_transform(e.contexts, lambda c: c.page_content), chr(10)), '') AS context, e.ground_truth",
    "answer_relevance": "e.input, e.output, NULL AS context, e.ground_truth",
}


@register(
    "judge_calls",
    _EVAL_BASE
    + """, twice AS (SELECT * FROM e UNION ALL SELECT 'again', * EXCLUDE (recipe) FROM e),
req AS ("""
    + " UNION ALL ".join(f"SELECT '{m}' AS name, {c} FROM twice e" for m, c in _CONTENT.items())
    + """ UNION ALL SELECT 'context_relevance', e.input, e.output, unnest(e.contexts).page_content, e.ground_truth FROM twice e)
SELECT CASE name WHEN 'answer_relevance' THEN 'default' ELSE 'half' END AS judge, CAST(sum(n) AS BIGINT) AS requests, count(*) AS calls
FROM (SELECT name, count(*) AS n FROM req GROUP BY name, input, output, context, ground_truth) GROUP BY 1""",
)
def q_judge_calls(spark, sf_dir):
    """Requests of two recipes with the same answers, and the calls that they cost, by judge."""
    rec = _eval_records(spark, sf_dir)
    rec = rec.unionByName(rec.withColumn("recipe", F.lit("again")))
    routes, judges = met.judge_of_metrics({"default": met.LexicalJudge(), "half": HalfJudge()}, _ROUTED)
    req = met.routed_requests(rec, routes, fx.query_items(spark, sf_dir)).where(F.col("key").isNotNull())
    calls = met.judge_verdicts(req, judges).groupBy("judge").agg(F.count(F.lit(1)).alias("calls"))
    return req.groupBy("judge").agg(F.count(F.lit(1)).alias("requests")).join(calls, "judge")


# ---------------------------------------------------------------- ingest / retrieval


@register(
    "pages_text",
    r"""SELECT page_id, url, regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'),
      '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'),
      '(?s)<!--.*?-->', ' ', 'g'),
      '<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
  '[ ' || chr(9) || chr(10) || chr(13) || chr(12) || ']+', ' ', 'g'), '^ | $', '', 'g') AS text
FROM pages""",
)
def q_pages_text(spark, sf_dir):
    pages = fx.read_table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", ingest.html_to_text("html").alias("text"))


_WORDS_SQL = "list_filter(regexp_split_to_array(text, '[ ' || chr(9) || chr(10) || chr(13) || chr(12) || ']+'), lambda w: w <> '')"


def _chunks_sql(size: int, where: str = "TRUE") -> str:
    step = size - ingest.default_overlap(size)
    return f"""(
  SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, CAST(len(w[i * {step} + 1 : i * {step} + {size}]) AS INTEGER) AS n_words,
    array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS text
  FROM (
    SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= {size} THEN 1
                                    ELSE CAST(ceil((len(w) - {size}) / {step}) AS BIGINT) + 1 END)) AS i
    FROM (SELECT doc_id, {_WORDS_SQL} AS w FROM documents WHERE {where})
  )
)"""


@register("chunk_window", f"SELECT * FROM {_chunks_sql(100)}")
def q_chunk_window(spark, sf_dir):
    return ingest.chunk_window(fx.read_table(spark, sf_dir, "documents"), 100)


_BLANK_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _count_sql(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{_BLANK_SQL}'), lambda w: w <> ''))"


def _pieces_sql(size: int) -> str:
    levels, previous = [], "p0"
    for i, pattern in enumerate((r"(?s).*?\n\n|.+", r"(?s).*?\n|.+", "(?s).*? |.+", "(?s)."), 1):
        cut = f"CASE WHEN {_count_sql('p')} <= {size} THEN [p] ELSE regexp_extract_all(p, '{pattern}') END"
        levels.append(f"p{i} AS (SELECT doc_id, flatten(list_transform(ps, lambda p: {cut})) AS ps FROM {previous})")
        previous = f"p{i}"
    return ",\n".join(levels)


@register(
    "chunk_recursive",
    f"""WITH RECURSIVE p0 AS (SELECT doc_id, [text] AS ps FROM documents WHERE text <> ''),
{_pieces_sql(100)},
each AS (SELECT doc_id, i, {_count_sql('p')} AS n FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM p4)),
sums AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM each),
b AS (SELECT doc_id, list_prepend(0, list(s ORDER BY i)) AS b FROM sums GROUP BY doc_id),
c AS (
  SELECT doc_id, 0::BIGINT AS first, len(list_filter(b, lambda x: x <= 100)) - 1 AS fits FROM b
  UNION ALL
  SELECT doc_id, nxt, len(list_filter(b, lambda x: x <= b[nxt + 1] + 100)) - 1
  FROM (
    SELECT doc_id, b, least(stop, greatest(first + 1, len(list_filter(b, lambda x: x < greatest(b[stop + 1] - {ingest.default_overlap(100)}, b[stop + 2] - 100))))) AS nxt
    FROM (SELECT c.doc_id, b.b, c.first, greatest(c.first + 1, c.fits) AS stop FROM c JOIN b USING (doc_id))
    WHERE stop < len(b) - 1
  )
),
t AS (
  SELECT c.doc_id, c.first, regexp_replace(regexp_replace(array_to_string(ps[c.first + 1:greatest(c.first + 1, c.fits)], ''), '^{_BLANK_SQL}', ''), '{_BLANK_SQL}$', '') AS text
  FROM c JOIN p4 USING (doc_id)
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS chunk_id, CAST({_count_sql('text')} AS INTEGER) AS n_tokens, text
FROM t WHERE text <> ''""",
)
def q_chunk_recursive(spark, sf_dir):
    return ingest.chunk_recursive(fx.read_table(spark, sf_dir, "documents"), 100)


@register(
    "chunk_embed",
    f"""WITH h AS (
  SELECT doc_id, chunk_id, list_transform({_t('text')}, lambda w: CAST('0x' || substr(md5(w), 1, 15) AS BIGINT)) AS hs FROM {_chunks_sql(100)}
)
SELECT doc_id, chunk_id, array_to_string(list_transform(range(64), lambda b: CAST(coalesce(list_sum(list_transform(
  list_filter(hs, lambda h: h % 64 = b), lambda h: 1 - 2 * ((h >> 32) & 1))), 0) AS BIGINT)), ',') AS embedding
FROM h""",
)
def q_chunk_embed(spark, sf_dir):
    chunks = ingest.chunk_window(fx.read_table(spark, sf_dir, "documents"), 100)
    emb = ingest.embed(chunks)
    return emb.select("doc_id", "chunk_id", F.array_join(F.transform("embedding", lambda x: x.cast("long")), ",").alias("embedding"))


@register(
    "chunk_upsert",
    f"""SELECT doc_id, chunk_id, 100 AS size, n_words FROM {_chunks_sql(100)} o
WHERE o.doc_id NOT IN (SELECT DISTINCT doc_id FROM {_chunks_sql(200, "lang = 'de'")})
UNION ALL
SELECT doc_id, chunk_id, 200 AS size, n_words FROM {_chunks_sql(200, "lang = 'de'")}""",
)
def q_chunk_upsert(spark, sf_dir):
    docs = fx.read_table(spark, sf_dir, "documents")
    old = ingest.chunk_window(docs, 100).withColumn("size", F.lit(100))
    new = ingest.chunk_window(docs.where(F.col("lang") == "de"), 200).withColumn("size", F.lit(200))
    store = RunStore(spark, scratch_path(spark, "chunk-store"))
    store.upsert_chunks(old)
    store.upsert_chunks(new)
    return store.chunks().select("doc_id", "chunk_id", "size", "n_words")


_KNN_SQL = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS sim
  FROM embeddings q, embeddings c WHERE q.vec_id <> c.vec_id
),
ranked AS (
  SELECT query_id, vec_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank
  FROM pairs
)
"""


def _knn(spark, sf_dir):
    emb = fx.read_table(spark, sf_dir, "embeddings")
    return retrieval.retrieve_topk(emb.withColumnRenamed("vec_id", "query_id"), emb, k=5, exclude_self=True)


@register(
    "retrieve_topk",
    _KNN_SQL + "SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, round(sim, 6) AS similarity FROM ranked WHERE rank <= 5",
)
def q_retrieve_topk(spark, sf_dir):
    return _knn(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))


@register(
    "retrieve_contexts",
    _KNN_SQL + "SELECT query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS context_ids FROM ranked WHERE rank <= 5 GROUP BY query_id",
)
def q_retrieve_contexts(spark, sf_dir):
    ctx = retrieval.contexts_for(_knn(spark, sf_dir))
    return ctx.select("query_id", F.array_join(F.transform("context_ids", lambda x: x.cast("string")), ",").alias("context_ids"))


@register(
    "retrieve_context_texts",
    _KNN_SQL
    + """SELECT query_id, CAST(rank AS BIGINT) AS rank, concat('passage ', r.vec_id) AS page_content, concat('{"label":', label, '}') AS metadata
FROM ranked r JOIN embeddings USING (vec_id) WHERE rank <= 5""",
)
def q_retrieve_context_texts(spark, sf_dir):
    emb = fx.read_table(spark, sf_dir, "embeddings")
    chunks = emb.select("vec_id", F.concat(F.lit("passage "), "vec_id").alias("text"), F.to_json(F.struct("label")).alias("metadata"))
    lists = retrieval.contexts_for(_knn(spark, sf_dir), chunks)
    ex = lists.select("query_id", F.posexplode("contexts").alias("i", "c"))
    return ex.select("query_id", (F.col("i") + 1).cast("long").alias("rank"), "c.page_content", "c.metadata")


# --- fixed values that must equal the reference's output -----------------
# Prompt template of the example query pipeline.
PROMPT_TEMPLATE = """
    Answer the question based only on the supplied context. If you don't know the answer, say: "I don't know".
    Context: {context}
    Question: {question}
    Your answer:
    """
# --------------------------------------------------------------------------


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@register(
    "prompt_build",
    O.with_ctes(O.QUERY_ITEMS, O.EVAL_RECORDS)
    + f"""SELECT record_id, replace(replace({_sql_str(PROMPT_TEMPLATE)}, '{{context}}',
    coalesce(array_to_string(list_transform(contexts, lambda c: c.page_content), chr(10) || chr(10)), '')),
  '{{question}}', coalesce(input, '')) AS prompt
FROM eval_records""",
)
def q_prompt_build(spark, sf_dir):
    rec = fx.eval_records(spark, sf_dir)
    return rec.select("record_id", build_prompt("contexts", "input", PROMPT_TEMPLATE).alias("prompt"))


def _source_folder(spark, sf_dir) -> str:
    """A folder of source files: every benchmark text in a file of its own, in a folder named by its item."""
    root = scratch_path(spark, "sources")
    texts = fx.read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value"))
    texts.repartition("item_id").write.partitionBy("item_id").text(root)
    return root


def _item(path: str):
    return F.regexp_extract(path, r"/item_id=(\d+)/", 1).cast("long").alias("item_id")


@register("source_documents", "SELECT item_id, text || chr(10) AS text FROM benchmark")
def q_source_documents(spark, sf_dir):
    """Whole source files; the folder is named twice, each file is one document."""
    root = _source_folder(spark, sf_dir)
    docs = sources.load_documents(spark, [f"{root}/*", f"{root}/item_id=*"])
    return ingest.document_text(docs).select(_item("path"), "text")


def _ingest_one(file_path: str, every: int) -> None:
    item = int(file_path.split("/item_id=")[1].split("/")[0])
    if item % every == 0:
        raise ValueError(f"no text in {item}")


@register(
    "source_ingest",
    "SELECT item_id, CASE WHEN item_id % 7 = 0 THEN concat('ValueError: no text in ', item_id) END AS error FROM benchmark",
)
def q_source_ingest(spark, sf_dir):
    """A user's ingest function called for every source file, errors kept by file."""
    root = _source_folder(spark, sf_dir)
    done = pipe.ingest_sources(sources.list_sources(spark, [f"{root}/*", f"{root}/item_id=*"]), _ingest_one, {"every": 7, "unused": 1})
    return done.select(_item("path"), "error")


@register(
    "store_export",
    O.with_ctes(*O.FRAMES)
    + "SELECT dataset, recipe, record_id, input, output, round(answer_relevance, 6) AS answer_relevance FROM run_frame WHERE recipe <> 'click'",
)
def q_store_export(spark, sf_dir):
    """A store with one recipe reset, its records and scores written as JSON and read back."""
    rec, fb = _store(spark, sf_dir)
    root = scratch_path(spark, "export")
    store = RunStore(spark, f"{root}/store")
    with store.commit() as commit:
        commit.write_records(rec.withColumn("error", F.lit(None).cast("string")))
        commit.write_feedbacks(fb)
    store.reset("click")
    out = frames.run_frame(store.records(), store.feedbacks(), include_io=True, metrics=["answer_relevance"])
    store.export_results(out.select("dataset", "recipe", "record_id", "input", "output", "answer_relevance"), f"{root}/json")
    schema = "recipe string, record_id string, input string, output string, answer_relevance double, dataset string"
    return spark.read.schema(schema).json(f"{root}/json")


@register(
    "store_compare",
    f"SELECT * FROM ({_hist_sql("metric <> 'latency'", _SCORE_EDGES, 10)}) UNION ALL SELECT * FROM ({_hist_sql("metric = 'latency'", _LAT_EDGES, 50)})",
)
def q_store_compare(spark, sf_dir):
    """The histogram report over what a store holds."""
    rec, fb = _store(spark, sf_dir)
    store = RunStore(spark, scratch_path(spark, "compare-store"))
    with store.commit() as commit:
        commit.write_records(rec.withColumn("error", F.lit(None).cast("string")))
        commit.write_feedbacks(fb)
    return stats.compare(store, None, "histogram-grid")


# ---------------------------------------------------------------- streaming


@register(
    "retry_pending",
    O.with_ctes(*O.STORE)
    + """, n AS (SELECT max(last_ts) AS now FROM feedbacks)
SELECT recipe, dataset, record_id, name, status FROM feedbacks, n
WHERE (status = 'failed' AND date_diff('microsecond', last_ts, n.now) / 1e6 > 60)
   OR (status = 'running' AND date_diff('microsecond', last_ts, n.now) / 1e6 > 30)""",
)
def q_retry_pending(spark, sf_dir):
    fb = fx.feedbacks(spark, sf_dir)
    now = fb.select(F.max("last_ts")).scalar()
    return streaming.retry_pending(fb, now)


_RETRY_SQL = O.with_ctes(*O.STORE) + """, n AS (SELECT max(last_ts) AS now FROM feedbacks),
marked AS (
  SELECT f.*, (status = 'failed' AND date_diff('microsecond', last_ts, n.now) / 1e6 > 60)
    OR (status = 'running' AND date_diff('microsecond', last_ts, n.now) / 1e6 > 30) AS due
  FROM feedbacks f, n
),
e AS (SELECT recipe, dataset, record_id, input, output, contexts, NULL::VARCHAR AS ground_truth FROM records),
fresh AS (
""" + " UNION ALL ".join(
    f"SELECT e.recipe, e.dataset, e.record_id, '{m}' AS name, 'done' AS status, {expr} AS result FROM e" for m, (expr, _) in _MET_SQL.items()
) + """
)
SELECT recipe, dataset, record_id, name, status, round(result, 6) AS result FROM marked WHERE NOT due
UNION ALL
SELECT f.recipe, f.dataset, f.record_id, f.name, f.status, round(f.result, 6) FROM fresh f
  JOIN (SELECT DISTINCT recipe, dataset, record_id, name FROM marked WHERE due) d USING (recipe, dataset, record_id, name)"""


@register("retry_scored", _RETRY_SQL)
def q_retry_scored(spark, sf_dir):
    rec, fb = _store(spark, sf_dir)
    now = fb.select(F.max("last_ts")).scalar()
    out = streaming.retry_scored(rec, fb, now)
    return out.select(*met.REC_KEYS, "name", "status", "result")


@register("stream_evaluate", _EVAL_ALL_SQL)
def q_stream_evaluate(spark, sf_dir):
    root = scratch_path(spark, "stream-evaluate")
    src = RunStore(spark, f"{root}/source")
    rec = _eval_records(spark, sf_dir)
    src.write_records(rec.select("*", *[F.lit(None).alias(c) for c in ("metadata", "n_tokens", "start_time", "end_time", "error")]))
    store = RunStore(spark, f"{root}/store")
    q = streaming.evaluate_stream(
        spark, src, store, f"{root}/checkpoint", questions=fx.query_items(spark, sf_dir)
    )
    q.awaitTermination()
    fb = store.feedbacks()
    return fb.select(*met.REC_KEYS, "name", "status", "result", F.size("calls").cast("long").alias("n_calls"))


@register(
    "stream_status",
    O.with_ctes(*O.STORE)
    + """SELECT status, count(*) AS n FROM (
  SELECT arg_max(status, last_ts) AS status FROM feedbacks GROUP BY recipe, dataset, record_id, name
) GROUP BY status""",
)
def q_stream_status(spark, sf_dir):
    """The stream first sees all groundedness feedback running, then every feedback as it ends."""
    root = scratch_path(spark, "stream-status")
    store = RunStore(spark, f"{root}/store")
    fb = fx.feedbacks(spark, sf_dir)
    fb = fb.withColumn("calls", F.lit(None).cast(fb.schema["calls"].dataType))
    early = fb.where(F.col("name") == "groundedness").withColumns(
        {"status": F.lit("running"), "result": F.lit(None), "last_ts": F.col("last_ts") - F.expr("interval 1 hour")}
    )
    for feed in (early, fb):
        store.write_feedbacks(feed)
        streaming.status_stream(spark, store.path("feedbacks"), f"{root}/counts", f"{root}/checkpoint").awaitTermination()
    return streaming.live_status(spark, f"{root}/counts")


@register("retry_stored", _RETRY_SQL)
def q_retry_stored(spark, sf_dir):
    rec, fb = _store(spark, sf_dir)
    store = RunStore(spark, scratch_path(spark, "retry-store"))
    with store.commit() as commit:
        commit.write_records(rec.withColumn("error", F.lit(None).cast("string")))
        commit.write_feedbacks(fb)
    now = store.feedbacks().select(F.max("last_ts")).first()[0]
    streaming.retry_stored(store, F.lit(now).cast("timestamp_ntz"))
    return store.feedbacks().select(*met.REC_KEYS, "name", "status", "result")


# ---------------------------------------------------------------- pipelines


def extractive_pipeline(k: str, chunk_size: str, **_):
    """Demo query pipeline (deterministic, no external service): repeats the
    question with its ``k`` and cuts it into contexts of ``chunk_size``
    characters."""
    size = int(chunk_size)

    class _P:
        def invoke(self, question):
            if question is None:
                raise ValueError("no question")
            return {"answer": f"k={k}: {question}", "contexts": [question[i : i + size] for i in range(0, len(question), size)]}

    return _P()


_RUN_SQL = _WORK_SQL + """,
results AS (
  SELECT recipe AS pipeline_key, dataset, concat(recipe, ':', dataset, ':', pos) AS record_id, query AS input,
    CASE WHEN query IS NOT NULL THEN concat('k=', regexp_extract(recipe, '_k_([0-9]+)$', 1), ': ', query) END AS output,
    concat('{"conv_id":', conv_id, ',"turn":', turn, '}') AS metadata,
    CAST(ceil(length(query) / CAST(regexp_extract(recipe, 'chunk_size_([0-9]+)', 1) AS DOUBLE)) AS BIGINT) AS n_contexts,
    CASE WHEN query IS NULL THEN 'ValueError: no question' END AS error
  FROM remaining
)
"""


def _run(spark, sf_dir):
    work, recorded = _work(spark, sf_dir)
    return pipe.run_pipeline(planning.pending(work, recorded), extractive_pipeline, {"model": "none"})


def _run_columns(rec: DataFrame) -> DataFrame:
    n = F.size("contexts").cast("long").alias("n_contexts")
    return rec.select("recipe", "dataset", "record_id", "input", "output", "metadata", n, "error")


@register("run_pipeline", _RUN_SQL + "SELECT pipeline_key AS recipe, * EXCLUDE (pipeline_key) FROM results")
def q_run_pipeline(spark, sf_dir):
    return _run_columns(_run(spark, sf_dir))


@register(
    "run_store",
    _RUN_SQL
    + """SELECT p.recipe, r.* EXCLUDE (pipeline_key) FROM results r
JOIN plan p ON p.step = 'query' AND p.pipeline_key = r.pipeline_key""",
)
def q_run_store(spark, sf_dir):
    _, query = _plans(spark, sf_dir)
    store = RunStore(spark, scratch_path(spark, "run-store"))
    named = planning.fan_out(_run(spark, sf_dir), query)
    with store.commit() as commit:
        commit.write_records(named)
        commit.write_runs(named.select("recipe", "dataset", F.lit("{}").alias("metadata")).distinct())
    mine = store.records().join(store.runs().select("recipe", "dataset"), ["recipe", "dataset"], "left_semi")
    return _run_columns(mine)


_RESUME_RECIPES = {"first": 1, "second": 2}


class _Stopped(RunStore):
    """A store whose writer is stopped when it would enter its n-th commit."""

    def __init__(self, spark, root, n):
        super().__init__(spark, root)
        self.left = n

    def _enter(self, commit):
        self.left -= 1
        if self.left == 0:
            raise InterruptedError("stopped")
        return super()._enter(commit)


@register(
    "run_resume",
    O.with_ctes(O.QUERY_ITEMS)
    + """, gt AS (SELECT dataset, query, arg_max(ground_truth, pos) AS gt FROM query_items GROUP BY dataset, query),
e AS (
  SELECT v.recipe, q.dataset, concat(v.recipe, ':', q.dataset, ':', q.pos) AS record_id, q.query AS input,
    CASE WHEN q.query IS NOT NULL THEN concat('k=', v.k, ': ', q.query) END AS output,
    coalesce(list_transform(range(0, length(q.query), 50), lambda i: {'page_content': substr(q.query, i + 1, 50)}), []) AS contexts,
    gt.gt AS ground_truth
  FROM query_items q CROSS JOIN (VALUES ('first', 1), ('second', 2)) v(recipe, k)
  LEFT JOIN gt ON gt.dataset = q.dataset AND gt.query = q.query
)
"""
    + " UNION ALL ".join(
        f"SELECT e.recipe, e.dataset, e.record_id, '{m}' AS name, 'done' AS status, round({expr}, 6) AS result, 1::BIGINT AS n_rows, 1::BIGINT AS n_runs FROM e"
        for m, (expr, _) in _MET_SQL.items()
    ),
)
def q_run_resume(spark, sf_dir):
    """An experiment over half the questions, stopped before its answers and then before its scores show; a run over all finishes both."""
    questions = fx.query_items(spark, sf_dir)
    recipes = [{"recipe": r, "k": k, "chunk_size": 50} for r, k in _RESUME_RECIPES.items()]
    root = scratch_path(spark, "resume-store")
    for stop in (1, 2):
        try:
            pipe.run_experiment(questions.where(F.col("pos") % 2 == 0), None, recipes, _Stopped(spark, root, stop), query_fn=extractive_pipeline)
        except InterruptedError:
            pass
    store = RunStore(spark, root)
    pipe.run_experiment(questions, None, recipes, store, query_fn=extractive_pipeline)
    keys = [*met.REC_KEYS, "name", "status", F.round("result", 6).alias("result")]
    rows = store.feedbacks().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    runs = store.runs().groupBy("recipe", "dataset").agg(F.count(F.lit(1)).alias("n_runs"))
    return rows.join(runs, ["recipe", "dataset"], "left")


@register("run_experiment")
def q_run_experiment(spark, sf_dir):
    docs = fx.read_table(spark, sf_dir, "documents")
    recipes = [
        {"recipe": "size_100_k_2", "chunk_size": 100, "k": 2},
        {"recipe": "size_100_k_5", "chunk_size": 100, "k": 5},
        {"recipe": "size_200_k_2", "chunk_size": 200, "k": 2},
        {"recipe": "size_200_k_5", "chunk_size": 200, "k": 5},
    ]
    return pipe.run_experiment(fx.query_items(spark, sf_dir), docs, recipes)


@register(
    "answer_reasons",
    O.with_ctes(*O.STORE)
    + _CALLS_SQL
    + f""", firsts AS (
  SELECT *, row_number() OVER (PARTITION BY recipe, dataset, record_id ORDER BY last_ts, pos) AS rn
  FROM calls WHERE name = 'answer_relevance'
)
SELECT recipe, dataset, record_id, {_CRIT} AS criteria, {_EVID} AS supporting_evidence, round(score, 6) AS score
FROM firsts WHERE rn = 1""",
)
def q_answer_reasons(spark, sf_dir):
    return details.answer_reasons(fx.feedbacks(spark, sf_dir))


@register(
    "groundedness_reasons",
    O.with_ctes(*O.STORE)
    + _CALLS_SQL
    + "SELECT recipe, dataset, record_id, CAST(pos AS BIGINT) AS pos, reasons, round(score, 6) AS score "
    "FROM calls WHERE name = 'groundedness'",
)
def q_groundedness_reasons(spark, sf_dir):
    g = details.groundedness_reasons(fx.feedbacks(spark, sf_dir))
    return g.select(*details.REC_KEYS, F.col("pos").cast("long").alias("pos"), "reasons", "score")
