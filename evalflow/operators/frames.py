"""Record/feedback frames: run frame, chart data, long form, comparison.

All operators take and return DataFrames and are lazy. The one place a
driver-side list is needed is the set of metric names, because it decides
output columns; it comes from a distinct over one column (partial aggregate
per task). Each name becomes a column, so all of them are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalflow.functions.json import latency_seconds, metadata_predicate
from evalflow.functions.ordinal import group_ordinal, time_bucket
from evalflow.session import materialize

KEYS = ("recipe", "dataset", "record_id")
MEASURES = ("total_tokens", "latency")


def _recipe_filter(df: DataFrame, recipes: str | Sequence[str] | None, dataset: str | None) -> DataFrame:
    if recipes is not None:
        rs = [recipes] if isinstance(recipes, str) else list(recipes)
        df = df.where(F.col("recipe").isin(rs))
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    return df


def metric_names(
    feedbacks: DataFrame, recipes: Sequence[str] | None = None, how: str = "union"
) -> DataFrame:
    """Metric names of the given recipes: their union, or the names every
    recipe has (``how="intersection"``)."""
    fb = _recipe_filter(feedbacks, recipes, None)
    if how == "union":
        return fb.select("name").distinct()
    if how == "intersection":
        n = len(set(recipes)) if recipes is not None else fb.select("recipe").distinct().count()
        per = fb.groupBy("name").agg(F.count_distinct("recipe").alias("n_recipes"))
        return per.where(F.col("n_recipes") == n).select("name")
    raise ValueError(f"how must be 'union' or 'intersection', not {how!r}")


def list_metrics(feedbacks: DataFrame, recipes: Sequence[str] | None = None, how: str = "union") -> list[str]:
    return sorted(r["name"] for r in metric_names(feedbacks, recipes, how).collect())


def recipe_metrics(feedbacks: DataFrame, recipes: Sequence[str]) -> dict[str, list[str]]:
    # Each name becomes a column of the comparison, so all of them are read.
    rows = _recipe_filter(feedbacks, recipes, None).select("recipe", "name").distinct().collect()
    out: dict[str, list[str]] = {r: [] for r in recipes}
    for row in rows:
        out[row["recipe"]].append(row["name"])
    return {r: sorted(v) for r, v in out.items()}


def wide_scores(feedbacks: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per record, one column per metric: the latest ``done`` result.

    A single aggregation (one shuffle on the record key) replaces one join per
    metric. Only ``done`` rows count; when a metric has several, the one with
    the latest ``last_ts`` wins.
    """
    done = feedbacks.where(F.col("status") == "done")
    aggs = [
        F.max_by(F.when(F.col("name") == m, F.col("result")), F.when(F.col("name") == m, F.col("last_ts"))).alias(m)
        for m in metrics
    ]
    if not aggs:
        return done.select(*keys).distinct()
    return done.where(F.col("name").isin(list(metrics))).groupBy(*keys).agg(*aggs)


def run_frame(
    records: DataFrame,
    feedbacks: DataFrame,
    recipes: str | Sequence[str] | None = None,
    dataset: str | None = None,
    metadata_filter: dict[str, Any] | None = None,
    include_io: bool = False,
    metrics: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """recipe, dataset, record_id, metadata, total_tokens, latency,
    [input, output], [``keep`` record columns], one column per metric.

    Records without any ``done`` feedback stay (left join), their scores null.
    """
    rec = _recipe_filter(records, recipes, dataset)
    if metadata_filter:
        rec = rec.where(metadata_predicate("metadata", metadata_filter))
    fb = _recipe_filter(feedbacks, recipes, dataset)
    if metrics is None:
        metrics = list_metrics(fb)
    cols = [
        *KEYS,
        "metadata",
        F.col("n_tokens").alias("total_tokens"),
        latency_seconds("start_time", "end_time").alias("latency"),
    ]
    if include_io:
        cols += ["input", "output"]
    cols += list(keep)
    base = rec.select(*cols)
    scores = wide_scores(fb, metrics)
    return base.join(scores, list(KEYS), "left").select(base.columns + list(metrics))


def null_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in cols})


def chart_data(
    records: DataFrame,
    feedbacks: DataFrame,
    recipes: Sequence[str] | None = None,
    dataset: str | None = None,
    metadata_filter: dict[str, Any] | None = None,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Run frames of several recipes in one scan; negative scores become null
    (latency and tokens are never nulled). Metric columns are the sorted
    union over the recipes; a recipe without a metric has nulls there."""
    if metrics is None:
        metrics = list_metrics(_recipe_filter(feedbacks, recipes, dataset))
    frame = run_frame(records, feedbacks, recipes, dataset, metadata_filter, False, metrics)
    return null_negative(frame, metrics)


def metrics_long(chart: DataFrame, metrics: Sequence[str], latency: bool = True) -> DataFrame:
    """Melt metric columns (and latency) to (record_id, recipe, dataset, metric, value)."""
    values = list(metrics) + (["latency"] if latency else [])
    return chart.unpivot(["record_id", "recipe", "dataset"], values, "metric", "value")


def compare_runs(
    records: DataFrame,
    feedbacks: DataFrame,
    recipes: Sequence[str],
    dataset: str | None,
    golden: DataFrame | None = None,
    metadata_filter: dict[str, Any] | None = None,
) -> DataFrame:
    """Side-by-side comparison of recipes on the same questions.

    Rows are aligned on ``input`` (null-safe: null inputs align with each
    other). Duplicate inputs within a recipe are aligned by occurrence
    number in order of (start_time, record_id), so the k-th run of a
    question in one recipe meets the k-th run in the others (no pair
    multiplication). Columns: ``input``,
    ``ground_truth``, ``output_<r>`` in recipe order, then alphabetically:
    ``metadata`` (first recipe's), ``<col>_<r>`` and, for exactly two
    recipes, ``<m>__diff`` = first minus second over the metrics common to
    all recipes plus total_tokens and latency. With ``dataset=None`` all
    datasets are compared at once and a ``dataset`` column is added.

    Plan: one scan, one ordinal step, one aggregation keyed on
    (dataset, input, occurrence) for any number of recipes.
    """
    recipes = list(recipes)
    per_recipe = recipe_metrics(feedbacks, recipes)
    union = sorted({m for ms in per_recipe.values() for m in ms})
    common = sorted(set.intersection(*(set(ms) for ms in per_recipe.values()))) if recipes else []
    frame = run_frame(records, feedbacks, recipes, dataset, metadata_filter, True, union, keep=["start_time"])
    group = ["dataset", "input"]
    frame = group_ordinal(frame, ["recipe", *group], ["start_time", "record_id"], name="_occ", salt=time_bucket("start_time"))

    aggs = []
    first = recipes[0]
    aggs.append(F.max(F.when(F.col("recipe") == first, F.col("metadata"))).alias("metadata"))
    value_cols: dict[str, list[str]] = {}
    for r in recipes:
        cols = ["record_id", "total_tokens", "latency", "output", *per_recipe[r]]
        value_cols[r] = cols
        for c in cols:
            aggs.append(F.max(F.when(F.col("recipe") == r, F.col(c))).alias(f"{c}_{r}"))
    wide = frame.groupBy(*group, "_occ").agg(*aggs)

    if golden is not None:
        gt = golden if dataset is None else golden.where(F.col("dataset") == dataset)
        gt = gt.groupBy("dataset", "query").agg(F.max_by("ground_truth", "pos").alias("ground_truth"))
        wide = wide.join(
            gt, (wide["dataset"] == gt["dataset"]) & (wide["input"] == gt["query"]), "left"
        ).drop(gt["dataset"]).drop("query")
    else:
        wide = wide.withColumn("ground_truth", F.lit(None).cast("string"))

    diff_cols = []
    if len(recipes) == 2:
        a, b = recipes
        for m in [*common, *MEASURES]:
            diff_cols.append((F.col(f"{m}_{a}") - F.col(f"{m}_{b}")).alias(f"{m}__diff"))
        wide = wide.select("*", *diff_cols)

    outputs = [f"output_{r}" for r in recipes]
    rest = ["metadata"] + [f"{c}_{r}" for r in recipes for c in value_cols[r] if c != "output"]
    rest += [f"{m}__diff" for m in ([*common, *MEASURES] if len(recipes) == 2 else [])]
    lead = ["dataset"] if dataset is None else []
    return wide.select(*lead, "input", "ground_truth", *outputs, *sorted(rest))


#: Rows up to which a page is cut from the first rows of all.
TOP_ROWS = 10_000


def compare_page(
    df: DataFrame,
    where: Any = None,
    order_by: Sequence[Any] = (),
    page: int = 0,
    size: int = 10,
    tie_break: Sequence[str] = (),
    top_rows: int = TOP_ROWS,
) -> DataFrame:
    """One page of a (filtered, sorted) comparison with its 1-based row
    position. Add ``tie_break`` columns that make the order total, or pages
    may overlap.

    The first pages are planned as a top-k (each task keeps its best
    ``(page + 1) * size`` rows). Beyond ``top_rows`` rows the comparison is
    written once, dealt to ranges of the order; the ranges' row counts say
    which one or two hold the page, and only these are sorted.
    """
    if where is not None:
        df = df.where(where)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by] + [F.col(c).asc_nulls_first() for c in tie_break]
    start = page * size
    skip = start
    if start + size > top_rows and order:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = materialize(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "page-ranges")
        counts = dict(df.groupBy("_range").agg(F.count(F.lit(1))).collect())  # a row for each range
        mine, before = [], 0
        for r in sorted(counts):
            if before < start + size and before + counts[r] > start:
                skip = skip if mine else start - before
                mine.append(r)
            before += counts[r]
        df = df.where(F.col("_range").isin(mine)).drop("_range")
    top = df.orderBy(*order).offset(skip).limit(size) if skip else df.orderBy(*order).limit(size)
    return top.withColumn("row_pos", (F.row_number().over(Window.orderBy(*order)) + F.lit(start)).cast("long"))
