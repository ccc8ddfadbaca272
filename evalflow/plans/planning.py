"""Work planning: exact sampling, pipeline keys, work plan, resume, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalflow.functions.text import decode_text, recipe_name
from evalflow.operators.metrics import METRIC_NAMES

_HASH_BITS = 60
_BUCKET_BITS = 16


def sample_hash(seed: int | str, id_col: str | Column) -> Column:
    """Seeded 60-bit hash of the question id (md5, reproducible anywhere)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.concat(F.lit(f"{seed}:"), c.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sample_exact(
    df: DataFrame,
    p: float,
    seed: int | str = 0,
    by: Sequence[str] = ("dataset",),
    id_col: str = "pos",
    order_col: str = "pos",
) -> DataFrame:
    """Exactly ``floor(p * n)`` rows per group, without replacement: the rows
    with the smallest seeded hash (ties by ``order_col``). ``p <= 0`` or
    ``p >= 1`` keeps everything.

    No window spans a whole group (a dataset is one huge group): rows are
    counted per (group, hash bucket) with 2**16 buckets, a running sum over
    that small table finds the boundary bucket, and only the rows of the
    boundary bucket are ranked.
    """
    if p <= 0 or p >= 1:
        return df
    h = F.coalesce(sample_hash(seed, id_col), F.lit(0))  # a row without an id takes part too
    rows = df.withColumn("_h", h).withColumn("_b", F.shiftright(F.col("_h"), _HASH_BITS - _BUCKET_BITS))
    # one struct as group key: its equality holds for null fields as well
    rows = rows.withColumn("_g", F.struct(*[F.col(c) for c in by]))
    counts = rows.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_g").orderBy("_b")
    buckets = counts.select(
        "_g", "_b", "_c",
        (F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1))).alias("_before"),
        F.floor(F.lit(float(p)) * F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_k"),
    ).withColumn("_before", F.coalesce("_before", F.lit(0)))
    buckets = buckets.where(F.col("_before") < F.col("_k"))
    tagged = rows.join(buckets, ["_g", "_b"], "inner")
    whole = tagged.where(F.col("_before") + F.col("_c") <= F.col("_k"))
    edge = tagged.where(F.col("_before") + F.col("_c") > F.col("_k"))
    rank = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h", order_col))
    edge = edge.withColumn("_r", rank).where(F.col("_before") + F.col("_r") <= F.col("_k")).drop("_r")
    return whole.unionByName(edge).drop("_g", "_h", "_b", "_c", "_before", "_k")


def pipeline_keys(
    recipes: DataFrame,
    used: Sequence[str],
    step: str,
    script: str,
    method: str,
) -> DataFrame:
    """Recipes whose pipeline would run identically share a key: step type,
    script, method and the ingredients the method actually uses (in order).

    ``recipes`` has ``ingredients array<struct<key, value>>`` and optionally
    ``recipe``; a missing name is generated as ``k1_v1_k2_v2``. Output:
    step, pipeline_key, ingredients (used only), recipes (sorted names).
    """
    named = recipes if "recipe" in recipes.columns else recipes.withColumn("recipe", recipe_name("ingredients"))
    used_arr = F.array(*[F.lit(u) for u in used]) if used else F.array().cast("array<string>")
    kept = F.filter("ingredients", lambda e: F.array_contains(used_arr, e["key"]))
    key = F.concat_ws("_", F.lit(step), F.lit(script), F.lit(method), recipe_name(kept))
    keyed = named.select("recipe", kept.alias("used"), F.when(F.size(kept) > 0, key).otherwise(
        F.concat_ws("_", F.lit(step), F.lit(script), F.lit(method))).alias("pipeline_key"))
    return keyed.groupBy("pipeline_key").agg(
        F.first("used").alias("ingredients"),
        F.array_sort(F.collect_set("recipe")).alias("recipes"),
    ).select(F.lit(step).alias("step"), "pipeline_key", "ingredients", "recipes")


def work_plan(questions: DataFrame, pipelines: DataFrame | Sequence[str], key_col: str = "pipeline_key") -> DataFrame:
    """Every pipeline x every question: the pending work before resume.

    The product is the operator's result. Pipelines may be a list of keys or
    a table; a table that has ``ingredients`` passes them on to each row.
    The planner broadcasts the pipelines when their size allows it.
    """
    if not isinstance(pipelines, DataFrame):
        keys = F.array(*[F.lit(k) for k in sorted(set(pipelines))]).cast("array<string>")
        return questions.select(F.explode(keys).alias("recipe"), *questions.columns)
    more = ["ingredients"] if "ingredients" in pipelines.columns else []
    keys = pipelines.select(F.col(key_col).alias("recipe"), *more).dropDuplicates(["recipe"])
    return questions.crossJoin(keys).select("recipe", *questions.columns, *more)


def _recorded(records: DataFrame, stored_encoded: bool) -> DataFrame:
    inp = decode_text("input") if stored_encoded else F.col("input")
    return records.select(F.struct("recipe", "dataset", inp.alias("query")).alias("_done")).distinct()


def _work_key() -> Column:
    return F.struct("recipe", "dataset", "query")


def pending(work: DataFrame, records: DataFrame, stored_encoded: bool = True) -> DataFrame:
    """Work whose question was not yet recorded for the same recipe and
    dataset, nulls equal to nulls. Stored inputs are JSON string literals
    when ``stored_encoded``; they are decoded before the exact comparison.
    The recorded side is de-duplicated first so a repeated question is one
    key, not many."""
    done = _recorded(records, stored_encoded)
    return work.join(done, _work_key() == F.col("_done"), "left_anti")


def unscored(records: DataFrame, feedbacks: DataFrame, metrics: Sequence[str] = METRIC_NAMES) -> DataFrame:
    """Records that lack feedback, of whatever status, for some of ``metrics``,
    with the names they lack as ``lacking`` (sorted)."""
    wanted = F.array(*[F.lit(m) for m in metrics]).cast("array<string>")
    key = F.struct("recipe", "dataset", "record_id")
    have = feedbacks.where(F.col("name").isin(list(metrics))).groupBy(key.alias("_key")).agg(F.collect_set("name").alias("_have"))
    none = F.array().cast("array<string>")
    lacking = F.array_sort(F.array_except(wanted, F.coalesce("_have", none)))
    joined = records.join(have, key == F.col("_key"), "left").withColumn("lacking", lacking)
    return joined.where(F.size("lacking") > 0).select(*records.columns, "lacking")


def progress(
    work: DataFrame,
    records: DataFrame,
    feedbacks: DataFrame | None = None,
    metrics: Sequence[str] = METRIC_NAMES,
    stored_encoded: bool = True,
) -> DataFrame:
    """Per recipe and dataset: questions planned, questions finished (already
    recorded), feedbacks expected over the chosen ``metrics``, feedbacks
    done (null without a ``feedbacks`` table) and whether nothing is
    pending. A feedback is a record and a metric, however many rows it has;
    it is done if one of them is. The work is read once: one left join with
    the recorded keys and conditional counts.
    """
    done = _recorded(records, stored_encoded)
    out = work.join(done, _work_key() == F.col("_done"), "left").groupBy("recipe", "dataset").agg(
        F.count(F.lit(1)).alias("questions"),
        F.count("_done").alias("finished"),
    )
    fb_done = F.lit(None).cast("long")
    if feedbacks is not None:
        due = feedbacks.where((F.col("status") == "done") & F.col("name").isin(list(metrics)))
        due = due.select("recipe", "dataset", "record_id", "name").distinct()
        n = due.groupBy(F.struct("recipe", "dataset").alias("_fk")).agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(n, F.struct("recipe", "dataset") == F.col("_fk"), "left")
        fb_done = F.coalesce("_n", F.lit(0)).cast("long")
    expected = (F.col("questions") * len(metrics)).cast("long")
    complete = F.col("questions") == F.col("finished")
    if feedbacks is not None:
        complete = complete & (fb_done >= expected)
    return out.select(
        "recipe", "dataset", "questions", "finished",
        expected.alias("feedbacks"), fb_done.alias("feedbacks_done"), complete.alias("complete"),
    )


def fan_out(results: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Results of shared pipelines (``recipe`` holds the pipeline key) under
    the name of every recipe that uses them; ``pipelines`` is the output of
    ``pipeline_keys``."""
    names = pipelines.select(F.col("pipeline_key").alias("_key"), F.explode("recipes").alias("_name"))
    out = results.join(names, F.col("recipe") == F.col("_key"))
    return out.select(*[F.col("_name").alias("recipe") if c == "recipe" else F.col(c) for c in results.columns])
