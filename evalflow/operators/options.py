"""Metadata options for filters, recipe and dataset catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalflow.functions.json import json_kind
from evalflow.functions.text import HIDDEN_RUN_KEYS

# --- fixed values that must equal the reference's output -----------------
# A metadata key offers at most this many values; keys with more are dropped.
OPTION_CAP = 50
# First entry of every option list, meaning "no filter on this key".
ALL_OPTION = "<all>"
# --------------------------------------------------------------------------


def scalar_text(v: Column, kind: Column) -> Column:
    """Display text of a scalar variant: strings as is, numbers as doubles,
    booleans as true/false."""
    return (
        F.when(kind == "string", F.try_variant_get(v, "$", "string"))
        .when(kind == "number", F.try_variant_get(v, "$", "double").cast("string"))
        .when(kind == "boolean", F.try_variant_get(v, "$", "boolean").cast("string"))
    )


def metadata_values(records: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Distinct scalar (key, kind, value) triples of the JSON ``metadata``."""
    entries = records.select(*by, F.explode(F.from_json("metadata", "map<string,variant>")).alias("key", "v"))
    kind = json_kind(F.col("v"))
    typed = entries.select(*by, "key", kind.alias("kind"), scalar_text(F.col("v"), kind).alias("value"))
    return typed.where(F.col("kind").isin("string", "number", "boolean")).distinct()


def metadata_options(
    records: DataFrame,
    recipes: Sequence[str] | None = None,
    dataset: str | None = None,
    cap: int = OPTION_CAP,
    by: Sequence[str] = ("dataset",),
) -> DataFrame:
    """Filter choices per key and value type over the records of the given
    recipes: ``<all>`` followed by the sorted distinct values of that type as
    text. ``value_type`` (string, number, boolean) tells 1 from "1" and true
    from "true", as the typed filter does. Keys with more than ``cap`` values
    over all types are left out.

    The value lists are only collected for keys that passed the cap, so no
    group ever gathers an unbounded list.
    """
    rec = records
    if recipes is not None:
        rec = rec.where(F.col("recipe").isin(list(recipes)))
    if dataset is not None:
        rec = rec.where(F.col("dataset") == dataset)
    vals = metadata_values(rec, by).withColumn("_k", F.struct(*by, "key"))
    kept = vals.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= cap)
    small = vals.join(kept, "_k", "left_semi")
    lists = small.groupBy("_k", F.col("kind").alias("value_type")).agg(F.array_sort(F.collect_list("value")).alias("_vals"))
    return lists.select(
        "_k.*", "value_type", F.size("_vals").cast("long").alias("n_values"),
        F.concat(F.array(F.lit(ALL_OPTION)), F.col("_vals")).alias("values"),
    )


def visible_metadata(c: str | Column) -> Column:
    """Run metadata without the keys the catalog hides (map<string, variant>)."""
    m = F.from_json(F.col(c) if isinstance(c, str) else c, "map<string,variant>")
    hidden = F.array(*[F.lit(k) for k in HIDDEN_RUN_KEYS])
    return F.map_filter(m, lambda k, v: ~F.array_contains(hidden, k))


def dataset_catalog(runs: DataFrame) -> DataFrame:
    """dataset -> sorted recipes that ran on it."""
    return runs.groupBy("dataset").agg(F.array_sort(F.collect_set("recipe")).alias("recipes"))


def recipe_catalog(runs: DataFrame) -> DataFrame:
    """One row per (dataset, recipe) with the visible run metadata and the
    dataset's full recipe list."""
    cat = dataset_catalog(runs)
    return runs.join(cat, "dataset").select(
        "dataset", "recipe", visible_metadata("metadata").alias("metadata"), "recipes"
    )
