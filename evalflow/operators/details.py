"""Per-record drill-down: judge calls, contexts, reasons, report cells.

Everything here is a projection, ``posexplode`` or a small per-record
aggregation; a selection of (recipe, record_id) pairs is a semi-join, so the
same code serves one clicked row or a whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalflow.functions.text import (
    REASON_KEYS,
    escape_markdown,
    format_2f,
    preview,
    split_reason,
)

REC_KEYS = ("recipe", "dataset", "record_id")


def _select(df: DataFrame, selection: DataFrame | None) -> DataFrame:
    if selection is None:
        return df
    keys = [k for k in REC_KEYS if k in selection.columns]
    return df.join(selection.select(*keys).distinct(), keys, "left_semi")


def record_calls(feedbacks: DataFrame, selection: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Judge calls of the selected records, one row each, in stored order
    (feedback rows by ``last_ts``, calls by position). No status filter."""
    fb = _select(feedbacks, selection)
    return fb.select(*REC_KEYS, "name", "last_ts", *keep, F.posexplode_outer("calls").alias("pos", "call")).select(
        *REC_KEYS, "name", "last_ts", "pos", *keep,
        F.col("call.reason").alias("reason"),
        F.col("call.reasons").alias("reasons"),
        F.col("call.context").alias("context"),
        F.col("call.score").alias("score"),
    ).where(F.col("pos").isNotNull())


def record_details(feedbacks: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Calls grouped per (record, metric), ordered: recipe, dataset,
    record_id, name, calls array<struct<reason, reasons, context, score>>.

    Groups are one record's calls for one metric, so the collected lists are
    small; the shuffle is keyed on the record.
    """
    calls = record_calls(feedbacks, selection)
    packed = F.struct(
        F.col("last_ts").alias("_ts"), F.col("pos").alias("_pos"),
        "reason", "reasons", "context", "score",
    )
    grouped = calls.groupBy(*REC_KEYS, "name").agg(F.array_sort(F.collect_list(packed)).alias("_calls"))
    return grouped.select(
        *REC_KEYS, "name",
        F.transform(
            "_calls",
            lambda c: F.struct(
                c["reason"].alias("reason"), c["reasons"].alias("reasons"),
                c["context"].alias("context"), c["score"].alias("score"),
            ),
        ).alias("calls"),
    )


def record_contexts(records: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Retrieved contexts of the selected records: 1-based chunk number,
    200-character preview, full text and metadata."""
    rec = _select(records, selection)
    ex = rec.select(*REC_KEYS, F.posexplode("contexts").alias("pos", "ctx"))
    return ex.select(
        *REC_KEYS,
        (F.col("pos") + 1).cast("long").alias("chunk"),
        preview(F.col("ctx.page_content")).alias("preview"),
        F.col("ctx.page_content").alias("page_content"),
        F.col("ctx.metadata").alias("metadata"),
    )


def reason_fields(calls: DataFrame, keys: Sequence[str] = REASON_KEYS) -> DataFrame:
    """Adds one column per reason label (``criteria``,
    ``supporting_evidence``) split out of ``reason``."""
    parts = split_reason(F.col("reason"), keys)
    return calls.withColumns({k.lower().replace(" ", "_"): parts[k] for k in keys})


def context_reasons(records: DataFrame, feedbacks: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Context-relevance calls matched to the record's contexts by exact text.

    ``context_index`` is the 0-based position of the context with that text
    (the last one when texts repeat); a call whose text is not among the
    contexts keeps its row with a null index.

    Feedback meets its record before the calls are cut apart, and a call
    finds its place in the record's own array: texts are no join keys, and
    the records send digests of theirs only.
    """
    fb = _select(feedbacks, selection).where(F.col("name") == "context_relevance")
    texts = F.transform("contexts", lambda c: F.sha2(c["page_content"], 256))
    own = _select(records, selection).select(F.struct(*REC_KEYS).alias("_rec"), texts.alias("_texts"))
    own = own.groupBy("_rec").agg(F.max_by("_texts", F.size("_texts")).alias("_texts"))
    joined = fb.join(own, F.struct(*REC_KEYS) == F.col("_rec"), "left")
    from_end = F.array_position(F.reverse("_texts"), F.sha2("context", 256))
    index = F.when(from_end > 0, F.size("_texts") - from_end).cast("long")
    calls = record_calls(joined, keep=["_texts"]).withColumn("context_index", index)
    out = reason_fields(calls)
    return out.select(
        *REC_KEYS, "last_ts", "pos", "context_index", "criteria", "supporting_evidence", "score"
    )


def report_cells(
    compare: DataFrame,
    recipes: Sequence[str],
    measures: Sequence[str],
    keys: Sequence[str] = ("dataset", "input"),
    integer_measures: Sequence[str] = ("total_tokens",),
) -> DataFrame:
    """Side-by-side report rows for every comparison row: ``Answer`` then one
    row per measure; one string column per recipe. Null -> "", answers are
    Markdown-escaped with newlines flattened, measures printed with two
    decimals except integer measures. Unpivoted with ``explode`` over an
    array built in the row, so no shuffle is involved."""
    rows = []

    def cells(legend: str, per_recipe) -> F.Column:
        return F.struct(F.lit(legend).alias("legend"), *[per_recipe(r).alias(r) for r in recipes])

    rows.append(cells("Answer", lambda r: escape_markdown(F.coalesce(F.col(f"output_{r}"), F.lit("")))))
    for m in measures:
        if m in integer_measures:
            rows.append(cells(m, lambda r, m=m: F.coalesce(F.col(f"{m}_{r}").cast("string"), F.lit(""))))
        else:
            rows.append(cells(m, lambda r, m=m: F.coalesce(format_2f(F.col(f"{m}_{r}").cast("double")), F.lit(""))))
    ex = compare.select(*keys, F.explode(F.array(*rows)).alias("row"))
    return ex.select(*keys, "row.*")


def answer_reasons(feedbacks: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Answer-relevance view: the record's first judge call (by feedback
    ``last_ts``, then position), its reason split into labels, with the
    score. ``min_by`` keeps one candidate per task before the shuffle, so no
    call list is gathered."""
    calls = record_calls(feedbacks.where(F.col("name") == "answer_relevance"), selection)
    first = calls.groupBy(*REC_KEYS).agg(
        F.min_by(F.struct("reason", "score"), F.struct("last_ts", "pos")).alias("c")
    )
    out = reason_fields(first.select(*REC_KEYS, F.col("c.reason").alias("reason"), F.col("c.score").alias("score")))
    return out.select(*REC_KEYS, "criteria", "supporting_evidence", "score")


def groundedness_reasons(feedbacks: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Groundedness view: every call's statement-level ``reasons`` and score
    (the free-text reason and context are not shown)."""
    calls = record_calls(feedbacks.where(F.col("name") == "groundedness"), selection)
    return calls.select(*REC_KEYS, "last_ts", "pos", "reasons", "score")
