"""Evaluation tables derived from the shared test tables (FIXTURES.md, part B).

Every frame here is a plain Spark plan over the given parquet files, so its
size grows with the scale factor. No windows over a handful of huge groups
are used: identifiers come from arithmetic on the source keys, and small
side tables (``benchmark``) are reached through equi-joins whose strategy
Catalyst picks from the measured size.

The DuckDB twins of these derivations live in ``evalflow.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalflow.functions.text import REASON_KEYS
from evalflow.session import spread

# Metric names in the order the fixture assigns their formulas.
METRICS = ("answer_correctness", "answer_relevance", "context_relevance", "groundedness")


# Lookup tables that only feed broadcast joins and scalar counts; spreading
# them would add a shuffle in front of a broadcast.
LOOKUPS = ("benchmark",)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared test table, spread over the available cores when it arrives
    as fewer splits (each test file is a single row group)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df if name in LOOKUPS else spread(df)


def _lookup(bench: DataFrame, prefix: str) -> DataFrame:
    """``benchmark`` keyed uniquely by item id. Grouping by the key tells the
    optimizer the right side of the left join is unique, so plans that never
    read the contexts drop the join altogether."""
    return bench.groupBy(F.col("item_id").alias(f"{prefix}_id")).agg(F.first("text").alias(f"{prefix}_text"))


def _k() -> Column:
    return F.get_json_object("props", "$.k")


def _reason(n: Column) -> Column:
    crit, evid = REASON_KEYS
    full = F.concat(F.lit(f"{crit}: c"), n.cast("string"), F.lit(f"\n{evid}: e"), n.cast("string"))
    short = F.concat(F.lit(f"{crit}: c"), n.cast("string"))
    return F.when(n % 29 == 0, F.lit(None).cast("string")).when(n % 13 == 0, short).otherwise(full)


def _event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records (B1) plus the ``event_id`` the feedback formulas need."""
    ev = read_table(spark, sf_dir, "events")
    bench = read_table(spark, sf_dir, "benchmark")
    n_bench = bench.select(F.count(F.lit(1))).scalar()
    b0 = _lookup(bench, "b0")
    b1 = _lookup(bench, "b1")
    ev = ev.withColumns(
        {
            "k0": F.pmod(F.col("event_id") * 3, n_bench),
            "k1": F.pmod(F.col("event_id") * 7 + 1, n_bench),
        }
    )
    ev = ev.join(b0, ev.k0 == b0.b0_id, "left").join(b1, ev.k1 == b1.b1_id, "left")
    eid = F.col("event_id")
    metadata = F.concat(
        F.lit('{"k":'), _k(),
        F.lit(',"seg":"s'), (eid % 7).cast("string"),
        F.lit('","hot":'), F.when(eid % 2 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit("}"),
    )

    def ctx(text: str, item: str) -> Column:
        return F.struct(
            F.col(text).alias("page_content"),
            F.concat(F.lit('{"item":'), F.col(item).cast("string"), F.lit("}")).alias("metadata"),
        )

    return ev.select(
        F.col("event_type").alias("recipe"),
        F.concat(F.lit("ds"), (F.col("user_id") % 3).cast("string")).alias("dataset"),
        F.concat(F.lit("r"), eid.cast("string")).alias("record_id"),
        F.concat(F.lit("q"), F.floor(eid / 5).cast("string")).alias("input"),
        F.concat(F.lit("a-"), eid.cast("string"), F.lit("."), _k()).alias("output"),
        metadata.alias("metadata"),
        F.array(ctx("b0_text", "b0_id"), ctx("b1_text", "b1_id")).alias("contexts"),
        (_k().cast("bigint") * 10).alias("n_tokens"),
        F.col("ts").alias("start_time"),
        F.expr("timestampadd(MICROSECOND, cast(round(value * 100000) as bigint), ts)").alias("end_time"),
        F.lit(None).cast("string").alias("error"),
        eid.alias("event_id"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: five recipes (event types) x three datasets of run records."""
    return _event_base(spark, sf_dir).drop("event_id")


def feedbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 + B5: four metric rows per record, with statuses, calls and a
    second, later ``done`` answer_relevance row for every 41st record."""
    base = _event_base(spark, sf_dir)
    eid = F.col("event_id")
    entries = [F.struct(F.lit(i).alias("ord"), F.lit(name).alias("name"), F.lit(0).alias("dup")) for i, name in enumerate(METRICS)]
    dup = F.struct(F.lit(1).alias("ord"), F.lit(METRICS[1]).alias("name"), F.lit(1).alias("dup"))
    metric_rows = F.when(eid % 41 == 0, F.array(*entries, dup)).otherwise(F.array(*entries))
    fb = base.select("*", F.explode(metric_rows).alias("m"))
    ord_, is_dup = F.col("m.ord"), F.col("m.dup") == 1
    s = eid + ord_
    status = (
        F.when(is_dup, F.lit("done"))
        .when(s % 17 == 0, F.lit("failed"))
        .when(s % 19 == 0, F.lit("none"))
        .when(s % 23 == 0, F.lit("running"))
        .otherwise(F.lit("done"))
    )
    result = (
        F.when(is_dup, ((eid * 13) % 11).cast("double") / 10)
        .when(ord_ == 0, ((eid * 7) % 12 - 1).cast("double") / 10)
        .when(ord_ == 1, ((eid * 5) % 11).cast("double") / 10)
        .when(ord_ == 2, ((eid * 3) % 11).cast("double") / 10)
        .otherwise((eid % 101).cast("double") / 100)
    )

    def call(reason: Column, reasons: Column, context: Column, score: Column) -> Column:
        return F.struct(
            reason.alias("reason"), reasons.alias("reasons"), context.alias("context"), score.alias("score")
        )

    null_s = F.lit(None).cast("string")
    score_of = lambda n: (n % 11).cast("double") / 10
    unmatched = F.lit("context not in the retrieved list")
    ctx1 = F.when(eid % 31 == 0, unmatched).otherwise(F.col("contexts")[1]["page_content"])
    calls = (
        F.when(ord_ == 0, F.array(call(F.concat(F.lit("Criteria: agreement "), eid.cast("string")), null_s, null_s, result)))
        .when(ord_ == 1, F.array(call(_reason(eid), null_s, null_s, score_of(eid))))
        .when(
            ord_ == 2,
            F.array(
                call(_reason(eid), null_s, F.col("contexts")[0]["page_content"], score_of(eid)),
                call(_reason(eid + 1), null_s, ctx1, score_of(eid + 1)),
            ),
        )
        .otherwise(
            F.array(
                call(null_s, F.concat(F.lit("Statement 0: supported "), eid.cast("string")), null_s, score_of(eid * 3)),
                call(null_s, F.concat(F.lit("Statement 1: supported "), eid.cast("string")), null_s, score_of(eid * 3 + 1)),
            )
        )
    )
    last_ts = F.expr("timestampadd(SECOND, m.ord + 1 + m.dup * 100, start_time)")
    return fb.select(
        "recipe", "dataset", "record_id",
        F.col("m.name").alias("name"),
        status.alias("status"),
        result.alias("result"),
        calls.alias("calls"),
        last_ts.alias("last_ts"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metadata per (recipe, dataset), as the query step records it."""
    rec = records(spark, sf_dir).select("recipe", "dataset").distinct()
    meta = F.to_json(
        F.struct(
            F.lit("pipelines/query.py").alias("script_path"),
            F.lit("query_pipeline").alias("method_name"),
            F.col("recipe").alias("recipe_name"),
            F.create_map(F.lit("chunk_size"), F.length("recipe") * 50, F.lit("k"), F.length("recipe")).alias("ingredients"),
            F.col("dataset").alias("dataset_name"),
            F.lit("lexical").alias("llm_provider"),
            F.lit(None).cast("string").alias("model_name"),
        ),
        {"ignoreNullFields": "false"},
    )
    return rec.select("recipe", "dataset", meta.alias("metadata"))


def query_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3: user turns answered by the next assistant turn."""
    conv = read_table(spark, sf_dir, "conversations")
    u = conv.where(F.col("role") == "user").alias("u")
    a = conv.where(F.col("role") == "assistant").alias("a")
    j = u.join(a, (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1))
    return j.select(
        F.concat(F.lit("conv"), (F.col("u.conv_id") % 2).cast("string")).alias("dataset"),
        (F.col("u.conv_id") * 100 + F.col("u.turn")).alias("pos"),
        F.col("u.text").alias("query"),
        F.col("a.text").alias("ground_truth"),
        F.col("u.conv_id").alias("conv_id"),
        F.col("u.turn").alias("turn"),
    )


def golden_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden set for the event records: several answers per query, the one
    with the highest ``pos`` is the one that counts."""
    bench = read_table(spark, sf_dir, "benchmark")
    return bench.select(
        F.concat(F.lit("ds"), (F.col("item_id") % 3).cast("string")).alias("dataset"),
        F.col("item_id").alias("pos"),
        F.concat(F.lit("q"), F.floor(F.col("item_id") / 6).cast("string")).alias("query"),
        F.col("text").alias("ground_truth"),
    )


def eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: text records to score: question, the answer given two turns later
    (null when the conversation ends), the ground truth and two contexts."""
    q = query_items(spark, sf_dir)
    conv = read_table(spark, sf_dir, "conversations")
    bench = read_table(spark, sf_dir, "benchmark")
    n_bench = bench.select(F.count(F.lit(1))).scalar()
    nxt = conv.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("n_conv"), F.col("turn").alias("n_turn"), F.col("text").alias("output")
    )
    q = q.join(nxt, (nxt.n_conv == q.conv_id) & (nxt.n_turn == q.turn + 3), "left")
    q = q.withColumns(
        {
            "c0": F.pmod(F.col("conv_id") * 3 + F.col("turn"), n_bench),
            "c1": F.pmod(F.col("conv_id") * 7 + F.col("turn") + 1, n_bench),
        }
    )
    b0 = _lookup(bench, "b0")
    b1 = _lookup(bench, "b1")
    q = q.join(b0, q.c0 == b0.b0_id, "left").join(b1, q.c1 == b1.b1_id, "left")

    def ctx(text: str, item: str) -> Column:
        return F.struct(
            F.col(text).alias("page_content"),
            F.concat(F.lit('{"item":'), F.col(item).cast("string"), F.lit("}")).alias("metadata"),
        )

    return q.select(
        F.lit("lexical").alias("recipe"),
        "dataset",
        F.concat(F.lit("c"), F.col("pos").cast("string")).alias("record_id"),
        F.col("query").alias("input"),
        "output",
        F.array(ctx("b0_text", "b0_id"), ctx("b1_text", "b1_id")).alias("contexts"),
        "ground_truth",
        "pos",
    )


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipe rows with ordered ingredients derived from the event types:
    source = type, chunk_size in {100, 200}, k = length of the type name."""
    types = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("t")).distinct()
    rows = types.select("t", F.explode(F.array(F.lit(100), F.lit(200))).alias("chunk_size"))
    ingredients = F.array(
        F.struct(F.lit("source").alias("key"), F.col("t").alias("value")),
        F.struct(F.lit("chunk_size").alias("key"), F.col("chunk_size").cast("string").alias("value")),
        F.struct(F.lit("k").alias("key"), F.length("t").cast("string").alias("value")),
    )
    return rows.select(ingredients.alias("ingredients"))


# Question kinds assigned to conversation turns for the loader fixture.
def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw question rows as a JSON-lines question file would hold them:
    query, answer (null when the user turn got no reply), question_type and
    the extra fields conv_id and turn."""
    from evalflow.sources.questions import QUESTION_KINDS

    conv = read_table(spark, sf_dir, "conversations")
    u = conv.where(F.col("role") == "user").alias("u")
    a = conv.where(F.col("role") == "assistant").alias("a")
    j = u.join(a, (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1), "left")
    kinds = F.array(*[F.lit(k) for k in QUESTION_KINDS])
    return j.select(
        F.col("u.conv_id").alias("conv_id"),
        F.col("u.text").alias("query"),
        F.col("a.text").alias("answer"),
        F.element_at(kinds, ((F.col("u.conv_id") + F.col("u.turn")) % len(QUESTION_KINDS) + 1).cast("int")).alias("question_type"),
        F.col("u.turn").alias("turn"),
    )
