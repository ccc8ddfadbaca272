"""Question-set loaders: JSON lines (one question per line, typed subsets)
and single JSON documents with an ``examples`` list.

Both produce ``query_items(dataset, pos, query, ground_truth, metadata)``;
``pos`` is the position in the source so that "last duplicate wins" rules
can be applied later without relying on partition order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- fixed values that must equal the reference's output -----------------
# Question kinds of the JSON-lines question sets, usable as subsets.
QUESTION_KINDS = (
    "aggregation",
    "comparison",
    "false_premise",
    "multi-hop",
    "post-processing",
    "set",
    "simple_w_condition",
    "simple",
)
# --------------------------------------------------------------------------


def check_subsets(subsets: Sequence[str], kinds: Sequence[str] = QUESTION_KINDS) -> list[str]:
    unknown = [s for s in subsets if s not in kinds]
    if unknown:
        raise ValueError(f"unknown subset(s) {unknown}; choices are {list(kinds)}")
    return list(subsets)


def questions_from_frame(
    df: DataFrame,
    dataset: str | Column,
    pos: str | Column,
    subsets: Sequence[str] = (),
    query_col: str = "query",
    answer_col: str = "answer",
    kind_col: str = "question_type",
) -> DataFrame:
    """Subset filter, null query/answer dropped, every other field kept as
    JSON ``metadata`` (the kind included)."""
    subsets = check_subsets(subsets)
    if subsets:
        df = df.where(F.col(kind_col).isin(subsets))
    df = df.where(F.col(query_col).isNotNull() & F.col(answer_col).isNotNull())
    skip = {query_col, answer_col}
    if isinstance(pos, str):
        skip.add(pos)
    if isinstance(dataset, str) and dataset in df.columns:
        skip.add(dataset)
        ds = F.col(dataset)
    else:
        ds = F.lit(dataset) if isinstance(dataset, str) else dataset
    rest = [c for c in df.columns if c not in skip]
    p = F.col(pos) if isinstance(pos, str) else pos
    meta = F.to_json(F.struct(*[F.col(c) for c in rest])) if rest else F.lit("{}")
    return df.select(
        ds.alias("dataset"),
        p.cast("long").alias("pos"),
        F.col(query_col).alias("query"),
        F.col(answer_col).alias("ground_truth"),
        meta.alias("metadata"),
    )


def with_file_pos(raw: DataFrame, name: str = "_pos") -> DataFrame:
    """Adds the position of each row in order of (file path, block, row),
    unique over all files of one load. Tasks do not read splits in file
    order, so the splits (one row each in a small table) are ranked, and the
    row number inside the task follows."""
    tagged = raw.select(
        "*",
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("_split"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    )
    splits = tagged.select(F.col("_split").alias("_s")).distinct()
    ranks = splits.select("_s", (F.row_number().over(Window.orderBy("_s")) - 1).cast("long").alias("_rank"))
    joined = tagged.join(ranks, F.col("_split") == F.col("_s"))
    pos = F.shiftleft("_rank", 33) + F.col("_row")
    return joined.withColumn(name, pos).drop("_split", "_row", "_s", "_rank")


def load_questions_jsonl(
    spark: SparkSession, path: str | Sequence[str], dataset: str, subsets: Sequence[str] = (), schema=None
) -> DataFrame:
    """JSON lines question files (``.bz2`` and other Hadoop codecs are read
    natively): kind subset, null query/answer dropped, other fields become
    metadata. Give a ``schema`` to spare the pass that infers one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return questions_from_frame(with_file_pos(reader.json(path)), dataset, "_pos", subsets)


def load_questions_examples(spark: SparkSession, path: str | Sequence[str], dataset: str) -> DataFrame:
    """JSON documents ``{"examples": [{"query", "reference_answer"}, ...]}``;
    metadata is empty. Positions are unique over all files of one load: the
    file's number, in path order, and the example's within it."""
    doc = spark.read.option("multiLine", True).json(path)
    ex = doc.select(F.col("_metadata.file_path").alias("file"), F.posexplode("examples").alias("pos", "e"))
    files = ex.select("file").distinct()  # names alone
    ranks = files.select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("rank"))
    return ex.join(ranks, "file").select(
        F.lit(dataset).alias("dataset"),
        (F.shiftleft("rank", 33) + F.col("pos")).alias("pos"),
        F.col("e.query").alias("query"),
        F.col("e.reference_answer").alias("ground_truth"),
        F.lit("{}").alias("metadata"),
    )


def golden_lookup(questions: DataFrame) -> DataFrame:
    """query -> ground truth per dataset; for repeated queries the last one
    (highest ``pos``) wins. Partial aggregation keeps hot queries cheap."""
    return questions.groupBy("dataset", "query").agg(F.max_by("ground_truth", "pos").alias("ground_truth"))
