"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

1. quality: documents that the classifier rejects go.
2. line dedup: a source's boilerplate lines go from its documents; copies of a document count as one page.
3. near duplicates: one row of each group stays, that of the smallest id.
4. decontamination: documents with benchmark passages go.
5. tokens: every document left, encoded.

Stages 1 to 4 return the columns of ``documents``; a stage works on all
that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalflow.llm import bpe, contamination, lines, quality, shingle_join
from evalflow.llm.queries import vocabulary_path
from evalflow.llm.shared import table, unused
from evalflow.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Word shingles and similarity of stage 3.
SHINGLE, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(*quality.training_rows(docs, table(spark, sf_dir, "labels"), "quality"))
    (score,) = unused(docs.columns, "score")
    return quality.score(docs, model, score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_boilerplate(docs, F.col("source"), once=True)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are told apart by id and text: of each group the one with the smallest id stays (null ids last), once."""
    (key,) = unused(docs.columns, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    groups = shingle_join.similar_groups(keyed.select(F.col(key).alias("doc_id"), "text"), SHINGLE, PERCENT).where("n_shingles > 0")
    members = groups.groupBy(F.col("doc_id").alias(key), "component_id").agg(F.count("*").alias("rows"))
    members = materialize(members, "near-groups")
    ids = keyed.groupBy(key).agg(F.first("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("without"), F.col("id"), F.col(key).alias("key"))
    stays = members.join(ids, key).groupBy("component_id").agg(F.min(order)["key"].alias("stays"))
    gone = members.join(stays, "component_id").where(F.col(key) != F.col("stays")).select(key)
    repeated = members.where("rows > 1").select(key)
    # of rows equal in id and text the first in the order of their other columns
    rest = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith(("map", "variant"))]
    twice = keyed.join(repeated, key, "left_semi")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    once = twice.groupBy(key).agg(F.min_by(whole, F.struct(F.lit(0), *rest)).alias("row")).select(key, "row.*") if rest else twice.dropDuplicates([key])
    return keyed.join(repeated, key, "left_anti").unionByName(once).join(gone, key, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where("contaminated")
    of, key = unused(docs.columns, "hit_id", "hit_key")
    gone = found.select(F.col("doc_id").alias(of), F.col("text_key").alias(key)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(key))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, vocabulary_path()).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL expresses neither the classifier nor the tokens; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
