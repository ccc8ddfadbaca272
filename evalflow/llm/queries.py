"""Registered queries of the numbered operators, over their whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalflow.llm import bpe, chat, contamination, lines, periods, pieces, projections, quality, ranked, secret_scan, shingle_join, suffix, toxicity
from evalflow.llm.shared import table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.linked_groups(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", lines.url_host(F.col("url")).alias("host"), lines.page_text(F.col("html")).alias("text"))
    found = lines.drop_boilerplate(pages, F.col("host"))
    kept = F.array_remove(F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(lines.BLANKS))), "")
    return found.select("page_id", "host", "n_lines", "n_dropped", F.array_join(kept, "\n").alias("text"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_spans(table(spark, sf_dir, "documents"), passage=suffix.PASSAGE)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_shared_words")


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.preference(chat.pairs_from_conversations(table(spark, sf_dir, "conversations")))
    return found.withColumns({c: chat.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(), digest=True).drop("text")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda s: s["kind"].isin(*secret_scan.KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in secret_scan.KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked.build_index(table(spark, sf_dir, "documents"))
    return ranked.search(index, table(spark, sf_dir, "benchmark"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path("piece_bpe_32k.model"), digest=True).drop("text")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.collapse(table(spark, sf_dir, "documents"), periods.repeated_tail, digest=True)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest")["col2"]).alias("start"),
        F.col("longest")["length"].alias("length"),
        (-F.col("longest")["col3"]).alias("period"),
        F.floor(1000 * F.col("longest")["length"] / (-F.col("longest")["col3"])).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_dedup,
        op2_toxicity,
        op3_ngram_join,
        op4_line_dedup,
        op5_suffix_dedup,
        op6_preference_format,
        op7_quality,
        op8_bpe,
        op9_secrets,
        op10_decontamination,
        op11_ranked_search,
        op12_pieces,
        op13_periodic_runs,
    )
}
ORACLE: dict[str, str] = {"op4_line_dedup": lines.ORACLE_SQL, "op6_preference_format": chat.ORACLE_SQL, "op10_decontamination": contamination.ORACLE_SQL, "op11_ranked_search": ranked.ORACLE_SQL}
