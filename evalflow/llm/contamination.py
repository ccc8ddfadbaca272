"""Benchmark decontamination: a prefix-filtered set join, DataFrame functions only.

An item's windows (``WINDOW`` consecutive words; a shorter item is one
window) are sets of shingles, the adjacent word pairs, or the word of a
window of one. Shingles are ordered by how often the whole corpus holds
them. Containment needs every shingle of a window, so its rarest one is a
sufficient prefix: documents meet windows on it alone. The window's place
around the hit must lie inside the document (length and position bounds),
and the words there are compared exactly.

The corpus is never shuffled for the search: windows go to it in blocks of
at most about ``BLOCK_BYTES``, each joined to all documents, as many
blocks as the benchmark needs; hits alone are grouped. An item contained
in very many documents is only as many rows as it has hits.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
lowered. Null and empty texts have no words. Rows are told apart by
doc_id and text: repeated rows each get the result, null ids included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: A document is contaminated from one hit word in so many.
SHARE = 20

#: Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: F.Column) -> F.Column:
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS, -1), "")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, w): the distinct windows of every item, as arrays of words."""
    item = benchmark.select(F.col("item_id"), words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - window + 1, F.lit(1)))
    return item.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("_w", i, window))).alias("w")).distinct()


def shingles(w: F.Column) -> F.Column:
    """(key, off) of every adjacent pair, or of the only word."""
    pair = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1)).alias("key"), i.alias("off"))
    one = F.array(F.struct(F.xxhash64(F.get(w, F.lit(0)), F.lit("")).alias("key"), F.lit(0).alias("off")))
    return F.when(F.size(w) == 1, one).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 2), pair))


def tokens(documents: DataFrame, single: bool) -> DataFrame:
    """(doc_id, text_key, words, pos, key) of every shingle; of every word too if some window has one word."""
    at = documents.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words")).select(
        "doc_id", "text_key", "words", F.posexplode("words").alias("pos", "word")
    )
    after = F.get("words", F.col("pos") + 1)
    pairs = F.xxhash64("word", after)
    if single:
        keys = F.explode(F.array(F.when(after.isNotNull(), pairs), F.xxhash64("word", F.lit(""))))
        return at.select("doc_id", "text_key", "words", "pos", keys.alias("key"))
    return at.where(after.isNotNull()).select("doc_id", "text_key", "words", "pos", pairs.alias("key"))


def occurrences(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, w): every place of every window, from 0."""
    size = windows.agg(
        F.sum(F.octet_length(F.array_join("w", " "))).alias("bytes"), F.max((F.size("w") == 1).cast("int")).alias("single")
    ).first()
    n_blocks = -(-(size["bytes"] or 1) // BLOCK_BYTES)
    found = tokens(documents, bool(size["single"]))
    listed = windows.select("w").distinct().withColumn("block", F.pmod(F.xxhash64("w"), F.lit(n_blocks)))
    out = []
    for b in range(n_blocks):
        block = listed.where(F.col("block") == b).select("w", F.explode(shingles(F.col("w"))).alias("s")).select("w", "s.key", "s.off")
        seen = found.join(F.broadcast(block.select("key").distinct()), "key").groupBy("key").agg(F.count("*").alias("n"))
        rarest = (
            block.join(seen, "key")
            .groupBy("w")
            .agg(F.min(F.struct("n", "key", "off")).alias("m"), F.countDistinct("key").alias("have"), F.first(F.size(F.array_distinct(shingles(F.col("w")).getField("key")))).alias("need"))
            .where("have = need")  # a window with a shingle that no document holds is in none
            .select("w", "m.key", "m.off")
        )
        start = F.col("pos") - F.col("off")
        out.append(
            found.join(F.broadcast(rarest), "key")
            .where((start >= 0) & (start + F.size("w") <= F.size("words")))
            .where(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("w")) == F.col("w"))
            .select("doc_id", "text_key", start.alias("start"), "w")
        )
    return reduce(DataFrame.unionByName, out)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items, contaminated), a row for every document; items: sorted array of strings."""
    windows = item_windows(benchmark, window)
    hits = occurrences(documents, windows)
    covered = F.flatten(F.transform(F.collect_set(F.struct("start", F.size("w").alias("n"))), lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    per_row = hits.groupBy("doc_id", "text_key").agg(F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), F.collect_set("w").alias("ws"))
    found = (
        per_row.select("doc_id", "text_key", "n_hit", F.explode("ws").alias("w"))
        .join(windows, "w")
        .groupBy("doc_id", "text_key", "n_hit")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "n_hit", "items")
    )
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left").select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


#: DuckDB SQL for op10_decontamination, with the parameters above.
ORACLE_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS k, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
occ AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, occ.n, item_id FROM occ JOIN win USING (k, n)),
a AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
"""
