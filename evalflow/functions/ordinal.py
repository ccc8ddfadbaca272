"""Skew-safe ordinals within groups.

``row_number().over(partitionBy(g))`` sends a whole group to one task, so a
group holding a third of the table becomes a single task. ``group_ordinal``
splits every group into ``buckets`` salted sub-groups by a hash of the
ordering key, numbers rows inside each sub-group, and adds the exclusive
prefix count of the earlier sub-groups. The result is a dense 1..n ordinal
per group, unique and deterministic. A group of n rows yields at most
min(n, buckets) salts, so the many buckets cost small groups nothing while a
hot group is cut into up to 65,536 pieces; the prefix window runs over at
most that many rows per group. By default ``salt = md5_bucket(order)``, which
fits where any fixed numbering will do. Given a ``salt`` that never decreases
along ``order`` (``time_bucket`` of the leading time column), the ordinal
follows ``order`` itself, so the k-th row is the k-th in time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_bucket(cols: Sequence[str], buckets: int) -> Column:
    """Bucket in [0, buckets) from the first 32 bits of an md5 of the columns
    (md5 rather than xxhash64 so that other engines can reproduce it)."""
    text = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in cols])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def time_bucket(c: str, seconds: int = 60) -> Column:
    """Coarse slot of a timestamp that never decreases with it; rows without
    a time come first, as in an ascending sort."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))
    return F.coalesce(F.floor(micros / F.lit(seconds * 1_000_000)), F.lit(-(1 << 62))).cast("long")


def group_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "ordinal",
    buckets: int = 1 << 16,
    salt: Column | None = None,
) -> DataFrame:
    # The group is one struct column: struct equality treats null fields as
    # equal, so plain equality is null-safe, and the window's partitioning on
    # (group, salt) also serves the join back, so the rows shuffle once.
    piece = md5_bucket(order, buckets) if salt is None else salt
    salted = df.withColumns({"_g": F.struct(*[F.col(k) for k in keys]), "_salt": piece})
    salted = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_salt").orderBy(*order)))
    # counted with a partial aggregate: only one count per task and piece is shuffled
    counts = salted.groupBy("_g", "_salt").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_g").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_g").alias("_o_g"), F.col("_salt").alias("_o_salt"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
    )
    joined = salted.join(offsets, (salted["_g"] == offsets["_o_g"]) & (salted["_salt"] == offsets["_o_salt"]), "inner")
    out = joined.withColumn(name, (F.col("_off") + F.col("_r")).cast("long"))
    return out.drop("_g", "_salt", "_r", "_off", "_o_g", "_o_salt")
