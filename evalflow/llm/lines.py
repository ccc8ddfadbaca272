"""Site-relative line dedup: drop lines that stand on too many of a host's pages.

A line counts once for each page; a host's lines are compared with the
host's own page total. A line on at least ``MIN_PAGES`` pages of a host and
on more than ``MAX_RATIO`` of them is boilerplate there and goes from every
page of the host. Blank lines are layout: never counted, never dropped.

Only (host, line hash) pairs are shuffled, pre-aggregated; the boilerplate
of a host is an array that is bounded by its pages' average number of lines
over the ratio. Lines are compared by 64-bit hash. DataFrame functions only.

Null hosts form one host of their own; null and empty texts have no lines and
stay as they are; repeated rows are pages of their own, unless ``once`` is
set: then pages of a host with the same lines count as one page, in the
total as well, so that copies of a whole page are no evidence of
boilerplate. Other columns pass through, whatever their names. An empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalflow.llm.shared import step, unused

MAX_RATIO = 0.1
MIN_PAGES = 3
#: Bytes of all hosts' boilerplate that go to every task; beyond, parts that a host's pages are dealt to.
BROADCAST_BYTES = 16 << 20
SALTS = 32


#: Blanks around a line that do not count.
BLANKS = " \t\r"


def line_key(line: F.Column) -> F.Column:
    """Identity of a line without its surrounding blanks; null for blank lines."""
    kept = F.btrim(line, F.lit(BLANKS))
    return F.when(kept != "", F.xxhash64(kept))


def boilerplate(
    pages: DataFrame, host: F.Column, text: F.Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, once: bool = False
) -> DataFrame:
    """(host, lines): the keys of each host's boilerplate lines; hosts without any are absent."""
    of = pages.select(host.alias("host"), F.transform(F.split(text, "\n", -1), line_key).alias("keys"))
    if once:  # the hash skips blank lines
        of = of.groupBy("host", F.xxhash64("keys").alias("page")).agg(F.first("keys").alias("keys"))
    of = of.select("host", F.array_distinct("keys").alias("keys"))
    total = of.groupBy("host").agg(F.count("*").alias("pages"))
    counts = (
        of.select("host", F.explode("keys").alias("key")).where("key is not null").groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    )
    return (
        counts.alias("c")
        .join(total.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
        .where(F.col("n") > max_ratio * F.col("pages"))
        .groupBy(F.col("c.host").alias("host"))
        .agg(F.collect_list("key").alias("lines"))
    )


def drop_boilerplate(
    pages: DataFrame, host: F.Column, text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, once: bool = False
) -> DataFrame:
    """``pages`` with ``text`` cleaned, n_lines (not blank) and n_dropped; columns of these names are replaced.

    The hosts' lists are written first. Up to ``BROADCAST_BYTES`` they go to
    the pages, which then stay where they are; beyond that they meet in a
    join on the host and one of ``SALTS`` parts, so that a hot host's pages
    are many tasks' work.
    """
    rest = pages.drop("n_lines", "n_dropped")
    of, part, other, lines, split, keys = unused([*rest.columns, text], "_of", "_part", "_host", "_lines", "_split", "_keys")
    found = step(boilerplate(pages, host, F.col(text), max_ratio, min_pages, once), "boilerplate")
    size = found.agg(F.sum(64 + 8 * F.size("lines") + F.coalesce(F.octet_length("host"), F.lit(0)))).first()[0] or 0
    found = found.select(F.col("host").alias(other), F.col("lines").alias(lines))
    rest = rest.withColumn(of, host)
    same = F.col(of).eqNullSafe(F.col(other))
    if size <= BROADCAST_BYTES:
        joined = rest.join(F.broadcast(found), same, "left")
    else:
        (own,) = unused([*rest.columns, other, lines, split, keys, part], "_own")
        salted = found.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rest.withColumn(own, F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, same & (F.col(own) == F.col(part)), "left").drop(own, part)
    joined = joined.withColumn(split, F.split(F.col(text), "\n", -1))
    keyed = joined.withColumn(keys, F.transform(split, line_key))
    goes = lambda key: key.isNotNull() & F.array_contains(lines, key)
    kept = F.array_join(F.filter(split, lambda line, i: ~F.coalesce(goes(F.get(keys, i)), F.lit(False))), "\n")
    none = F.col(lines).isNull()
    return keyed.withColumns(
        {
            text: F.when(none | F.col(text).isNull(), F.col(text)).otherwise(kept),
            "n_lines": F.coalesce(F.size(F.filter(keys, lambda key: key.isNotNull())), F.lit(0)).cast("long"),
            "n_dropped": F.when(none, 0).otherwise(F.coalesce(F.size(F.filter(keys, goes)), F.lit(0))).cast("long"),
        }
    ).drop(of, other, lines, split, keys)


#: Fixed text rules for raw pages: unseen elements go, tags end lines.
HIDDEN = r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->"
TAGS = r"(?s)<[^>]*>"


def page_text(html: F.Column) -> F.Column:
    return F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), TAGS, "\n")


def url_host(url: F.Column) -> F.Column:
    """Lower-case host of a web address; without one, the empty string; null stays null."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


#: DuckDB SQL for op4_line_dedup on pages, with the parameters above.
ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
         string_split(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', chr(10), 'gis'), '<[^>]*>', chr(10), 'gs'), chr(10)) AS raw
  FROM pages),
q AS (SELECT page_id, host, list_filter(list_transform(raw, lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> '') AS lines FROM p),
t AS (SELECT host, count(*) AS pages FROM q GROUP BY host),
l AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM q) GROUP BY host, line),
b AS (SELECT l.host, list(line) AS bad FROM l JOIN t ON l.host IS NOT DISTINCT FROM t.host WHERE n >= 3 AND n > 0.1 * pages GROUP BY l.host)
SELECT q.page_id, q.host, CAST(len(lines) AS BIGINT) AS n_lines,
       CAST(len(lines) - len(list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x))) AS BIGINT) AS n_dropped,
       array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)), chr(10)) AS text
FROM q LEFT JOIN b ON q.host IS NOT DISTINCT FROM b.host
"""
