"""JSON / variant helpers for the open-ended ``metadata`` column."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_path(key: str) -> str:
    """A variant path that takes ``key`` literally (``a.b`` is one key)."""
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def meta_get(c: str | Column, key: str, type_: str = "string") -> Column:
    """Typed field of a JSON text column; null when absent or not castable."""
    return F.try_variant_get(F.try_parse_json(_col(c)), key_path(key), type_)


def json_kind(field: Column) -> Column:
    """``string`` / ``number`` / ``boolean`` / ``null`` / ``array`` / ``object``
    for a variant field (null when absent)."""
    t = F.schema_of_variant(field)
    return (
        F.when(field.isNull(), F.lit(None))
        .when(t == "STRING", F.lit("string"))
        .when(t == "BOOLEAN", F.lit("boolean"))
        .when(t == "VOID", F.lit("null"))
        .when(t.startswith("ARRAY"), F.lit("array"))
        .when(t.startswith("OBJECT"), F.lit("object"))
        .otherwise(F.lit("number"))
    )


def typed_equals(c: str | Column, key: str, value: Any) -> Column:
    """``metadata[key] == value`` with the JSON type respected: a string only
    matches a string, a number a number (compared as double), a bool a bool."""
    field = F.try_variant_get(F.try_parse_json(_col(c)), key_path(key), "variant")
    kind = json_kind(field)
    if isinstance(value, bool):
        return (kind == "boolean") & (F.try_variant_get(field, "$", "boolean") == F.lit(value))
    if isinstance(value, (int, float)):
        return (kind == "number") & (F.try_variant_get(field, "$", "double") == F.lit(float(value)))
    return (kind == "string") & (F.try_variant_get(field, "$", "string") == F.lit(str(value)))


def metadata_predicate(c: str | Column, metadata_filter: dict[str, Any] | None) -> Column:
    """AND of typed equalities; ``None`` / ``"<all>"`` values mean no filter."""
    cond = F.lit(True)
    for key, value in (metadata_filter or {}).items():
        if value is None or value == "<all>":
            continue
        cond = cond & typed_equals(c, key, value)
    return cond


def latency_seconds(start: str | Column, end: str | Column) -> Column:
    """Exact microsecond difference in seconds (works on NTZ timestamps)."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(1_000_000.0)
