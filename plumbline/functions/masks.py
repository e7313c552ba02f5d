"""Column masks."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING_ONLY = ("hash", "email", "last4")
KINDS = ("redact", "null", *STRING_ONLY)


def mask(value: Column, kind: str | None, dtype: str = "string", sql: str | None = None) -> Column:
    """``sql`` is a custom expression over ``value`` columns; otherwise one of :data:`KINDS`."""
    if sql is not None:
        return F.expr(sql)
    if kind not in KINDS:
        raise ValueError(f"unknown mask {kind!r}")
    if kind in STRING_ONLY and dtype != "string":
        raise ValueError(f"{kind} masks strings, not {dtype}")
    if kind == "null" or (kind == "redact" and dtype != "string"):
        return F.lit(None).cast(dtype)
    if kind == "redact":
        return F.lit("***")
    if kind == "hash":
        return F.sha2(value, 256)
    if kind == "email":
        return F.regexp_replace(value, "^[^@]+", "***")
    return F.concat(F.lit("***"), F.right(value, F.lit(4)))
