"""Closeness of numbers, verdicts of checks, kinds of principals, times."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operators a check may state, and the form of an expectation.
EXPECTATION = r"^\s*(>=|<=|==|!=|>|<)\s*(-?[0-9.]+)\s*$"
# Fixed value: the usual form of a UUID, which names a service principal.
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def relative_difference(a: Column, b: Column) -> Column:
    """|a-b| over the larger magnitude; 0 where both are 0, null where either is null."""
    scale = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(scale == 0, F.lit(0.0)).otherwise(F.abs(a - b) / scale)


def close_relative(a: Column, b: Column, tolerance: float) -> Column:
    """Both null, or within a symmetric relative tolerance."""
    return F.coalesce(relative_difference(a, b) <= tolerance, a.isNull() & b.isNull())


def close_to_truth(value: Column, truth: Column) -> Column:
    """Both null, or within a cent or a millionth of the truth, whichever is larger."""
    allowed = F.greatest(F.lit(0.01), F.abs(truth) * F.lit(0.000001))
    return F.coalesce(F.abs(value - truth) <= allowed, value.isNull() & truth.isNull())


def verdict(observed: Column, expect: Column) -> Column:
    """Does ``observed`` satisfy an expectation such as ``>= 100``? Null or unreadable fails."""
    op = F.regexp_extract(expect, EXPECTATION, 1)
    bound = F.regexp_extract(expect, EXPECTATION, 2).try_cast("double")
    passed = (F.when(op == ">=", observed >= bound).when(op == "<=", observed <= bound)
              .when(op == "==", observed == bound).when(op == "!=", observed != bound)
              .when(op == ">", observed > bound).when(op == "<", observed < bound))
    return F.coalesce(passed, F.lit(False))


def principal_kind(principal: Column) -> Column:
    return F.when(principal.contains("@"), "user").when(principal.rlike(UUID), "service_principal").otherwise("group")


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def tenth_hours(since: Column, now: Column) -> Column:
    """Hours between two times to one decimal; rounding tenths keeps halves exact."""
    return F.round((seconds(now) - seconds(since)) / 360) / 10


def tenth_minutes(since: Column, now: Column) -> Column:
    return F.round((seconds(now) - seconds(since)) / 6) / 10
