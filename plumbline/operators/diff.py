"""Two versions of keyed rows side by side: three-way difference, incremental plan, certified latest.

Both versions are stacked and grouped once by key, so null keys meet null keys, a key on many rows is folded before
the shuffle, and neither version is joined to the other. What is folded has a fixed width, so that rows are folded in place by
hash and never sorted: numbers, times and booleans themselves, a 64-bit hash of everything else. Whose texts differ is thus known
without moving texts; :func:`with_text` fetches those that are shown.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import squeeze

FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def is_fixed(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, FIXED)


def digest(value: Column) -> Column:
    """A 64-bit hash of a value; null stays null."""
    return F.when(value.isNotNull(), F.xxhash64(value))


def side_by_side(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, n_left, n_right, left, right: how often each side has the key, and a struct of its values, texts as their :func:`digest`.

    For a key that is repeated on one side the struct has the largest of each value; the count tells. All are null where a side
    lacks the key.
    """
    both = left.select(*keys, F.lit(True).alias("_left"), *values).unionByName(right.select(*keys, F.lit(False).alias("_left"), *values))
    carried = {v: F.col(v) if is_fixed(both, v) else digest(F.col(v)) for v in values}
    sides = {"left": F.col("_left"), "right": ~F.col("_left")}
    found = both.groupBy(*keys).agg(
        *[F.count_if(on).alias(f"n_{side}") for side, on in sides.items()],
        *[F.max(F.when(on, c)).alias(f"_{side}_{v}") for side, on in sides.items() for v, c in carried.items()])
    structs = [F.struct(*[F.col(f"_{side}_{v}").alias(v) for v in values]).alias(side) for side in sides] if values else []
    return found.select(*keys, "n_left", "n_right", *structs)


def with_text(found: DataFrame, side: DataFrame, keys: Sequence[str], value: str, hashed: str, name: str) -> DataFrame:
    """Adds ``name``: the text of a side's ``value`` whose digest is in the column ``hashed``, null where that is null.

    The texts are merged with the rows found: they are as many as the side has rows, and estimates of their size, made from compressed
    files and before rows are exploded, let them be broadcast through the driver.
    """
    texts = side.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(value).alias(name), digest(F.col(value)).alias("_digest"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col(hashed) == F.col("_digest"))
    return found.join(texts.where(F.col("_digest").isNotNull()).distinct().hint("merge"), same, "left").drop("_digest", *[f"_key_{k}" for k in keys])


def _differs(side: str, other: str, value: str) -> Column:
    return ~F.col(f"{side}.{value}").eqNullSafe(F.col(f"{other}.{value}"))


def diff(want: DataFrame, have: DataFrame, keys: Sequence[str], values: Sequence[str] = (),
         loose_text: Sequence[str] = ()) -> DataFrame:
    """keys, problem (missing, extra, changed, duplicated), changed (names of the values that differ).

    ``duplicated``: the key is on several rows of ``have``; its values are then not compared. White space in the
    ``loose_text`` values does not count as a difference. Texts are compared by 64-bit hashes and do not travel.
    """
    def norm(df):
        return df.withColumns({c: squeeze(F.col(c)) for c in loose_text}) if loose_text else df

    both = side_by_side(norm(want), norm(have), keys, values)
    none = F.array().cast("array<string>")
    changed = F.array_compact(F.array(*[F.when(_differs("left", "right", v), F.lit(v)) for v in values])) if values else none
    problem = (F.when(F.col("n_right") == 0, "missing").when(F.col("n_left") == 0, "extra")
               .when(F.col("n_right") > 1, "duplicated").when(F.size("changed") > 0, "changed"))
    listed = F.when(F.col("problem") == "changed", F.col("changed")).otherwise(none)
    return (both.withColumn("changed", changed).withColumn("problem", problem)
            .where(F.col("problem").isNotNull())
            .select(*keys, "problem", listed.alias("changed"), "n_left", "n_right"))


def set_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows only one side has: columns, side ('missing' from right, 'extra' in right)."""
    both = side_by_side(left.select(*columns), right.select(*columns), columns, ())
    side = F.when(F.col("n_right") == 0, "missing").when(F.col("n_left") == 0, "extra")
    return both.withColumn("side", side).where(F.col("side").isNotNull()).select(*columns, "side")


def plan_changes(now: DataFrame, certified: DataFrame, key: str, full: bool = False) -> DataFrame:
    """key, action: new, changed, restore, unchanged, orphan.

    ``now`` has key, fingerprint, has_gaps, intact; ``certified`` has key, fingerprint. A new shape is ``changed`` when
    something is missing, else only restored; a known shape is ``unchanged`` when intact, else restored. ``full``
    makes every present asset new.
    """
    have = certified.select(key, "fingerprint", F.lit(False).alias("has_gaps"), F.lit(True).alias("intact"))
    both = side_by_side(now, have, [key], ["fingerprint", "has_gaps", "intact"])
    known = F.col("left.fingerprint").eqNullSafe(F.col("right.fingerprint"))
    action = F.when(F.col("n_left") == 0, "orphan")
    if full:
        action = action.otherwise("new")
    else:
        action = (action.when(F.col("n_right") == 0, "new")
                  .when(~known & F.col("left.has_gaps"), "changed").when(~known, "restore")
                  .when(F.col("left.intact"), "unchanged").otherwise("restore"))
    return both.select(key, action.alias("action"))


def certified_latest(ledger: DataFrame, certifications: DataFrame, keys: Sequence[str], values: Sequence[str],
                     recorded: str = "recorded_at", run: str = "run_id") -> DataFrame:
    """Last values per key among the ledger rows of certified runs; run id breaks a tie in time."""
    rows = ledger.join(certifications.select(run), run, "left_semi")
    last = F.max_by(F.struct(*[F.col(v) for v in values]), F.struct(F.col(recorded), F.col(run)))
    grouped = rows.groupBy(*keys).agg(last.alias("_last")) if keys else rows.agg(last.alias("_last"))
    return grouped.select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])


def fingerprint(parts: DataFrame, keys: Sequence[str], position: str, values: Sequence[str]) -> DataFrame:
    """keys, fingerprint: changes when any part, its values or its position change.

    Every part is hashed with its position and the hashes are summed exactly, so a group is folded where its rows
    are and is never gathered, however many parts it has.
    """
    text = F.to_json(F.struct(F.col(position).cast("string").alias("p"), *[F.col(v).cast("string").alias(v) for v in values]))
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return (parts.select(*keys, part.alias("_part")).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_n"), F.sum("_part").alias("_sum"))
            .select(*keys, F.substring(F.sha2(F.concat_ws(":", F.col("_n"), F.col("_sum")), 256), 1, 12).alias("fingerprint")))
