"""Sensitivity classes and descriptions of columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_class(name: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Class of the first (pattern, class) whose pattern the name contains; null when none does."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(name.rlike(pattern), label).otherwise(out)
    return out


def class_rank(label: Column, classes: Sequence[str]) -> Column:
    """Position in the list from least to most restrictive; null for a class that is not in effect."""
    out = F.when(label == classes[0], 0)
    for i, c in enumerate(classes[1:], 1):
        out = out.when(label == c, i)
    return out


def make_consistent(proposals: DataFrame, settled: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Same column name, same class: the settled class, else the most restrictive one proposed.

    ``proposals``: table_name, column_name, sensitivity, sensitivity_source. ``settled``: column_name, sensitivity
    (certified or live). Only classes an agent chose are changed, and then marked ``consistency``.
    """
    def strictest(df, flag):
        return df.select("column_name", F.lit(flag).alias("settled"), class_rank(F.col("sensitivity"), classes).alias("rank"))

    known = (strictest(proposals, False).unionByName(strictest(settled, True)).where(F.col("rank").isNotNull())
             .groupBy("column_name")
             .agg(F.max(F.when(F.col("settled"), F.col("rank"))).alias("fixed"), F.max("rank").alias("highest")))
    labels = F.array(*[F.lit(c) for c in classes])
    chosen = F.get(labels, F.coalesce("fixed", "highest"))
    joined = proposals.join(known, "column_name", "left").withColumn("_class", chosen)
    moved = (F.col("sensitivity_source") == "agent") & F.col("_class").isNotNull() & ~F.col("_class").eqNullSafe(F.col("sensitivity"))
    return joined.select(
        "table_name", "column_name", F.when(moved, F.col("_class")).otherwise(F.col("sensitivity")).alias("sensitivity"),
        F.when(moved, F.lit("consistency")).otherwise(F.col("sensitivity_source")).alias("sensitivity_source"))


def keep_existing(live: Column, proposed: Column, weak_reason: Column | None = None, overwrite: bool = False) -> Column:
    """The live value unless it is missing, weak, or to be overwritten; then the proposal."""
    if overwrite:
        return proposed
    kept = live if weak_reason is None else F.when(weak_reason.isNull(), live)
    return F.coalesce(kept, proposed)
