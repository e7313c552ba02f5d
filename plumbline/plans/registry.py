"""The registered queries: a name, a plan over the given tables, and the SQL another engine checks it with."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(plan):
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = plan
        if oracle:
            ORACLES[name] = oracle
        return plan
    return keep


def on_folder(plan: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plan(Tables(spark, folder))
    return run


def doubles(df: DataFrame, *columns: str) -> DataFrame:
    """Exact decimals as doubles, for comparison with another engine."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def text_list(column: str):
    return F.array_join(F.col(column), ",").alias(column)
