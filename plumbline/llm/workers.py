"""Lets Python workers import this package where it is not installed, as in a checkout."""
from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Adds the checkout to the workers' path. A cluster that ships the package (``--py-files``) is not affected."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), _ROOT])


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    importable(df.sparkSession)
    return df.mapInArrow(function, schema)
