"""Session defaults and the shared work folder."""
from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORK_DIR_SETTING = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FEW = 10_000  # rows that may be broadcast whatever their estimate says
_local_dirs: dict[str, str] = {}


def session(app: str = "plumbline", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; a cluster's own settings win when ``master`` is left out."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false"))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only a local session may fall back to a temporary one."""
    shared = spark.conf.get(WORK_DIR_SETTING, None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {WORK_DIR_SETTING} to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="plumbline-")
    return _local_dirs[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the work folder, so that reruns never meet the files of an earlier attempt."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the work folder: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_or_merged(df: DataFrame) -> DataFrame:
    """A written table as one side of an inner join: broadcast if it has at most :data:`FEW` rows, else both sides are merged.

    Spark estimates a side from the size of compressed files and counts an exploded row once; on such estimates it may send through the
    driver what grows with the data.
    """
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df.hint("merge")


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside remove their shuffle files when they end, for jobs of many steps that each write a table once."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
