"""Streams that are run again, and files that arrive later."""
import pytest

from plumbline.session import scratch
from plumbline.specs import Rule
from plumbline.streaming import landing, quality


def test_later_files_are_loaded_and_earlier_ones_are_not_again(spark, rows):
    root = scratch(spark, "landing")
    for i in range(2):
        spark.createDataFrame([(str(i), "x")], "id STRING, v STRING").coalesce(1).write.mode("append").option("header", True).csv(f"{root}/in")
        landing.stream_bronze(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", ["id", "v"], f"run{i}", files_per_trigger=1)
    assert rows(spark.read.parquet(f"{root}/out"), "id", "_batch_id") == [("0", "run0"), ("1", "run1")]


def test_quality_over_several_batches(spark, rows):
    root = scratch(spark, "quality")
    rules = [Rule("t", "not_null", ("v",)), Rule("t", "range", ("n",), max=5), Rule("t", "references", ("n",), to="p.n")]
    parents = {"p": spark.createDataFrame([(1,), (1,), (9,)], "n INT")}
    schema = "v STRING, n INT"
    for data in ([("a", 1), (None, 9)], [("b", None), ("c", 2)]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        quality.stream_quality(stream, rules, f"{root}/out", f"{root}/checkpoint", parents)
    assert rows(quality.stored_rows(spark, f"{root}/out", "good"), "v", "n") == [("a", 1), ("b", None)]
    assert rows(quality.stored_rows(spark, f"{root}/out", "quarantine"), "v", "n") == [("c", 2), (None, 9)]
    assert rows(quality.results(spark, f"{root}/out")) == [("t.not_null_v", 4, 1), ("t.range_n", 4, 1), ("t.references_n", 4, 1)]


def test_rules_about_whole_tables_stay_in_batch_runs(spark):
    with pytest.raises(ValueError):
        quality.flagged(spark.range(1), [Rule("t", "unique", ("id",))])
