"""Connected components of a graph given as a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..sources.sinks import remove


def drop(*tables: DataFrame) -> None:
    """Deletes written tables, so that they take no disk beside what follows."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            remove(table.sparkSession, folder)


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of (x, y).

    Every round takes the smallest label among a node and its neighbours and then that label's own label; rounds are written, so
    nothing depends on lost executors, and end when no label changes. Labels fold before they are shuffled, so a node with very many
    links is not gathered. An empty table gives an empty one.
    """
    edges = written(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.y == labels.node).groupBy(edges.x.alias("n")).agg(F.min("component").alias("near"))
        least = labels.join(near.hint("merge"), labels.node == near.n).select("node", F.col("component").alias("was"), F.least("component", "near").alias("least"))
        above = labels.select(F.col("node").alias("least"), F.col("component").alias("above"))
        step = written(least.join(above, "least").select("node", F.least("least", "above").alias("component"),
                                                         (F.least("least", "above") != F.col("was")).alias("changed")), "labels")
        drop(labels)
        labels = step.select("node", "component")
        if step.where("changed").isEmpty():
            drop(edges)
            return labels
