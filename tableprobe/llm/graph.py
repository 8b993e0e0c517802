"""Connected components by randomised contraction, and the small union of links inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a, b); ``component`` is the smallest node reachable.

    In each round every node joins the neighbour, or itself, whose hash is least in that round; links between the
    nodes that were joined go. A round removes a constant share of the nodes in expectation, chains included, so a
    few rounds do for near copies and a logarithmic number for anything. Each round is written to the shared folder.
    Grouping combines within tasks first, so a node with very many links costs one row a task.
    """
    edges = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .where("a <> b").distinct())
    steps = []
    while not edges.isEmpty():
        order = [F.xxhash64(F.lit(len(steps)), F.col(c)) for c in "ab"]
        both = edges.select("a", F.struct(order[1].alias("h"), F.col("b").alias("to")).alias("best")).unionAll(
            edges.select(F.col("b").alias("a"), F.struct(order[0].alias("h"), F.col("a").alias("to")).alias("best")))
        own = F.struct(F.xxhash64(F.lit(len(steps)), F.col("a")).alias("h"), F.col("a").alias("to"))
        step = staged(both.groupBy("a").agg(F.min("best").alias("best")).select(
            "a", F.least(F.col("best"), own)["to"].alias("to")))
        steps.append(step)
        edges = staged(
            edges.join(step.withColumnRenamed("to", "x"), "a")
            .join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for step in steps[1:]:
        found = found.join(step.withColumnRenamed("a", "root"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root"))
    found = staged(found)
    return found.join(found.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of ``n`` positions by links between positions a and b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
    return label
