"""Flat clusterings of a dendrogram."""

from __future__ import annotations

from heapq import heappop, heappush
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.operators.tree import nodes, parents
from arborist.session import stored


def frontier(linkage: DataFrame, n_clusters: int) -> list[int]:
    """Roots of the clusters in order of label.

    A node's place is when it came in. The highest node that has children, of
    equal ones that of the least place, gives way to its left and right child,
    ``n_clusters - 1`` times or until there are only leaves; labels go by place.
    Heights don't fall towards the root, so only rows as high as the
    (n_clusters - 1)-th highest can be split, and only those come to the driver.
    """
    n = linkage.count() + 1
    splits = min(n_clusters, n) - 1
    if splits < 1:
        return [2 * n - 2]
    least = linkage.orderBy(F.desc("height")).limit(splits).agg(F.min("height")).first()[0]
    high = {r["row"] + n: r for r in linkage.where(F.col("height") >= least).toLocalIterator()}
    places, ends, heap = count(), [], []

    def enter(node: int) -> None:
        if node in high:
            heappush(heap, (-high[node]["height"], next(places), node))
        else:
            ends.append((next(places), node))

    enter(2 * n - 2)
    for _ in range(splits):
        row = high[heappop(heap)[2]]
        enter(row["left"])
        enter(row["right"])
    return [node for _, node in sorted(ends + [(place, node) for _, place, node in heap])]


def _assigned(linkage: DataFrame, roots: DataFrame) -> DataFrame:
    """id, root of each leaf below the nodes of roots(node): pointer jumping that stops at roots."""
    n = linkage.count() + 1
    stop = roots.select(F.col("node"), F.lit(True).alias("stop"))
    up = nodes(linkage).select("node").join(parents(linkage).select("node", "parent"), "node", "left").join(stop, "node", "left")
    at = stored(up.select("node", F.when(F.col("stop"), F.col("node")).otherwise(F.coalesce("parent", "node")).alias("to")), "roots")
    while True:
        jump = at.join(at.toDF("to", "to2"), "to").select("node", F.col("to2").alias("to"), (F.col("to2") != F.col("to")).alias("moved"))
        jump = stored(jump, "roots")
        at = jump.drop("moved")
        if not jump.where("moved").head(1):
            return at.where(F.col("node") < n).select(F.col("node").alias("id"), F.col("to").alias("root"))


def clusters(linkage: DataFrame, n_clusters: int = 3) -> DataFrame:
    """id, label of each leaf: label is the place of its cluster in the frontier."""
    spark = linkage.sparkSession
    roots = spark.createDataFrame([(r, i) for i, r in enumerate(frontier(linkage, n_clusters))], "root bigint, label int")
    return _assigned(linkage, roots.select(F.col("root").alias("node"))).join(roots, "root").select("id", "label")


def clusters_at(linkage: DataFrame, height: float) -> DataFrame:
    """id, label of each leaf: label is the least leaf of its cluster, clusters being joined at or below ``height``."""
    n = linkage.count() + 1
    high = linkage.where(F.col("height") > height)
    kids = high.select(F.explode(F.array("left", "right")).alias("node"))
    root = linkage.sparkSession.range(1).select(F.lit(2 * n - 2).cast("bigint").alias("node"))
    tops = kids.unionByName(root).join(high.select((F.col("row") + n).cast("bigint").alias("node")), "node", "left_anti")
    found = _assigned(linkage, tops)
    label = found.groupBy("root").agg(F.min("id").alias("label"))
    return found.join(label, "root").select("id", "label")
