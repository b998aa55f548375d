"""From points to dendrogram."""

from __future__ import annotations

from pyspark.sql import DataFrame

from arborist.functions.draws import checked
from arborist.operators.knn import knn_edges
from arborist.operators.linkage import LINKAGE, cut_weight, single_linkage_label
from arborist.operators.lsh import spanner
from arborist.operators.mst import mst


def from_edges(points: DataFrame, edges: DataFrame) -> DataFrame:
    """row, left, right, height, size of the tree over a connected graph. Ids are 0..n-1."""
    if points.limit(2).count() < 2:
        return points.sparkSession.createDataFrame([], LINKAGE)
    return single_linkage_label(cut_weight(points, mst(points, edges)))


def cluster_tree(points: DataFrame, d_min: float = 0.01, d_max: float = 1000, scale_factor: float = 1.1, lsh: str = "balls", seed: int = 0, t: int | None = None) -> DataFrame:
    """The approximate ultrametric of points by the spanner of a hash family (``t`` as there)."""
    checked(d_min, d_max, scale_factor, lsh)
    return from_edges(points, spanner(points, scale_factor, d_min, d_max, lsh, seed, t))


def knn_tree(points: DataFrame, k: int = 70) -> DataFrame:
    """The baseline: the tree over the nearest-neighbour graph."""
    return from_edges(points, knn_edges(points, k))
