"""Time against distortion over hash families and scale factors, or over the degrees of the nearest-neighbour baseline."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

from arborist.operators.distortion import average_distortion, sampled_distortion
from arborist.plans.cluster_tree import cluster_tree, knn_tree
from arborist.session import stored

#: Scale factors of the sweep, and degrees of the baseline.
SCALE_FACTORS = (1.02, 1.05, 1.1, 1.2, 1.3, 1.5, 2.0, 3.0)
DEGREES = (20, 50, 100, 200)


def _measured(points: DataFrame, make, runs: int, nsample: int) -> tuple[float, float, float]:
    """Mean seconds, distortion and average distortion over runs."""
    took, worst, mean = 0.0, 0.0, 0.0
    for run in range(runs):
        began = time.time()
        tree = stored(make(run), "sweep")
        took += time.time() - began
        worst += sampled_distortion(points, tree, nsample, run).first()["distortion"]
        mean += average_distortion(points, tree, nsample, run).first()["distortion"]
    return took / runs, worst / runs, mean / runs


def sweep(points: DataFrame, d_min: float, d_max: float, families: Sequence[str] = ("balls", "lipschitz", "experimental"), factors: Sequence[float] = SCALE_FACTORS, runs: int = 1, nsample: int = 10_000) -> Iterator[tuple]:
    """(family, scale factor, seconds, distortion, average distortion), one at a time."""
    for family in families:
        for factor in factors:
            yield family, factor, *_measured(points, lambda seed, f=factor, lsh=family: cluster_tree(points, d_min, d_max, f, lsh, seed), runs, nsample)


def baseline(points: DataFrame, degrees: Sequence[int] = DEGREES, nsample: int = 10_000) -> Iterator[tuple]:
    """("neighbours", degree, seconds, distortion, average distortion) of the exact nearest-neighbour tree."""
    for k in degrees:
        yield "neighbours", k, *_measured(points, lambda _, k=k: knn_tree(points, k), 1, nsample)
