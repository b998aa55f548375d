"""Minimum spanning forests under the strict order (w, u, v).

Every partition keeps the forest of its own edges, which holds all of the
answer; partitions merge in rounds, so no task meets more than ``FAN`` forests.
Beyond ``FOLD_EDGES`` edges, or on demand, Boruvka's rounds do it with
aggregates and joins only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.functions.vectors import l2
from arborist.session import stored
from arborist.sources.points import numbered

FAN = 8
#: Vertices whose forest one task can fold (some 200 bytes each in its tables); beyond it, Boruvka, with the same result.
FOLD_VERTICES = 2_000_000
EDGE = "u bigint, v bigint, w double"


class Sets:
    """Disjoint sets over any integers, joined by size."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.size: dict[int, int] = {}

    def find(self, a: int) -> int:
        root = a
        while (up := self.parent.get(root, root)) != root:
            root = up
        while a != root:
            self.parent[a], a = root, self.parent.get(a, root)
        return root

    def join(self, a: int, b: int) -> bool:
        """Joins the sets of a and b; on equal sizes the root of a stays."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.size.get(a, 1) < self.size.get(b, 1):
            a, b = b, a
        self.parent[b] = a
        self.size[a] = self.size.get(a, 1) + self.size.get(b, 1)
        return True


def weighted(points: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with their lengths w; each edge once, u < v."""
    each = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    left, right = points.select(F.col("id").alias("u"), F.col("x").alias("xu")), points.select(F.col("id").alias("v"), F.col("x").alias("xv"))
    return each.join(left, "u").join(right, "v").select("u", "v", l2("xu", "xv").alias("w"))


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The minimum forest of a partition, holding one batch and the forest so far."""
    kept = None
    for frame in frames:
        all_ = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
        u, v, w = (all_[c].to_numpy() for c in ("u", "v", "w"))
        order, sets = np.lexsort((v, u, w)), Sets()
        kept = all_.iloc[[i for i in order.tolist() if sets.join(int(u[i]), int(v[i]))]]
    if kept is not None:
        yield kept


def boruvka(edges: DataFrame) -> DataFrame:
    """u, v, w of the forest by rounds: each component takes its least edge, then components merge."""
    now = stored(edges.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")), "boruvka-edges")
    picked = None
    while now.head(1):
        e = F.struct("w", "u", "v")
        ends = now.select("a", "b", e.alias("e")).union(now.select("b", "a", e.alias("e")))
        best = stored(ends.groupBy("a").agg(F.min(F.struct("e", "b")).alias("m")).select("a", F.col("m.b").alias("b"), "m.e"), "boruvka-best")
        new = best.select("e.*").distinct().select("u", "v", "w")
        picked = new if picked is None else picked.unionByName(new)
        up = best.toDF("id", "up", "e")
        # strict order leaves only two-cycles, each broken at its smaller end
        back = up.select(F.col("id").alias("up"), F.col("up").alias("back"))
        roots = up.join(back, "up", "left").select("id", F.when((F.col("back") == F.col("id")) & (F.col("id") < F.col("up")), F.col("id")).otherwise(F.col("up")).alias("up"))
        roots = stored(roots, "boruvka-roots")
        while True:
            jump = roots.select(F.col("id").alias("up"), F.col("up").alias("top"))
            nxt = stored(roots.join(jump, "up", "left").select("id", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved")), "boruvka-roots")
            roots = nxt.drop("moved")
            if not nxt.where("moved").head(1):
                break
        a, b = roots.toDF("a", "ta"), roots.toDF("b", "tb")
        moved = now.join(a, "a", "left").join(b, "b", "left").select("u", "v", "w", F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).where("a <> b")
        now = stored(moved, "boruvka-edges")
    return picked if picked is not None else edges.select("u", "v", "w").limit(0)


def forest(edges: DataFrame) -> DataFrame:
    """u, v, w of the minimum forest, by partial and final folds. edges: u, v, w."""
    out = edges.select("u", "v", "w").mapInPandas(_forest, EDGE)
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        parts = -(-parts // FAN)
        out = out.repartition(parts).mapInPandas(_forest, EDGE)
    return out


def ranked(frame: DataFrame, *order: str, name: str = "j") -> DataFrame:
    """``frame`` with ``name`` 0, 1, ... in order; sorted in ranges, never in one task."""
    kept = [c for c in frame.columns if c != name]
    return numbered(frame.select(*kept), *order).withColumnRenamed("id", name).select(*kept, name)


def mst(points: DataFrame, edges: DataFrame, fold_vertices: int = FOLD_VERTICES) -> DataFrame:
    """j, u, v, w of the minimum spanning tree, j by ascending (w, u, v). An unconnected graph is an error."""
    n = points.count()
    lengths = weighted(points, edges)
    tree = stored(forest(lengths) if n <= fold_vertices else boruvka(lengths), "mst")
    if tree.count() != max(n - 1, 0):
        raise ValueError("the graph is not connected")
    return ranked(tree, "w", "u", "v").select("j", "u", "v", "w")
