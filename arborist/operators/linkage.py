"""Cut weights of a spanning tree's edges, and the dendrogram.

Both start from one ordered pass over n - 1 rows that only tracks which sets
merge; all geometry is done by joins, aggregates and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborist.functions.vectors import l2
from arborist.operators.mst import Sets, ranked
from arborist.session import stored

LINKAGE = "row bigint, left bigint, right bigint, height double, size bigint"


def _tree(points: DataFrame, mst: DataFrame) -> None:
    n, (m, pairs) = points.count(), mst.agg(F.count("*"), F.count_distinct(F.struct(F.least("u", "v"), F.greatest("u", "v")))).first()
    if m != max(n - 1, 0) or pairs != m:
        raise ValueError("a spanning tree of n points has n - 1 distinct edges")


def _merges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (step, j, c0, c1, v): v null for the merge itself, else a point of its lighter side."""
    sets, inside = Sets(), {}
    for frame in frames:
        rows = []
        for step, j, u, v in frame[["step", "j", "u", "v"]].itertuples(index=False):
            c0, c1 = sets.find(u), sets.find(v)
            if c0 == c1:
                raise ValueError("the edges hold a cycle")
            if sets.size.get(c0, 1) < sets.size.get(c1, 1):
                c0, c1 = c1, c0
            light = inside.pop(c1, [c1])
            rows.append((step, j, c0, c1, None))
            rows += [(step, j, c0, c1, x) for x in light]
            inside.setdefault(c0, [c0]).extend(light)
            sets.join(c0, c1)
        yield pd.DataFrame(rows, columns=["step", "j", "c0", "c1", "v"]).astype({"v": "Int64"})


def merge_log(mst: DataFrame) -> DataFrame:
    """step, j, c0 (centre that stays), c1, v: merges in order of edge length, and the points of each lighter side."""
    steps = ranked(mst, "w", "u", "v", name="step").select("step", "j", "u", "v")
    return steps.repartition(1).sortWithinPartitions("step").mapInPandas(_merges, "step bigint, j bigint, c0 bigint, c1 bigint, v bigint")


def cut_weight(points: DataFrame, mst: DataFrame) -> DataFrame:
    """``mst`` (j, u, v, w; any order of j) with cw, the cut weight of each edge."""
    _tree(points, mst)
    if "w" not in mst.columns:
        a, b = points.toDF("u", "xu"), points.toDF("v", "xv")
        mst = mst.join(a, "u").join(b, "v").select("j", "u", "v", l2("xu", "xv").alias("w"))
    mst = stored(mst, "tree")
    log = stored(merge_log(mst), "merge-log")
    x0, x1 = points.toDF("c0", "x0"), points.toDF("v", "x1")
    merges = log.where("v is null").drop("v").join(x0, "c0").join(points.toDF("c1", "x1"), "c1")
    merges = merges.select("step", "j", "c0", "c1", l2("x0", "x1").alias("d"))
    reach = log.where("v is not null").join(x0, "c0").join(x1, "v").groupBy("c0", "step").agg(F.max(l2("x0", "x1")).alias("reach"))
    before = Window.partitionBy("c0").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = merges.join(reach, ["c0", "step"]).withColumn("r0", F.coalesce(F.max("reach").over(before), F.lit(0.0)))
    # the centre that goes has its radius from the steps in which it stayed
    final = reach.groupBy(F.col("c0").alias("c1")).agg(F.max("reach").alias("r1"))
    d, r1 = F.col("d"), F.coalesce("r1", F.lit(0.0))
    cw = steps.join(final, "c1", "left").select("j", (5 * F.greatest(d, F.col("r0") - d, r1 - d)).alias("cw"))
    return mst.join(cw, "j")


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets, top, row, n = Sets(), {}, 0, None
    for frame in frames:
        out = []
        for u, v, h, total in frame[["u", "v", "cw", "n"]].itertuples(index=False):
            n = total
            a, b = sets.find(u), sets.find(v)
            if a == b:
                raise ValueError("the edges hold a cycle")
            size = sets.size.get(a, 1) + sets.size.get(b, 1)
            out.append((row, top.get(a, a), top.get(b, b), h, size))
            sets.join(a, b)
            top[sets.find(a)] = n + row
            row += 1
        yield pd.DataFrame(out, columns=["row", "left", "right", "height", "size"])


def single_linkage_label(mst: DataFrame) -> DataFrame:
    """row, left, right, height, size from a tree with cw (j, u, v, cw): edges join in order of (cw, j); row i makes node n + i. Ids are 0..n-1."""
    n = mst.count() + 1
    rows = mst.select("j", "u", "v", "cw", F.lit(n).cast("bigint").alias("n"))
    return rows.repartition(1).sortWithinPartitions("cw", "j").mapInPandas(_fold, LINKAGE)
