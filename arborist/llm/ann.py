"""Approximate nearest neighbours by balanced posting lists.

Largest inner product is turned into least distance: a vector x becomes
(x, sqrt(R^2 - |x|^2)) with R the largest norm, a query (q / |q|, 0) times R.

1. Centroids are fitted on a bounded sample (``SAMPLE`` vectors, least hashes
   first) by k-means, then penalties on full clusters; there are as many as lists
   of ``LIST`` vectors need, ``MOST_LISTS`` at most. The penalty is one
   more coordinate of the centroid, so every later distance holds it too and
   postings are as balanced as the fit.
2. A graph over the centroids, kept in memory by every task, finds the lists
   of a vector by best-first search over batches.
3. Every row is indexed: each vector goes to its nearest centroid's list and,
   if it lies near a boundary (distance within ``1 + NEAR`` of the nearest),
   to up to ``COPIES`` lists. A list with more rows than ``BLOCK`` is dealt
   into blocks by hash of the id, and its queries go to each block.
4. A query searches all lists whose centroid distance is within a ratio
   ``1 + RATIO`` of its nearest, up to a share ``PROBE`` of the lists. Lists
   and queries meet in a cogroup by (list, block, part of the queries), first
   the ``FIRST`` nearest lists, then the others, which give only what reaches
   the k-th score so far; a windowed merge keeps the k best. Scores are inner
   products of the original vectors in double precision, summed in order.

Exact copies of one vector need only the k + 1 smallest ids to fill any
answer, so a ranked limit per vector, pushed below the shuffle, drops the rest
before indexing without changing a result; one vector that fills a third of
all rows becomes k + 1 rows. Queries with the same vector are asked once, for
k + 1 ids, of which each drops its own. ``PROBE`` is measured, not assumed: see
README.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do those, queries or not, whose length differs
from the commonest among candidates (ties: the least); rows that repeat an id
and its vector count once, those that repeat an id with another vector are
indexed each, but a query never meets its own id and an answer names an id
once, with its best score; fewer candidates than k give all of them; no queries
give no rows; components may be as large as doubles are, scores then overflow
as the products do; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

SAMPLE, LIST, MOST_LISTS = 40_000, 128, 4096
NEAR, COPIES = 0.05, 3
RATIO, PROBE, LEAST_PROBES, FIRST = 0.45, 0.35, 32, 8
#: Rows of a list, and queries, that one group meets.
BLOCK, ASKED = 2_000, 8_000
DEGREE, BEAM = 24, 48


def _assigned(x: np.ndarray, c: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Each row's nearest centroid, and by how much it is nearer than the next, on average."""
    near, gap = [], 0.0
    for part in np.array_split(x, max(1, len(x) // 4096)):
        d = (c * c).sum(1) - 2 * part @ c.T + weight
        near.append(np.argmin(d, axis=1))
        if len(c) > 1:
            two = np.partition(d, 1, axis=1)[:, :2]
            gap += float((two[:, 1] - two[:, 0]).sum())
    return np.concatenate(near), gap / len(x)


def centroids(x: np.ndarray, lists: int, rounds: int = 8, steps: int = 24, seed: int = 7) -> np.ndarray:
    """Balanced clusters: k-means, then penalties that grow on full clusters until they are as even as they get.

    The last coordinate is the root of the penalty, which thus adds to squared distances.
    """
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    weight, mean = np.zeros(len(c)), len(x) / len(c)
    for _ in range(rounds):
        near, _ = _assigned(x, c, weight)
        size, total = np.bincount(near, minlength=len(c)), np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    best, least, unit = weight, np.inf, None
    for k in range(steps):
        near, gap = _assigned(x, c, weight)
        unit = gap if unit is None else unit
        size = np.bincount(near, minlength=len(c))
        if size.max() < least:
            best, least = weight.copy(), size.max()
        weight = weight + unit / (1 + k / 4) * np.clip(size / mean - 1, -1, 1)
        weight -= weight.min()
    return np.concatenate([c, np.sqrt(best)[:, None]], axis=1)


class Graph:
    """Nearest-neighbour graph of the centroids with batched best-first search."""

    def __init__(self, c: np.ndarray):
        self.c, self.sq = c, (c * c).sum(1)
        k = min(DEGREE, max(len(c) - 1, 0))
        self.links = np.zeros((len(c), k), np.int64)
        for i in range(0, len(c), 512):
            d = self.sq - 2 * c[i : i + 512] @ c.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            self.links[i : i + 512] = np.argsort(d, axis=1, kind="stable")[:, :k]
        # long links keep the graph connected: a fixed stride through all nodes
        far = (np.arange(len(c))[:, None] + (1 + np.arange(4)) * max(1, len(c) // 5)) % max(1, len(c))
        self.links = np.concatenate([self.links, far, (np.arange(len(c))[:, None] + 1) % max(1, len(c))], axis=1)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of about the ``width`` nearest centroids of each row, nearest first."""
        n, width = len(x), min(width, len(self.c))
        beam = min(len(self.c), max(width, BEAM))
        ids = np.tile(np.linspace(0, len(self.c) - 1, min(beam, len(self.c), 16)).astype(np.int64), (n, 1))
        rows, sq = np.arange(n)[:, None], (x * x).sum(1)[:, None]
        dist = lambda k: np.maximum(self.sq[k] - 2 * np.einsum("nkd,nd->nk", self.c[k], x) + sq, 0)
        seen = np.zeros((n, len(self.c)), bool)
        open_ = np.zeros((n, len(self.c)), bool)
        d = dist(ids)
        seen[rows, ids] = open_[rows, ids] = True
        while True:
            todo = np.where(open_[rows, ids], d, np.inf)
            pick = np.argsort(todo, axis=1, kind="stable")[:, :4]
            if not np.isfinite(todo[rows, pick]).any():
                break
            nodes = ids[rows, pick]
            go = np.isfinite(todo[rows, pick])
            open_[rows, nodes] = False
            more = np.where(go[:, :, None], self.links[nodes], nodes[:, :, None]).reshape(n, -1)
            fresh = ~seen[rows, more]
            order = np.argsort(more, axis=1, kind="stable")
            twice = np.zeros_like(fresh)
            m = more[rows, order]
            twice[rows, order] = np.concatenate([np.zeros((n, 1), bool), m[:, 1:] == m[:, :-1]], axis=1)
            fresh &= ~twice
            seen[rows, more] = True
            open_[rows, more] |= fresh
            ids, d = np.concatenate([ids, more], 1), np.concatenate([d, np.where(fresh, dist(more), np.inf)], 1)
            keep = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids, d = ids[rows, keep], d[rows, keep]
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        return ids[rows, order], np.sqrt(d[rows, order])


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, vec_id: str, vector: str, size: int | None = None) -> tuple[DataFrame, int]:
    """id, x array<double> of the vectors of ``size`` components (the commonest number if None) that take part; that size."""
    x = F.col("x")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0))
    if size is None:
        common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
        size = common["d"] if common else 0
    return rows.where(F.size("x") == size), size


def dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in order of position."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Each row over its largest component: products can't overflow."""
    return x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)


def _local_best(q: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score): each query's k best ids of one block, each with its best score, ties to the smaller id."""
    out = []
    by_id = np.argsort(x_id, kind="stable")
    x, x_id = x[by_id], x_id[by_id]
    starts = np.flatnonzero(np.concatenate([[True], x_id[1:] != x_id[:-1]])) if len(x_id) else np.zeros(0, np.int64)
    scale = np.abs(x).max(initial=1e-300)
    small, asked = x / scale, _unit(q)
    for i in range(0, len(q), 256):
        s = asked[i : i + 256] @ small.T
        if len(starts) > k:
            best = s if len(starts) == s.shape[1] else np.maximum.reduceat(s, starts, axis=1)
            least = np.partition(best, -k, axis=1)[:, -k] - 1e-9 * np.maximum(1, np.abs(s).max(initial=0))
            r, c = np.nonzero(s >= least[:, None])
        else:
            r, c = np.nonzero(np.ones_like(s, bool))
        score = dot(q[i + r], x[c])
        order = np.lexsort((x_id[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        if len(starts) < len(x_id):
            _, once = np.unique(np.stack([r, x_id[c]]), axis=1, return_index=True)
            once.sort()
            r, c, score = r[once], c[once], score[once]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        out.append((i + r[place < k], x_id[c[place < k]], score[place < k]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", ratio: float = RATIO, probe: float = PROBE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest by inner product."""
    spark = vectors.sparkSession
    rows, size = usable(vectors, vec_id, vector)
    asked, _ = usable(queries, vec_id, vector, size)
    copy = Window.partitionBy(F.xxhash64("x"), "x").orderBy("id")
    rows = rows.dropDuplicates(["id", "x"])
    index = written(rows.withColumn("n", F.row_number().over(copy)).where(F.col("n") <= k + 1).drop("n"), "vectors")
    n, scale = index.agg(F.count("*"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    # one query of each vector, under 128 bits of its hash
    mark = F.struct(F.xxhash64("x").alias("a"), F.xxhash64(F.lit(1), "x").alias("b"))
    asked = written(asked.dropDuplicates(["id", "x"]).withColumn("q", mark), "queries")
    alone = asked.select("q", "x").dropDuplicates(["q"])
    # the sum of squares of scaled components can't overflow
    radius = index.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v / scale) * (v / scale))))).first()[0]

    def lifted(x: np.ndarray) -> np.ndarray:
        x = x / scale
        return np.concatenate([x, np.sqrt(np.maximum(radius**2 - (x * x).sum(1), 0))[:, None]], axis=1)

    def turned(q: np.ndarray) -> np.ndarray:
        q = _unit(q)
        return np.concatenate([q * (radius / np.sqrt((q * q).sum(1)))[:, None], np.zeros((len(q), 2))], axis=1)

    sample = matrix(index.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow().column("x").combine_chunks())
    lists = int(min(MOST_LISTS, max(1, n // LIST), max(1, len(sample) // 8)))
    sent = spark.sparkContext.broadcast(Graph(centroids(lifted(sample), lists)))
    probes = int(min(lists, max(LEAST_PROBES, probe * lists)))

    def emit(batches: Iterator[pa.RecordBatch], move, width, most, least=1, after=0) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                if part.num_rows:
                    ids, d = sent.value.search(move(matrix(part.column(1))), width)
                    keep = d <= d[:, :1] * (1 + most) + 1e-12
                    keep[:, :least] = True
                    keep[:, :after] = False
                    r, c = np.nonzero(keep)
                    took = part.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r, c], pa.int64()), *took.columns], ["list", *took.schema.names])

    plain = lambda x: np.concatenate([lifted(x), np.zeros((len(x), 1))], axis=1)
    posted = written(index.select("id", "x").mapInArrow(lambda b: emit(b, plain, min(COPIES, lists), NEAR), "list long, id long, x array<double>"), "postings")
    sizes = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # a list meets about the share probes / lists of all queries, and can't meet more than all
    parts = int(max(1, -(-alone.count() * probes // (lists * ASKED))))
    to = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), m - 1))
    blocked = posted.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("id"), "blocks").cast("long").alias("block"), to(F.lit(parts).cast("long")).alias("part"), "id", "x")
    found_schema = "q struct<a: long, b: long>, vec_id long, score double"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], kind), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        least = right.column("least").to_numpy()
        r, ids, score = _local_best(matrix(right.column("x").combine_chunks()), matrix(left.column("x").combine_chunks()), left.column("id").to_numpy(), k + 1)
        good = ~(score < least[r])
        return pa.table({"q": right.column("q").combine_chunks().take(pa.array(r[good])), "vec_id": pa.array(ids[good], pa.int64()), "score": pa.array(score[good], pa.float64())})

    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")

    def search(who: DataFrame, width: int, after: int) -> DataFrame:
        """Each query's bests of each block, from its lists ``after`` to ``width``; who: q, x, least (score)."""
        lists_of = lambda b: emit(b, turned, width, ratio, min(LEAST_PROBES, width), after)
        asking = who.select("q", "x", "least").mapInArrow(lists_of, "list long, q struct<a: long, b: long>, x array<double>, least double").join(F.broadcast(sizes), "list")
        asking = asking.select("list", to(F.col("blocks")).alias("block"), F.pmod(F.xxhash64("q"), F.lit(parts)).cast("long").alias("part"), "q", "x", "least")
        key = ["list", "block", "part"]
        return blocked.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(meet, found_schema)

    def top(found: DataFrame) -> DataFrame:
        once = found.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)

    # the nearest lists give each query a score that anything from its other lists must reach
    lowest = F.lit(float("-inf"))
    early = min(FIRST, probes)
    found = written(top(search(alone.withColumn("least", lowest), early, 0)), "first-lists")
    if probes > early:
        bound = found.where(F.col("rank") == k + 1).select("q", F.col("score").alias("bound"))
        rest = alone.join(bound, "q", "left").select("q", "x", F.coalesce("bound", lowest).alias("least"))
        found = top(search(rest, probes, early).unionByName(found.drop("rank")))
    each = asked.select("q", F.col("id").alias("query_id")).join(found.drop("rank"), "q").where("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(vectors: DataFrame) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all other vectors."""
    rows = vectors.select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))


#: Exact neighbours; the index is exact too while it has no more than LEAST_PROBES lists.
OP10_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""
