import numpy as np
import pytest
from pyspark.sql import functions as F

from arborist.functions.draws import draw, ladder, target_dimension
from arborist.operators import cut, distortion, tree
from arborist.operators.knn import knn, pairwise
from arborist.operators.linkage import cut_weight, single_linkage_label
from arborist.operators.lsh import _hash, assigned, bucket_keys, lsh_edges, spanner
from arborist.operators.mst import boruvka, mst, weighted
from arborist.plans.cluster_tree import cluster_tree, from_edges, knn_tree
from arborist.plans.sweep import baseline, sweep
from arborist.sources.points import from_rows, numbered, points, read_csv

#: Inputs and results known beforehand.
SQUARES = [[i * i] for i in range(6)]
LINE = [[-150], [-110], [-50], [0], [1], [70]]
LINE_TREE = [(0, 3, 4, 5.0, 2), (1, 0, 1, 200.0, 2), (2, 2, 6, 250.0, 3), (3, 8, 5, 400.0, 4), (4, 7, 9, 750.0, 6)]
LINKAGE = "row int, left bigint, right bigint, height double, size bigint"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def path(spark, n):
    return spark.createDataFrame([(i, i, i + 1) for i in range(n - 1)], "j int, u bigint, v bigint")


@pytest.fixture(scope="module")
def line_tree(spark):
    return spark.createDataFrame(LINE_TREE, LINKAGE)


def test_squares(spark):
    p = from_rows(spark, SQUARES)
    cw = cut_weight(p, path(spark, 6))
    assert [r["cw"] for r in cw.orderBy("j").collect()] == [5, 20, 45, 80, 125]
    assert rows(single_linkage_label(cw), "row") == [(0, 0, 1, 5.0, 2), (1, 6, 2, 20.0, 3), (2, 7, 3, 45.0, 4), (3, 8, 4, 80.0, 5), (4, 9, 5, 125.0, 6)]


def test_unsorted_tree_keeps_row_order(spark):
    cw = cut_weight(from_rows(spark, LINE), path(spark, 6))
    assert [r["cw"] for r in cw.orderBy("j").collect()] == [200, 750, 250, 5, 400]
    assert rows(single_linkage_label(cw), "row") == LINE_TREE


def test_mst_golden_and_boruvka(spark):
    p = from_rows(spark, [[3.4, 4.5], [2.3, 7.2], [2.2, 2.3], [3.8, 9.9], [4.8, 6.7]])
    e = spark.createDataFrame([(0, 1), (0, 3), (0, 4), (1, 2), (1, 4), (2, 3), (3, 4)], "u bigint, v bigint")
    assert [(r["u"], r["v"]) for r in mst(p, e).orderBy("j").collect()] == [(1, 4), (0, 4), (3, 4), (1, 2)]
    assert rows(boruvka(weighted(p, e)), "w") == [(r["u"], r["v"], r["w"]) for r in mst(p, e).orderBy("w").collect()]
    with pytest.raises(ValueError):
        mst(p, e.where("u > 0"))


def test_tree_operators(spark, line_tree):
    assert [(r["node"], r["depth"]) for r in tree.infix(line_tree).orderBy("pos").collect()] == [(0, 2), (7, 1), (1, 2), (10, 0), (2, 3), (8, 2), (3, 4), (6, 3), (4, 4), (9, 1), (5, 2)]
    pairs = spark.createDataFrame([(7, 3), (2, 5), (1, 1), (2, 2)], "a bigint, b bigint")
    assert {(r["a"], r["b"]): r["lca"] for r in tree.lca(line_tree, pairs).collect()} == {(7, 3): 10, (2, 5): 9, (1, 1): 1, (2, 2): 2}
    assert {(r["a"], r["b"]): r["dist"] for r in tree.cophenetic(line_tree, pairs).collect()}[2, 5] == 400
    assert [r["leaf"] for r in tree.leaves(line_tree, 9).orderBy("ord").collect()] == [2, 3, 4, 5]
    assert tree.well_formed(line_tree)
    assert not tree.well_formed(spark.createDataFrame([(0, 0, 0, 1.0, 2)], LINKAGE))


def test_cuts(spark, line_tree):
    assert [cut.frontier(line_tree, k) for k in range(1, 8)] == [[10], [7, 9], [7, 8, 5], [7, 5, 2, 6], [5, 2, 6, 0, 1], [5, 2, 0, 1, 3, 4], [5, 2, 0, 1, 3, 4]]
    assert rows(cut.clusters(line_tree, 3), "id") == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 2)]
    assert rows(cut.clusters_at(line_tree, 250.0), "id") == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 2), (5, 5)]


def test_cuts_with_ties_and_deep_trees(spark):
    """Against splitting the first of the highest nodes of a list, on random trees with few heights."""
    rng = np.random.default_rng(2)
    for n in (2, 9, 12):
        for _ in range(2):
            top, rows_ = list(range(n)), []
            for i, h in enumerate(sorted(rng.integers(1, 4, n - 1))):
                a, b = (top.pop(int(rng.integers(len(top)))) for _ in range(2))
                rows_.append((i, a, b, float(h), 2))
                top.append(n + i)
            t = spark.createDataFrame(rows_, LINKAGE)
            for k in (2, 5, n + 3):
                want, splits = [2 * n - 2], 0
                while splits < k - 1 and any(x >= n for x in want):
                    at = min(range(len(want)), key=lambda j: (-(rows_[want[j] - n][3] if want[j] >= n else -1), j))
                    _, left, right, _, _ = rows_[want[at] - n]
                    want = want[:at] + want[at + 1 :] + [left, right]
                    splits += 1
                assert cut.frontier(t, k) == want


@pytest.mark.parametrize("block", [7, 10_000])
def test_neighbours_equal_brute_force(spark, block):
    x = np.random.default_rng(4).normal(size=(40, 3)).round(1)
    x[5] = x[6] = x[7]
    out = {}
    for r in knn(from_rows(spark, x), 6, block).collect():
        out.setdefault(r["u"], {})[r["rank"]] = (r["v"], r["w"])
    # summed from left to right, as ties are decided by the last bit
    length = lambda d: float(np.sqrt((d[0] * d[0] + d[1] * d[1]) + d[2] * d[2]))
    for u in range(40):
        near = sorted((length(x[u] - x[v]), v) for v in range(40) if v != u)[:6]
        assert [out[u][i][0] for i in range(1, 7)] == [v for _, v in near]
        assert [out[u][i][1] for i in range(1, 7)] == pytest.approx([w for w, _ in near])


@pytest.mark.parametrize("block", [7, 4_000])
def test_pairs_meet_in_blocks(spark, block):
    """Every pair once, with the last bit of a sum from left to right; no join makes pairs."""
    x = np.random.default_rng(7).normal(size=(60, 3)) * [1, 1e3, 1e-3]
    x[5] = x[6]
    out = pairwise(from_rows(spark, x).withColumn("id", F.col("id") * 3 - 50), block)
    assert "Join" not in (plan := out._jdf.queryExecution().toString()) and "CartesianProduct" not in plan
    got = [tuple(r) for r in out.collect()]
    length = lambda d: float(np.sqrt((d[0] * d[0] + d[1] * d[1]) + d[2] * d[2]))
    assert sorted(got) == [(i * 3 - 50, j * 3 - 50, length(x[i] - x[j])) for i in range(60) for j in range(i + 1, 60)]
    assert pairwise(from_rows(spark, x[:1]), block).count() == pairwise(from_rows(spark, x).limit(0), block).count() == 0


def test_pairs_send_few_copies(spark):
    """A point goes to as many tasks as there are blocks, in the bytes that hold it; ids far apart and coordinates of either width stay exact."""
    x = np.random.default_rng(8).normal(size=(3000, 64)).astype(np.float32).astype(float)
    x[7, 3] = 0.1
    ids = np.random.default_rng(9).permutation(np.concatenate([np.arange(1500) - 2**62, np.arange(1500) * 2**50]))
    p = points(spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "id bigint, x array<double>"), "id", "x")

    def sent():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(10_000)
        return sum(e.totalShuffleWrite() for e in (found.apply(k) for found in [sc.statusStore().executorList(False)] for k in range(found.size())))

    before = sent()
    out = pairwise(p).where(F.col("i").isin(ids[:8].tolist()) | F.col("j").isin(ids[:8].tolist()))
    got = {(r["i"], r["j"]): r["l2"] for r in out.collect()}
    assert sent() - before < 12 * 4 * x.size
    where = {int(v): k for k, v in enumerate(ids)}
    assert len(got) == 8 * 2999 - 28 and all(i < j for i, j in got)
    for (i, j), l2 in got.items():
        total = 0.0
        for d in x[where[i]] - x[where[j]]:
            total += d * d
        assert l2 == np.sqrt(total)
    assert pairwise(points(spark.range(3).select("id", F.array().cast("array<double>").alias("x")), "id", "x")).agg(F.sum("l2"), F.count("*")).first() == (0.0, 3)


def test_sweep(spark):
    p = from_rows(spark, np.random.default_rng(6).normal(size=(20, 2)))
    rows_ = [*sweep(p, 0.1, 10, ("lipschitz",), (2.0,), nsample=100), *baseline(p, (3,), 100)]
    assert [(r[0], r[1]) for r in rows_] == [("lipschitz", 2.0), ("neighbours", 3)] and all(r[3] >= 1 and r[4] >= 1 for r in rows_)


def test_distortion(spark):
    x = [[0.0, 0.0], [0.0, 1.0], [3.0, 1.0], [3.0, 1.0]]
    p = from_rows(spark, x)
    e = spark.createDataFrame([(i, j) for i in range(4) for j in range(i + 1, 4)], "u bigint, v bigint")
    t = from_edges(p, e)
    leaf = {(r["a"], r["b"]): r["dist"] for r in tree.cophenetic(t, e.toDF("a", "b")).collect()}
    ratio = [leaf[i, j] / np.linalg.norm(np.subtract(x[i], x[j])) for i, j in leaf if x[i] != x[j]]
    got = distortion.distortion(p, t).first()
    assert got[0] == pytest.approx(max(ratio) / min(ratio)) and got[1] == 1
    assert distortion.sampled_distortion(p, t, 500).first()[0] == pytest.approx(max(1, *ratio) / min(ratio))
    assert distortion.average_distortion(p, t, 500).first()[0] >= 1


@pytest.mark.parametrize("family", ["balls", "lipschitz", "experimental"])
def test_families_agree_between_paths(spark, family):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5))
    p = from_rows(spark, x)
    d = draw(family, 2, 0.9, 5, 3, seed=4)
    declared = {r["id"]: (r["u"], tuple(r["cells"])) for r in assigned(p, d, family).collect()}
    at, keys = bucket_keys(x, d, family)
    fast = dict(zip(at.tolist(), keys.tolist()))
    assert declared.keys() == fast.keys()
    together = lambda m: {(a, b) for a in m for b in m if m[a] == m[b]}
    assert together(declared) == together(fast)
    edges = rows(lsh_edges(p, 0.9, 3, family), "u", "v")
    assert all(u < v for u, v in edges)


def test_keys_of_near_cells_differ():
    """All small cells under all grids: no two share a key."""
    cells = np.array([(a, b, c) for a in range(-6, 7) for b in range(-6, 7) for c in range(-6, 7)], float)
    keys = np.concatenate([_hash(np.full(len(cells), u), cells) for u in range(96)])
    assert len(np.unique(keys)) == len(keys)


def test_spanner_and_tree_properties(spark):
    x = np.random.default_rng(5).normal(size=(30, 3))
    p = from_rows(spark, x)
    edges = set(rows(spanner(p, 1.5, 0.2, 20, seed=9)))
    assert {(0, i) for i in range(1, 30)} <= edges and all(u < v for u, v in edges)
    assert edges == set(rows(spanner(p.repartition(5), 1.5, 0.2, 20, seed=9)))
    t = cluster_tree(p, 0.2, 20, 1.5, "lipschitz", 9).cache()
    assert tree.well_formed(t)
    h = [r["height"] for r in t.orderBy("row").collect()]
    assert h == sorted(h)
    pairs = spark.createDataFrame([(i, j) for i in range(30) for j in range(i)], "a bigint, b bigint")
    assert all(r["dist"] >= np.linalg.norm(x[r["a"]] - x[r["b"]]) for r in tree.cophenetic(t, pairs).collect())
    assert tree.well_formed(knn_tree(p, 4))


def test_edges_of_the_domain(spark):
    one = from_rows(spark, [[1.0]])
    assert cluster_tree(one).count() == 0
    two = from_rows(spark, [[1.0], [1.0]])
    assert rows(cluster_tree(two, 0.5, 2)) == [(0, 0, 1, 0.0, 2)]
    assert rows(spanner(two, 2, 5, 1)) == [(0, 1)]
    for bad in ({"scale_factor": 1}, {"d_min": 0}, {"lsh": "other"}):
        with pytest.raises(ValueError):
            spanner(two, **bad)
    with pytest.raises(ValueError):
        points(spark.createDataFrame([(0, [float("nan")])], "id bigint, x array<double>"), "id", "x")
    with pytest.raises(ValueError):
        points(spark.createDataFrame([(0, [1.0]), (0, [2.0])], "id bigint, x array<double>"), "id", "x")


def test_deep_tree(spark):
    n = 150
    t = spark.createDataFrame([(0, 0, 1, 1.0, 2), *((i, n + i - 1, i + 1, i + 1.0, i + 2) for i in range(1, n - 1))], LINKAGE)
    pairs = spark.createDataFrame([(0, n - 1), (3, 100), (n, 2)], "a bigint, b bigint")
    assert {(r["a"], r["b"]): r["lca"] for r in tree.lca(t, pairs).collect()} == {(0, n - 1): 2 * n - 2, (3, 100): n + 99, (n, 2): n + 1}
    assert {r["label"] for r in cut.clusters(t, 2).collect()} == {0, 1}


def test_sources_and_ladder(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("1.5,2\n3,4\n0,0\n")
    assert rows(read_csv(spark, str(f), 2), "id") == [(0, [1.5, 2.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0])]
    assert [r["id"] for r in numbered(spark.range(20).toDF("k").repartition(4), "k").orderBy("k").collect()] == list(range(20))
    assert len(ladder(0.01, 1000, 1.1)) == 121 and len(ladder(0.1, 1000, 2)) == 14
    assert (target_dimension(150, 4, "balls"), target_dimension(150, 4, "lipschitz"), target_dimension(10992, 16, "lipschitz")) == (3, 4, 13)
