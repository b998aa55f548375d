import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from arborist.plans.queries import QUERIES


def test_every_clustering_query_is_registered():
    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry(spark):
    assert entry.entry(spark).columns == ["row", "left", "right", "height", "size"]


def same_as_sql(spark, folder, name):
    """Whether the query's rows over embeddings equal its SQL's."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, folder).collect()]
    return len(got) == len(want) and sorted(got) == sorted(want)


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """A folder with so many embeddings that the target dimension by their number exceeds the SQL's."""
    folder = str(tmp_path_factory.mktemp("vectors"))
    x = np.random.default_rng(8).normal(size=(2500, 64)).astype(np.float32)
    x[1::5] = x[::5] + np.float32(0.02)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_balls_of_many_points_equal_the_sql(spark, vectors):
    assert same_as_sql(spark, vectors, "spanner_balls")


def test_cells_of_many_points_equal_the_sql(spark, vectors):
    assert same_as_sql(spark, vectors, "spanner_edges")
