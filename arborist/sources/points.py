"""The point table: id BIGINT, x ARRAY<DOUBLE>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborist.session import stored


def points(df: DataFrame, id: str, vector: str | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Points from a vector column or from numeric columns. Null, NaN or ragged coordinates are refused."""
    x = F.col(vector).cast("array<double>") if vector else F.array(*(F.col(c).cast("double") for c in columns))
    out = df.select(F.col(id).cast("bigint").alias("id"), x.alias("x"))
    wrong = F.exists("x", lambda v: v.isNull() | F.isnan(v))
    bad, sizes, ids, n = out.agg(
        F.sum(F.when(F.col("x").isNull() | F.col("id").isNull() | wrong, 1).otherwise(0)), F.count_distinct(F.size("x")), F.count_distinct("id"), F.count("*")
    ).first()
    if bad or sizes > 1 or ids != n:
        raise ValueError("points need unique ids and coordinates without null or NaN, all of one length")
    return out


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with id 0..n-1 by ``order``. Ranges are sorted apart, and a running total of their sizes numbers them."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    # written, as ranges come from a sample that a second run may draw otherwise
    ranged = stored(ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)).cast("bigint")), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    # one short row for each partition, whatever the number of points
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ranged.join(F.broadcast(before.drop("__n")), "__part")
    return out.select((F.col("__before") + F.col("__in") - 1).cast("bigint").alias("id"), *df.columns)


def read_csv(spark: SparkSession, path: str, dimensions: int, sep: str = ",") -> DataFrame:
    """Points of a CSV without header; ids follow the order of lines."""
    names = [f"c{i}" for i in range(dimensions)]
    rows = spark.read.csv(path, schema=", ".join(f"{n} double" for n in names), sep=sep)
    return points(numbered(rows.withColumn("__line", F.monotonically_increasing_id()), "__line"), "id", columns=names)


def from_rows(spark: SparkSession, rows: Sequence[Sequence[float]]) -> DataFrame:
    """Points of a small in-memory matrix, ids by row."""
    data = [(i, [float(v) for v in r]) for i, r in enumerate(rows)]
    return points(spark.createDataFrame(data, "id bigint, x array<double>"), "id", "x")
