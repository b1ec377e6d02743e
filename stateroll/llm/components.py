"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step groups the edges by a node (with partial sums on the map side) and joins the node's least neighbour back, a
join that adaptive execution splits where one node has very many edges. Rounds are cut by written tables; nothing is
collected but two numbers a round, which tell whether the edges changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateroll.llm.common import drop_written, shared_dir, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of longs, a and b. A row (node, root) for every node of an edge; root is the component's least node."""
    spark = edges.sparkSession
    first, second = edges.columns
    now = edges.select(F.col(first).alias("a"), F.col(second).alias("b")).where("a <> b")
    path, before = None, None
    while True:
        new_path = shared_dir(spark)
        now = written(_small(_large(now)), new_path)
        if path:
            drop_written(spark, path)
        path = new_path
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
