"""Global row numbers, running totals and exact quantiles without a one-task window.

Rows are range-partitioned by the order and written once; partitions' counts and sums (one small row each) give the
offsets, and windows run within partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stateroll.sources.scratch import settled


def _parts(df: DataFrame, order: list[Column]) -> DataFrame:
    return settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _offsets(parts: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Of each partition, what lies before it. A row a partition: broadcast."""
    per = parts.groupBy("_part").agg(*[c.alias(n) for n, c in sums.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(per.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before{n}") for n in sums]))


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """A row number over all rows, from 1; order must settle ties."""
    parts = _parts(df, order)
    out = parts.join(_offsets(parts, {"_c": F.count(F.lit(1))}), "_part")
    return out.withColumn(name, F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_before_c")).drop("_part", "_before_c")


def running(df: DataFrame, order: list[Column], value: str, total: str = "running", number: str = "n") -> DataFrame:
    """The sum of value so far, and the row number, over all rows."""
    parts = _parts(df, order)
    out = parts.join(_offsets(parts, {"_c": F.count(F.lit(1)), "_s": F.sum(value)}), "_part")
    w = W.partitionBy("_part").orderBy(*order)
    out = out.withColumn(number, F.row_number().over(w) + F.col("_before_c"))
    return out.withColumn(total, F.sum(value).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("_before_s")).drop("_part", "_before_c", "_before_s")


def quantiles(df: DataFrame, column: str, qs: list[float], keys: list[str] | None = None) -> DataFrame:
    """Exact quantiles, between two values in proportion, as one array (`quantiles`) a key; nulls don't count.

    Without keys one row, of nulls if there are no values; keys without values have no row. Equal values meet first;
    then all values are in one order by key and value, so that no task holds a key whole.
    """
    keys = keys or []
    given = df.where(F.col(column).isNotNull())
    values = given.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    own = [f"_k{n}" for n in range(len(keys))]
    parts = _parts(values, [*[F.col(k) for k in own], F.col("v")]).withColumn("_key", F.struct(F.lit(0), *own))
    # of each key in each partition, what lies before it: a row a key, and one more for each partition that it goes on in
    per = parts.groupBy("_key", "_part").agg(F.sum("c").alias("_s"))
    by_key = W.partitionBy("_key")
    per = per.select("_key", "_part", F.coalesce(F.sum("_s").over(by_key.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_s").over(by_key).alias("total"))
    so_far = F.sum("c").over(W.partitionBy("_key", "_part").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = parts.join(per, ["_key", "_part"]).withColumn("upto", so_far + F.col("_before"))
    at = [((F.col("total") - 1) * q) for q in qs]
    inside = lambda place: (F.col("upto") - F.col("c") <= place) & (place < F.col("upto"))
    ends = [F.max(F.when(inside(f(p)), F.col("v"))).alias(f"_{s}{k}") for k, p in enumerate(at) for s, f in (("a", F.floor), ("b", F.ceil))]
    got = rows.groupBy(*own).agg(*ends, F.max("total").alias("total"))
    between = F.array(*[F.col(f"_a{k}") + (F.col(f"_b{k}") - F.col(f"_a{k}")) * (p - F.floor(p)) for k, p in enumerate(at)])
    return got.select(*[F.col(f"_k{n}").alias(k) for n, k in enumerate(keys)], between.alias("quantiles"))
