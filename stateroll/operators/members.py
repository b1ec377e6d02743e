"""Exact sets beside sketches: a theta sketch counts exactly until it is full, and the keys whose sketches are full are counted by their members.

Members are a row a key and value, with a flag for each set that holds it: two aggregates, the first dealt by values, so that no
task gets a whole set. Where no sketch is full, the join with the full keys is empty, and the rows aren't read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stateroll.operators.states import LG_K


def members(df: DataFrame, keys: list[str], column: str, sets: dict[str, Column]) -> DataFrame:
    """A row a key and value (null is none), with which sets hold it; a set is a condition on rows."""
    held = {n: F.coalesce(c, F.lit(False)) for n, c in sets.items()}
    some = df.where(F.col(column).isNotNull() & reduce(lambda a, b: a | b, held.values()))
    return some.groupBy(*keys, column).agg(*[F.bool_or(c).alias(n) for n, c in held.items()])


def counted(rows: DataFrame, keys: list[str], figures: dict[str, Column]) -> DataFrame:
    """Of members(): how many values each condition on the sets holds for."""
    return rows.groupBy(*keys).agg(*[F.count_if(c).cast("double").alias(n) for n, c in figures.items()])


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys], F.lit(True))


def exact(sketched: DataFrame, df: DataFrame, keys: list[str], column: str, sets: dict[str, Column], figures: dict[str, tuple[Column, Column]], lg_k: int = LG_K) -> DataFrame:
    """sketched, a row a key with a theta sketch of each set by its name, with the figures: exact numbers of values.

    df: the rows that the sketches are of. figures: an estimate by the sketches, and the same as a condition on the sets. Sketches that hold
    fewer than 2**lg_k values hold all there are; with a full one among a key's, its members are counted.
    """
    names = {k: F.col(k).alias(f"_m_{k}") for k in keys}
    full = reduce(lambda a, b: a | b, [F.coalesce(F.theta_sketch_estimate(n) >= (1 << lg_k), F.lit(False)) for n in sets])
    marked = sketched.withColumn("_full", full)
    few = marked.where("_full").select(*(list(names.values()) or [F.lit(1).alias("_m")]))
    rows = df.join(F.broadcast(few), _same(keys), "left_semi")
    counts = counted(members(rows, keys, column, sets), keys, {f"_x_{n}": c for n, (_, c) in figures.items()})
    counts = counts.select(*names.values(), *[f"_x_{n}" for n in figures])
    got = marked.join(counts, _same(keys), "left")
    values = {n: F.when(F.col("_full"), F.coalesce(f"_x_{n}", F.lit(0.0))).otherwise(e) for n, (e, _) in figures.items()}
    return got.withColumns(values).select(*sketched.columns, *figures)
