"""Mergeable states: each builds by one aggregate over rows, merges by one aggregate over states, and is read by a Column.

All states of a key set go into one groupBy().agg(), so that rows are read and shuffled once. Sketches that Spark has
are its own aggregates: HyperLogLog, theta and KLL. Those it lacks (t-digest, frequent items with an error offset,
coupon counting) are made beside them, those of a kind in one pass, and joined by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stateroll.operators import ordering, sketches

LG_K, LG_K_CPC, KLL_K, TDIGEST_K, TOPK_MAP = 12, 11, 200, 500, 10
#: Kinds that are made beside the one aggregate.
BESIDE = ("tdigest", "topk", "cpc")


@dataclass(frozen=True)
class State:
    """kind: count, value_sum, min, max, pooled_mean, pooled_variance, hll, cpc, theta, kll, tdigest or topk.

    column: what it is of (none: rows); where: a condition on rows, a Column or SQL text; distinct: count different values, null as one;
    mean and weight: the companion states of pooled kinds; size: a sketch's size parameter.
    """

    name: str
    kind: str
    column: str | None = None
    where: Column | str | None = None
    distinct: bool = False
    mean: str | None = None
    weight: str | None = None
    size: int | None = None

    @property
    def parameter(self) -> int:
        """A sketch's size: its own, or the usual one of its kind."""
        usual = {"hll": LG_K, "cpc": LG_K_CPC, "theta": LG_K, "kll": KLL_K, "tdigest": TDIGEST_K, "topk": TOPK_MAP}[self.kind]
        return min(max(self.size or usual, 4), 21) if self.kind in ("hll", "cpc") else self.size or usual

    @property
    def condition(self) -> Column | None:
        return F.expr(self.where) if isinstance(self.where, str) else self.where

    @property
    def given(self) -> Column:
        """The column where the condition holds, null elsewhere."""
        c = F.col(self.column)
        return c if self.condition is None else F.when(self.condition, c)

    def build(self) -> Column:
        """The aggregate of rows; for kinds that have one."""
        c = F.col(self.column) if self.column else None
        where = self.condition
        given = None if c is None else self.given
        if self.kind == "count":
            if c is None:
                return F.count(F.lit(1)) if where is None else F.count_if(where)
            if self.distinct:
                null = c.isNull() if where is None else c.isNull() & where
                return F.count_distinct(given) + F.coalesce(F.max(null.cast("int")), F.lit(0))
            return F.count(given)
        if self.kind == "value_sum":
            return F.coalesce(F.sum(c.cast("double") if where is None else F.when(where, c.cast("double")).otherwise(0.0)), F.lit(0.0))
        if self.kind in ("min", "max"):
            return getattr(F, self.kind)(given)
        if self.kind == "pooled_mean":
            return F.avg(c.cast("double"))
        if self.kind == "pooled_variance":
            return F.var_samp(c.cast("double"))
        text = given.cast("string")
        if self.kind == "hll":
            return F.hll_sketch_agg(text, F.lit(self.parameter))
        if self.kind == "theta":
            return F.theta_sketch_agg(text, F.lit(self.parameter))
        if self.kind == "kll":
            return F.kll_sketch_agg_double(given.cast("double"), F.lit(self.parameter))
        raise ValueError(f"unknown kind of state {self.kind!r}")

    def merge(self) -> Column:
        c = F.col(self.name)
        if self.kind in ("count", "value_sum"):
            return F.sum(c)
        if self.kind in ("min", "max"):
            return getattr(F, self.kind)(c)
        if self.kind == "pooled_mean":
            w = F.col(self.weight)
            return F.try_divide(F.sum(c * w), F.sum(F.when(c.isNotNull(), w)))
        if self.kind == "pooled_variance":
            n, grand = F.col(self.weight), F.col(f"_grand_{self.name}")
            within = F.coalesce((n - 1) * c, F.lit(0.0)) + F.coalesce(n * (F.col(self.mean) - grand) * (F.col(self.mean) - grand), F.lit(0.0))
            total = F.sum(n)
            return F.when(total > 1, F.sum(within) / (total - 1))
        if self.kind == "hll":
            return F.hll_union_agg(c, F.lit(True))
        if self.kind == "theta":
            return F.theta_union_agg(c, F.lit(self.parameter))
        if self.kind == "kll":
            return F.kll_merge_agg_double(c)
        raise ValueError(f"{self.kind!r} has no aggregate of its own")


def _sides(states: list[State]) -> dict[tuple[str, int], list[State]]:
    """States that are made beside the aggregate, those of one kind and size together."""
    out: dict[tuple[str, int], list[State]] = {}
    for s in states:
        if s.kind in BESIDE:
            out.setdefault((s.kind, s.parameter), []).append(s)
    return out


def _joined(main: DataFrame, keys: list[str], sides: list[DataFrame], names: list[str]) -> DataFrame:
    """A row a key of main, with the states that it has in the sides: by one grouping of all of them, in which null keys are equal."""
    if not keys:
        for side in sides:
            main = main.crossJoin(F.broadcast(side))  # one row each
        return main.select(*names)
    every = main.withColumn("_main", F.lit(True))
    for side in sides:
        every = every.unionByName(side, allowMissingColumns=True)
    one = every.groupBy(*keys).agg(F.max("_main").alias("_main"), *[F.first(n, ignorenulls=True).alias(n) for n in names])
    return one.where("_main").drop("_main")


def build(df: DataFrame, keys: list[str], states: list[State]) -> DataFrame:
    plain = [s.build().alias(s.name) for s in states if s.kind not in BESIDE]
    sides = []
    for (kind, size), some in _sides(states).items():
        names, given = [s.name for s in some], [s.given for s in some]
        if kind == "tdigest":
            sides.append(sketches.build_digests(df, keys, names, given, size))
        elif kind == "topk":
            sides.append(sketches.build_tops(df, keys, names, given, 1 << size))
        else:
            sides.append(sketches.build_coupons(df, keys, names, given, size))
    if not sides:
        return df.groupBy(*keys).agg(*plain)
    main = df.groupBy(*keys).agg(*plain or [F.count(F.lit(1)).alias("_rows")])
    return _joined(main, keys, sides, [s.name for s in states])


def merge(df: DataFrame, keys: list[str], states: list[State]) -> DataFrame:
    """Roll states up to coarser keys; no keys: one row."""
    for s in states:
        if s.kind == "pooled_variance":
            n = F.when(F.col(s.mean).isNotNull(), F.col(s.weight))
            grand = F.try_divide(F.sum(F.col(s.mean) * n), F.sum(n)).alias(f"_grand_{s.name}")
            means = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(grand)
            same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
            df = df.join(means, same).drop(*[f"_k_{k}" for k in keys]) if keys else df.crossJoin(F.broadcast(means))
    sides = []
    for (kind, size), some in _sides(states).items():
        names = [s.name for s in some]
        if kind == "tdigest":
            sides.append(sketches.merge_digests(df, keys, names, size))
        elif kind == "topk":
            sides.append(sketches.merge_tops(df, keys, names, 1 << size))
        else:
            sides.append(sketches.merge_coupons(df, keys, names))
    plain = [s.merge().alias(s.name) for s in states if s.kind not in BESIDE]
    if not sides:
        return df.groupBy(*keys).agg(*plain)
    main = df.groupBy(*keys).agg(*plain or [F.count(F.lit(1)).alias("_rows")])
    return _joined(main, keys, sides, [s.name for s in states])


def neutral(df: DataFrame, states: list[State]) -> DataFrame:
    """States that a table lacks or holds as null: 0 for counts and sums, null else."""
    fill = {}
    for s in states:
        zero = F.lit(0).cast("bigint") if s.kind == "count" else F.lit(0.0) if s.kind == "value_sum" else F.lit(None)
        fill[s.name] = F.coalesce(F.col(s.name), zero) if s.name in df.columns else zero
    return df.withColumns(fill)


def estimate(c: Column | str, kind: str = "hll", lg_k: int = LG_K_CPC) -> Column:
    """Different values of a cardinality sketch; 0 for none. lg_k: of a cpc sketch."""
    c = F.col(c) if isinstance(c, str) else c
    if kind == "cpc":
        return sketches.coupon_estimate(c, lg_k)
    return F.coalesce((F.theta_sketch_estimate if kind == "theta" else F.hll_sketch_estimate)(c).cast("double"), F.lit(0.0))


def bounds(est: Column, lg_k: int = LG_K, kind: str = "hll") -> tuple[Column, Column]:
    """Two standard errors around an estimate."""
    err = 2 * (sketches.coupon_error(lg_k) if kind == "cpc" else 1.04 / 2 ** (lg_k / 2))
    return est * (1 - err), est * (1 + err)


def weight(c: Column | str, kind: str = "tdigest") -> Column:
    """Values that a quantile sketch (tdigest or kll) has seen."""
    c = F.col(c) if isinstance(c, str) else c
    if kind == "tdigest":
        return sketches.digest_weight(c)
    return F.coalesce(F.kll_sketch_get_n_double(c), F.lit(0)).cast("bigint")


def quantile(c: Column | str, q: float, kind: str = "tdigest") -> Column:
    """0.0 for an empty sketch."""
    c = F.col(c) if isinstance(c, str) else c
    if kind == "tdigest":
        return sketches.digest_quantile(c, q)
    return F.when(weight(c, kind) == 0, F.lit(0.0)).otherwise(F.kll_sketch_get_quantile_double(c, F.lit(float(q))))


def quantiles(c: Column | str, qs: list[float], kind: str = "tdigest") -> Column:
    """An array of quantiles."""
    c = F.col(c) if isinstance(c, str) else c
    if kind == "tdigest":
        return sketches.digest_quantiles(c, qs)
    return F.kll_sketch_get_quantile_double(c, F.array(*map(F.lit, qs)))


def cdf(c: Column | str, x: float, kind: str = "tdigest") -> Column:
    """The share of values up to x; 0.0 for an empty sketch."""
    c = F.col(c) if isinstance(c, str) else c
    if kind == "tdigest":
        return sketches.digest_rank(c, x)
    return F.when(weight(c, kind) == 0, F.lit(0.0)).otherwise(F.kll_sketch_get_rank_double(c, F.lit(float(x))))


def ranks(c: Column | str, xs: list[float], kind: str = "tdigest") -> Column:
    """An array of shares up to each x."""
    c = F.col(c) if isinstance(c, str) else c
    if kind == "tdigest":
        return sketches.digest_ranks(c, xs)
    return F.kll_sketch_get_rank_double(c, F.array(*map(F.lit, xs)))


def frequent(c: Column | str, k: int = 10, mode: str = "NO_FALSE_NEGATIVES", threshold: Column | int | None = None) -> Column:
    """array<struct<item, estimate, lower, upper>>: the k most frequent of those that the mode lets through."""
    c = F.col(c) if isinstance(c, str) else c
    return F.slice(F.coalesce(sketches.frequent_items(c, mode, threshold), F.array().cast("array<struct<item: string, estimate: bigint, lower: bigint, upper: bigint>>")), 1, k)


def exact_distinct(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(column).alias("distinct_values"))


def exact_quantiles(df: DataFrame, keys: list[str], column: str, qs: dict[str, float]) -> DataFrame:
    """Keys without values have no row."""
    got = ordering.quantiles(df, column, list(qs.values()), keys)
    return got.select(*keys, *[F.col("quantiles")[k].alias(n) for k, n in enumerate(qs)])


def exact_top(df: DataFrame, keys: list[str], column: str, k: int) -> DataFrame:
    """The k most frequent values of each key, ties by value."""
    n = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.col(column)]
    if not keys:  # k rows in all
        return n.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return n.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
