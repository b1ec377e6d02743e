"""States beside Spark's own aggregates: accuracy, merging, bounds, and keys without values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateroll.operators import sketches
from stateroll.operators import states as S
from stateroll.operators.states import State


def values(n=300_000, seed=3):
    return np.random.default_rng(seed).lognormal(3, 1.5, n)


@pytest.fixture(scope="module")
def numbers(spark):
    import pandas as pd

    v = values()
    return spark.createDataFrame(pd.DataFrame({"v": v, "part": np.arange(len(v)) % 40})).repartition(8).cache(), np.sort(v)


def rank(ordered, x):
    return np.searchsorted(ordered, x) / len(ordered)


@pytest.mark.parametrize("merged", [False, True])
def test_digest_is_accurate_at_the_ends(numbers, merged):
    df, ordered = numbers
    s = [State("q", "tdigest", "v")]
    built = S.merge(S.build(df, ["part"], s), [], s) if merged else S.build(df, [], s)
    at = [0.0001, 0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999, 0.9999]
    got = built.select(S.weight("q").alias("n"), S.quantile("q", 0.0).alias("low"), S.quantile("q", 1.0).alias("high"), F.array(*[S.quantile("q", x) for x in at]).alias("one"), S.quantiles("q", at).alias("all"), F.size("q.centroids").alias("size")).first()
    assert (got.n, got.low, got.high) == (len(ordered), ordered[0], ordered[-1])
    assert np.allclose(got.one, got.all) and got.size <= 1001
    for q, x in zip(at, got.one, strict=True):
        assert abs(rank(ordered, x) - q) <= (0.003 if 0.01 < q < 0.99 else 0.0005 if 0.001 < q < 0.999 else 0.0001)
    xs = [float(ordered[int(q * len(ordered))]) for q in at]
    ranks = built.select(F.array(*[S.cdf("q", x) for x in xs]).alias("one"), S.ranks("q", xs).alias("all")).first()
    assert np.allclose(ranks.one, ranks.all) and np.allclose(ranks.one, at, atol=0.003)


def test_digest_of_few_and_equal_values(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", None), ("b", float("nan")), (None, 5.0), (None, 5.0), ("c", 0.0)] + [("c", 7.0)] * 60_000 + [("c", 9.0)] * 39_999
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    s = [State("n", "count", "v"), State("q", "tdigest", "v")]
    built = S.build(df, ["k"], s)
    for frame in (built, S.merge(built, ["k"], s)):
        got = {r.k: r for r in frame.select("k", "n", S.weight("q").alias("w"), S.quantile("q", 0.5).alias("m"), S.cdf("q", 5.0).alias("five"), S.cdf("q", 7.0).alias("seven"), S.cdf("q", 8.0).alias("eight")).collect()}
        assert (got["a"].w, got["a"].m) == (3, 2.0) and (got["b"].w, got["b"].m, got["b"].five) == (0, 0.0, 0.0)
        assert (got[None].w, got[None].m, got[None].five) == (2, 5.0, 1.0)
        assert (got["c"].w, got["c"].m) == (100_000, 7.0) and abs(got["c"].seven - 0.60001) < 0.002 and 0.59 < got["c"].eight < 0.62
    assert S.build(df.limit(0), ["k"], s).count() == 0
    none = S.build(df.limit(0), [], s).select("n", S.weight("q").alias("w"), S.quantile("q", 0.5).alias("m")).first()
    assert tuple(none) == (0, 0, 0.0)


def test_tasks_send_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(sketches, "HELD_VALUES", 500)
    monkeypatch.setattr(sketches, "HELD_KEYS", 3)
    df = spark.range(40_000).select((F.col("id") % 20).alias("k"), F.hash("id").cast("double").alias("v"))
    got = S.build(df, ["k"], [State("q", "tdigest", "v")]).select("k", S.weight("q").alias("n"), S.quantile("q", 0.5).alias("m"))
    exact = df.groupBy("k").agg(F.count("v").alias("n"), F.expr("percentile(v, array(0.48, 0.52))").alias("m"))
    for r, e in zip(got.orderBy("k").collect(), exact.orderBy("k").collect(), strict=True):
        assert (r.k, r.n) == (e.k, e.n) and e.m[0] < r.m < e.m[1]


def skewed(spark):
    """Item k occurs some 40 000 / k times, of 5 000 items; over 64 counters."""
    k = F.floor(F.exp(F.rand(5) * F.log(F.lit(5000.0)))).cast("int")
    return spark.range(200_000).select(k.alias("item"), (F.col("id") % 30).alias("part")).repartition(6).cache()


@pytest.mark.parametrize("merged", [False, True])
def test_frequent_items_within_bounds(spark, merged):
    df = skewed(spark)
    s = [State("top", "topk", "item", size=6)]
    built = S.merge(S.build(df, ["part"], s), [], s) if merged else S.build(df, [], s)
    exact = {str(r["item"]): r["count"] for r in df.groupBy("item").count().collect()}
    total = sum(exact.values())
    state = built.first().top
    assert len(exact) > 1024 and state.total == total and len(state["items"]) <= 64 and 0 < state.offset <= total / 64
    for threshold in (None, total // 50, total // 20):
        sure = built.select(F.explode(S.frequent("top", 64, "NO_FALSE_POSITIVES", threshold)).alias("i")).select("i.*").collect()
        maybe = built.select(F.explode(S.frequent("top", 64, "NO_FALSE_NEGATIVES", threshold)).alias("i")).select("i.*").collect()
        for r in [*sure, *maybe]:
            assert r.lower <= exact[r.item] <= r.upper == r.estimate
        limit = max(threshold or 0, state.offset)
        above = {i for i, n in exact.items() if n > limit}
        assert {r.item for r in sure} <= above <= {r.item for r in maybe}
        assert [r.estimate for r in maybe] == sorted((r.estimate for r in maybe), reverse=True)
    df.unpersist()


def test_frequent_items_that_all_find_room(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), (None, "z"), ("b", None)], "k string, v string")
    s = [State("top", "topk", "v")]
    built = S.build(df, ["k"], s)
    for frame in (built, S.merge(built, ["k"], s)):
        got = {r.k: [tuple(i) for i in r.i] for r in frame.select("k", S.frequent("top").alias("i")).collect()}
        assert got == {"a": [("x", 2, 2, 2), ("y", 1, 1, 1)], None: [("z", 1, 1, 1)], "b": []}


def test_coupons_of_a_million(spark):
    df = spark.range(1_000_000).select("id", (F.col("id") % 25).alias("part"))
    s = [State("u", "cpc", "id")]
    one = S.build(df, [], s)
    merged = S.merge(S.build(df.union(df), ["part"], s), [], s)
    est = [f.select(S.estimate("u", "cpc").alias("e")).first().e for f in (one, merged)]
    assert est[0] == est[1] and one.first() == merged.first()
    assert abs(est[0] / 1e6 - 1) < 2 * sketches.coupon_error(S.LG_K_CPC) and sketches.coupon_error(S.LG_K_CPC) < 1.04 / 2 ** (S.LG_K_CPC / 2)


def test_coupons_mean_error_is_below_the_usual_one(spark):
    """Twenty disjoint sets of 20 000: the root of the mean square error is near the stated one, and below HyperLogLog's."""
    df = spark.range(400_000).select("id", (F.col("id") % 20).alias("k"))
    got = S.build(df, ["k"], [State("u", "cpc", "id")]).select(S.estimate("u", "cpc").alias("e")).collect()
    rms = np.sqrt(np.mean([(r.e / 20_000 - 1) ** 2 for r in got]))
    assert len(got) == 20 and rms < 1.4 * sketches.coupon_error(S.LG_K_CPC)


def test_coupons_of_few(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None), (None, 3)], "k string, v int")
    got = {r.k: r.e for r in S.build(df, ["k"], [State("u", "cpc", "v")]).select("k", S.estimate("u", "cpc").alias("e")).collect()}
    assert abs(got["a"] - 2) < 0.01 and abs(got[None] - 1) < 0.01 and got["b"] == 0
