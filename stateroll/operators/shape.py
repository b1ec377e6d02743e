"""Report shaping: what a chart needs from a metric's rows. Small results in, small results out, all lazy."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stateroll.operators import states as S
from stateroll.operators.ordering import numbered, running
from stateroll.sources.scratch import settled


def indexed(df: DataFrame, series: list[str], x: str, y: str, mode: str = "index") -> DataFrame:
    """Against the first value of each series: index (100 there) or change in percent; null where that value is 0."""
    if series:
        base = F.first(y, ignorenulls=True).over(W.partitionBy(*series).orderBy(x).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    else:  # one row
        df = df.crossJoin(F.broadcast(df.agg(F.min_by(y, F.when(F.col(y).isNotNull(), F.col(x))).alias("_base"))))
        base = F.col("_base")
    value = F.when(base != 0, F.col(y) / base * 100 if mode == "index" else (F.col(y) / base - 1) * 100)
    return df.withColumn(f"{y}_{mode}", value).drop("_base")


def pareto(df: DataFrame, label: str, value: str) -> DataFrame:
    total = F.broadcast(df.agg(F.sum(value).alias("_total")))
    rows = running(df, [F.desc(value), F.col(label)], value, "_so_far", "_n").crossJoin(total)
    return rows.withColumn("cumulative_share", F.when(F.col("_total") != 0, F.col("_so_far") / F.col("_total")).otherwise(0.0)).drop("_total", "_so_far", "_n")


def heatmap(df: DataFrame, y: str, x: str, value: str, columns: list) -> DataFrame:
    return df.groupBy(y).pivot(x, columns).agg(F.avg(value))


def heat_strip(df: DataFrame, x: str, value: str) -> DataFrame:
    return df.groupBy(x).agg(F.avg(value).alias(value))


def calendar_matrix(df: DataFrame, day: str, value: str) -> DataFrame:
    """A row a week (its Monday), a column a weekday, 1 (Monday) to 7."""
    rows = df.select(F.to_date(F.date_trunc("week", F.col(day))).alias("week_start"), (F.weekday(day) + 1).alias("weekday"), F.col(value).alias("v"))
    got = rows.groupBy("week_start").pivot("weekday", list(range(1, 8))).agg(F.sum("v"))
    return got.select("week_start", *[F.col(str(k)).alias(f"d{k}") for k in range(1, 8)])


def sankey(df: DataFrame, path: list[str], value: str) -> DataFrame:
    """Links between neighbours of the path with their summed value."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(missing)"))
    links = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), name(a).alias("source"), name(b).alias("target")) for k, (a, b) in enumerate(zip(path[:-1], path[1:], strict=True))]))
    return df.select(links.alias("l"), F.col(value).alias("v")).groupBy("l.step", "l.source", "l.target").agg(F.sum("v").alias("value"))


def funnel_long(df: DataFrame, stages: list[str], keys: list[str] | None = None) -> DataFrame:
    """Stage states as rows (stage_order, stage, Count)."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("stage_order"), F.lit(s).alias("stage"), F.col(s).cast("double").alias("Count")) for k, s in enumerate(stages)]))
    return df.select(*(keys or []), rows.alias("s")).select(*(keys or []), "s.*")


def funnel_categories(df: DataFrame, column: str, value: str, stages: list[str]) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, stages)), F.col(column))
    return df.where(place > 0).select((place - 1).cast("int").alias("stage_order"), F.col(column).alias("stage"), F.col(value).alias("Count"))


def exposure_curve(df: DataFrame, value: str, ties: list[str]) -> DataFrame:
    """Largest first: the share of rows and of value so far."""
    total = F.broadcast(df.agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_c")))
    rows = running(df, [F.desc(value), *[F.col(t) for t in ties]], value, "_so_far", "_n").crossJoin(total)
    shares = {"customer_share": F.col("_n") / F.col("_c"), "value_share": F.when(F.col("_v") != 0, F.col("_so_far") / F.col("_v")).otherwise(0.0)}
    return rows.withColumns(shares).drop("_v", "_c", "_n", "_so_far")


def box_stats(q1: Column, median: Column, q3: Column, low: Column, high: Column, n: Column) -> dict[str, Column]:
    iqr = q3 - q1
    half = F.when(n > 0, 1.57 * iqr / F.sqrt(n)).otherwise(0.0)
    return {"lower_fence": F.greatest(low, q1 - 1.5 * iqr), "upper_fence": F.least(high, q3 + 1.5 * iqr), "notch_low": median - half, "notch_high": median + half}


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 100) -> DataFrame:
    """Even bins over each key's range; the last holds its upper end. A range of one value is padded by half a unit."""
    span = df.groupBy(*keys).agg(F.min(value).cast("double").alias("_a"), F.max(value).cast("double").alias("_b"))
    span = span.withColumn("_low", F.when(F.col("_a") == F.col("_b"), F.col("_a") - 0.5).otherwise(F.col("_a"))).withColumn("_high", F.when(F.col("_a") == F.col("_b"), F.col("_b") + 0.5).otherwise(F.col("_b")))
    rows = df.where(F.col(value).isNotNull()).join(span, keys) if keys else df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span))
    number = F.least(F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1)).cast("int")
    width = (F.col("_high") - F.col("_low")) / bins
    return rows.select(*keys, number.alias("bin"), F.col("_low"), width.alias("_w")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), (F.first("_low") + F.col("bin") * F.first("_w")).alias("left_edge"))


def digest_histogram(df: DataFrame, state: str, bins: int = 100, output: str = "histogram") -> DataFrame:
    """From a quantile sketch: the share of evenly spread quantiles that falls into each even bin of its range."""
    df = df.withColumn("_v", S.quantiles(state, [k / 1000 for k in range(1001)]))
    low, high = F.col("_v")[0], F.col("_v")[1000]
    df = df.withColumns({"_low": F.when(low == high, low - 0.5).otherwise(low), "_width": F.when(low == high, F.lit(1.0)).otherwise(high - low) / bins})
    df = df.withColumn("_at", F.transform("_v", lambda x: F.least(F.floor((x - F.col("_low")) / F.col("_width")), F.lit(bins - 1))))
    mass = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.struct((F.col("_low") + k * F.col("_width")).alias("left_edge"), (F.size(F.filter("_at", lambda x: x == k)) / 1001).alias("mass")))
    return df.withColumn(output, mass).drop("_v", "_low", "_width", "_at")


def curve_rows(df: DataFrame, keys: list[str], curve: str = "curve", kind: str = "roc") -> DataFrame:
    x, y = ("fpr", "tpr") if kind == "roc" else ("recall", "precision")
    z = F.arrays_zip(F.col(f"{curve}.{x}").alias(x), F.col(f"{curve}.{y}").alias(y))
    return df.select(*keys, F.posexplode(z).alias("point", "p")).select(*keys, "point", F.col(f"p.{x}").alias("x"), F.col(f"p.{y}").alias("y"))


def gain_rows(df: DataFrame, keys: list[str], curve: str = "curve") -> DataFrame:
    """Share contacted, gain, and lift over chance."""
    z = F.arrays_zip(F.col(f"{curve}.fpr").alias("fpr"), F.col(f"{curve}.tpr").alias("tpr"))
    p = F.col(f"{curve}.pos_fraction")
    rows = df.select(*keys, p.alias("p"), F.posexplode(z).alias("point", "z"))
    x = F.col("p") * F.col("z.tpr") + (1 - F.col("p")) * F.col("z.fpr")
    return rows.select(*keys, "point", x.alias("x"), F.col("z.tpr").alias("gain"), F.when(x <= 1e-6, 0.0).otherwise(F.try_divide(F.col("z.tpr"), x)).alias("lift"))


def calibration_rows(df: DataFrame, keys: list[str], column: str = "calibration") -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("bin", "b")).select(*keys, "bin", "b.*")


def topk_rows(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A row an item with its rank; a key without items keeps one blank row."""
    return df.select(*keys, F.posexplode_outer(column).alias("p", "i")).select(*keys, (F.col("p") + 1).alias("rank"), "i.*")


def projected_purchases(frequency: Column, tenure: Column, horizon: int = 30) -> Column:
    return frequency / F.greatest(tenure, F.lit(1)) * horizon


def odds_verdict(low: Column, high: Column) -> Column:
    return F.when(high < 1, "Control").when(low > 1, "Test").otherwise("N/A")


def error_bars(value: Column, low: Column, high: Column) -> tuple[Column, Column]:
    return F.greatest(value - low, F.lit(0.0)), F.greatest(high - value, F.lit(0.0))


def marker_size(x: Column) -> Column:
    ok = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x != float("inf"))
    return F.when(ok, F.log1p(x)).otherwise(0.0)


def trend_delta(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    got = df.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.min_by(y, x).alias("first_value"), F.max_by(y, x).alias("last_value"))
    d = F.col("last_value") - F.col("first_value")
    return got.withColumn("delta", d).withColumn("relative_delta", F.when(F.col("first_value") != 0, d / F.abs("first_value")))


def tile_top(df: DataFrame, by: str, n: int, ascending: bool = False, ties: list[str] | None = None) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by), *(ties or [])).limit(n)


def rule_label(rules: list[tuple[str, str, object, str]], default: str | None = None) -> Column:
    """The label of the first rule (column, operator, value, label) that holds."""
    ops = {"==": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v}
    out = None
    for column, op, value, label in rules:
        hit = ops[op](F.col(column), F.lit(value))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def gauge(df: DataFrame, value: str) -> DataFrame:
    top = F.max(value)
    return df.agg(F.avg(value).alias("reference"), F.when(top > 0, 1.2 * top).otherwise(1.0).alias("axis_max"))


def corners(x: list[float], y: list[float]) -> list[int]:
    """Which points, in order of x and then y, are corners of their convex hull; of equal points the first."""
    found: set[int] = set()
    for side in (1, -1):
        chain: list[int] = []
        for k, point in enumerate(zip(x, y, strict=True)):
            if chain and point == (x[chain[-1]], y[chain[-1]]):
                continue
            while len(chain) > 1:
                i, j = chain[-2:]
                if side * ((x[j] - x[i]) * (point[1] - y[i]) - (y[j] - y[i]) * (point[0] - x[i])) > 0:
                    break
                chain.pop()
            chain.append(k)
        found.update(chain)
    return sorted(found)


def _thinned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each bucket's points in a batch the corners: a triangle on two given points is largest at one of them."""
    for pdf in parts:
        pdf = pdf.sort_values("_n")
        own, x, y = pdf[["_first", "_b"]].to_numpy(), pdf["_x"].tolist(), pdf["_y"].tolist()
        cut = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
        yield pdf.iloc[[a + k for a, b in itertools.pairwise(cut) for k in corners(x[a:b], y[a:b])]]


#: Areas that are compared at a time.
AREAS = 1 << 21


def _largest(kept: tuple[np.ndarray, np.ndarray], mean: tuple[float, float], points: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """By point kept before, the first of a bucket's points that makes the largest triangle with it and the next bucket's mean."""
    step = max(1, AREAS // len(points[0]))
    out = []
    for at in range(0, len(kept[0]), step):
        kx, ky = (k[at : at + step, None] for k in kept)
        areas = np.abs((mean[0] - kx) * (points[1] - ky) - (mean[1] - ky) * (points[0] - kx))
        out.append(np.where(np.isnan(areas), -1.0, areas).argmax(axis=1))
    return np.concatenate(out)


def _buckets(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Of rows by line, stretch and bucket, over batches: ((line, stretch), places, xs, ys, the next bucket's mean)."""
    own, held = None, []

    def whole():
        n, x, y = (np.concatenate(c) for c in zip(*[h[:3] for h in held], strict=True))
        return own[:2], n, x, y, held[0][3]

    for pdf in parts:
        key, places = pdf[["_first", "_s", "_b"]].to_numpy(), pdf["_n"].to_numpy()
        x, y, mx, my = (pdf[c].to_numpy(np.float64) for c in ("_x", "_y", "_mx", "_my"))
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(pdf) else []
        for i, j in itertools.pairwise([*starts, len(pdf)]):
            if held and own != tuple(key[i].tolist()):
                yield whole()
                held = []
            own = tuple(key[i].tolist())
            held.append((places[i:j], x[i:j], y[i:j], (mx[i], my[i])))
    if held:
        yield whole()


def _ways(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each stretch, by point that may be kept before it, the point that is then kept at its end. Ways that meet go on as one."""
    own = None
    frame = lambda: pd.DataFrame({"_first": own[0], "_s": own[1], "_n": starts, "_end": kept[0][at]})
    for key, n, x, y, mean in _buckets(parts):
        if key != own:
            if own:
                yield frame()
            own, starts, kept, at = key, n, (n, x, y), np.arange(len(n))
            continue
        met, way = np.unique(_largest(kept[1:], mean, (x, y)), return_inverse=True)
        kept, at = (n[met], x[met], y[met]), way[at]
    if own:
        yield frame()


def _taken(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over a line's ways by stretch: those that are taken."""
    due = at = None
    for pdf in parts:
        out = []
        for first, s, n, end in pdf[["_first", "_s", "_n", "_end"]].itertuples(index=False):
            if s == 0:
                due, at = (first, 0), n
            if (first, s) == due and n == at:
                out.append((first, s, n))
                due, at = (first, s + 1), end
        yield pd.DataFrame(out, columns=["_first", "_s", "_n"]).astype(np.int64)


def _walked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The points that are kept of each stretch, from the one before it, which is its first bucket."""
    own, out = None, []
    for key, n, x, y, mean in _buckets(parts):
        pick = int(_largest(kept, mean, (x, y))[0]) if key == own else 0
        if key == own or key[1] == 0:
            out.append(n[pick])
        own, kept = key, (x[pick : pick + 1], y[pick : pick + 1])
        if len(out) == 10_000:
            yield pd.DataFrame({"_n": out})
            out = []
    yield pd.DataFrame({"_n": np.array(out, np.int64)})


def walked(points: DataFrame, stretch: int) -> DataFrame:
    """The places (`_n`) that largest triangles keep of lines (`_first`) in buckets from -1 (`_b`), whose points have `_x`, `_y` and the next bucket's mean `_mx`, `_my`.

    What a bucket keeps depends on what the one before keeps. So lines are cut into stretches of some buckets, each of
    which first finds its end for every point that may be kept before it; following these ends from stretch to stretch
    gives each its true beginning, and then all stretches are walked beside each other.
    """
    place = F.col("_b") + 1
    own = F.floor(place / stretch)
    both = F.when(place % stretch == stretch - 1, F.array(own, own + 1)).otherwise(F.array(own))
    rows = settled(points.select("*", F.explode(both).alias("_s"), own.alias("_own")))
    in_order = lambda df: df.repartition("_first", "_s").sortWithinPartitions("_first", "_s", "_b", "_n")
    ways = in_order(rows).mapInPandas(_ways, "_first long, _s long, _n long, _end long")
    taken = ways.repartition("_first").sortWithinPartitions("_first", "_s").mapInPandas(_taken, "_first long, _s long, _n long")
    inside = F.col("_own") == F.col("_s")
    begun = rows.where(inside).unionByName(rows.where(~inside).join(taken, ["_first", "_s", "_n"], "left_semi"))
    return in_order(begun).mapInPandas(_walked, "_n long")


def _axis(df: DataFrame, x: str) -> Column:
    """A line's axis as numbers; texts that aren't numbers stand by their place."""
    kind = df.schema[x].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(x).cast("timestamp")) / 1e6
    return F.col(x).try_cast("double")


def downsampled(df: DataFrame, series: list[str], x: str, y: str, points: int = 50_000) -> DataFrame:
    """Each series' line with at most its share of the points (at least 3), rows as they are. A null y counts as 0; a null series is one.

    Largest triangles of three buckets. Lines are put in order by range partitions and cut into buckets of equal
    length, and batches of rows are thinned to the corners of their buckets' hulls, over which walked() goes; a task holds
    a bucket's corners at a time.
    """
    lines = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.struct(F.lit(0), *series).alias("_line"), F.col(x).alias("_at"), _axis(df, x).alias("_x"), F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias("_y"))
    rows = settled(numbered(lines, [F.col(c) for c in ("_line", "_at", "_y")], "_n"))
    sizes = settled(rows.groupBy("_line").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_size")))
    budget = max(3, points // max(1, sizes.count()))
    rows = rows.join(sizes, "_line").withColumn("_k", F.col("_n") - F.col("_first")).withColumn("_x", F.coalesce("_x", F.col("_k").cast("double")))
    few = F.col("_size") <= budget
    inner = F.expr(f"(_k * {budget - 2} - 1) div (_size - 2)")
    long = rows.where(~few).withColumn("_b", F.when(F.col("_k") == 0, -1).when(F.col("_k") == F.col("_size") - 1, budget - 2).otherwise(inner).cast("long"))
    means = long.groupBy("_first", (F.col("_b") - 1).alias("_b")).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    thin = long.select("_first", "_b", "_n", "_x", "_y").mapInPandas(_thinned, "_first long, _b long, _n long, _x double, _y double")
    kept = walked(thin.join(means, ["_first", "_b"], "left").fillna(0.0, ["_mx", "_my"]), math.isqrt(budget))
    return rows.where(few).select("_row.*").union(long.join(kept, "_n", "left_semi").select("_row.*"))


def score_column(name: str, property_: str) -> Column:
    """The state that a descriptive score is read from: Count, Sum, Mean, Var, Min, Max, or a quantile by name."""
    from stateroll.operators import metrics

    return S.quantile(f"{property_}_Digest", metrics.QUANTILES[name]) if name in metrics.QUANTILES else F.col(f"{property_}_{name}")


def density(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))


def hierarchy(df: DataFrame, path: list[str], value: str) -> DataFrame:
    """Totals of every level of a path: null below the level that a row is for."""
    return df.rollup(*path).agg(F.sum(value).alias(value), F.grouping_id().alias("_g")).withColumn("level", F.lit(len(path)) - F.bit_count("_g")).drop("_g")


