"""Mergeable states that Spark has no aggregate for: t-digest, frequent items with an error offset, coupon counting.

Each is a column of plain structs. A state is made in two moves, from rows and from other states alike: rows that are
small already (clusters of values, counts of items, bits of coupons) are shuffled by key and reduced to one struct a key. So the
states of a table's parts add up to those of the whole, whatever the parts are. All states of a kind share one pass.

- t-digest: values are clustered in their order, the finer the nearer to either end (the arcsine scale). Tasks make
  states of their own rows, or join those of other states, first. A shuffled row is a state, its clusters as two arrays; a key's
  are sorted together and joined as they stream by, so that no task holds more than HELD_VALUES clusters.
- Frequent items: counters of the most frequent items, and an offset by which any count may be short (Misra-Gries). Merging
  adds counters and offsets, then takes the greatest count that finds no room away from all and adds it to the offset.
- Coupons: a value's hash names a slot and a column that falls off by halves; a state holds the set of coupons seen, as
  bits by slot, and is merged by bit-or. The number of different values is the one for which as many coupons are
  expected as are held.

Nulls and NaN are no values; a key without values has an empty state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Clusters of a digest for each unit of its size.
CLUSTERS = 2
#: Values (or clusters) and keys that a task holds before it clusters, or sends on, what it has.
HELD_VALUES, HELD_KEYS = 1 << 20, 20_000
DIGEST = "struct<low: double, high: double, n: bigint, centroids: array<struct<mean: double, weight: bigint>>>"
TOP = "struct<offset: bigint, total: bigint, items: array<struct<item: string, count: bigint>>>"
COUPONS = "array<struct<slot: int, bits: bigint>>"


def _long(df: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """A row for each key and column that isn't null: keys as _k0, _k1 ..., the column's number _s, its value v."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("s"), c.alias("v")) for k, c in enumerate(columns)]))
    one = df.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], each.alias("e"))
    return one.select(*[f"_k{n}" for n in range(len(keys))], F.col("e.s").alias("_s"), F.col("e.v").alias("v")).where("v IS NOT NULL")


def _wide(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """A row a key, with the states by name."""
    got = df.groupBy(*[F.col(f"_k{n}").alias(k) for n, k in enumerate(keys)])
    return got.agg(*[F.first(F.when(F.col("_s") == k, F.col("state")), ignorenulls=True).alias(n) for k, n in enumerate(names)])


def _by(keys: list[str]) -> list[str]:
    return [*[f"_k{n}" for n in range(len(keys))], "_s"]


# t-digest


def place(q, size: int):
    """The cluster of a quantile, as a number that ascends with it; for arrays."""
    return np.floor(CLUSTERS * size * (np.arcsin(np.clip(2 * q - 1, -1, 1)) / np.pi + 0.5))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])


def _upto(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For clusters in order of key: those of the key, their weight up to and with each, and in all."""
    begin = _runs(key)
    count = np.diff(np.r_[begin, len(key)])
    upto = np.cumsum(weight)
    return np.repeat(count, count), upto - np.repeat(upto[begin] - weight[begin], count), np.repeat(np.add.reduceat(weight, begin), count)


def clustered(key: np.ndarray, mean: np.ndarray, weight: np.ndarray, size: int, last: bool) -> tuple[np.ndarray, ...]:
    """Fewer clusters for many, key by key: equal values are one, and neighbours whose middles fall into the same place are joined.

    Before the last time, keys of few values keep all of them. The last time, a value that spans several places is told by
    a cluster at either end of it as well, so that ranks beside it are right.
    """
    order = np.lexsort((mean, key))
    key, mean, weight = key[order], mean[order], weight[order]
    begin = _runs(key, mean)
    key, mean, weight = key[begin], mean[begin], np.add.reduceat(weight, begin)
    count, upto, total = _upto(key, weight)
    at = np.where(last | (count > CLUSTERS * size), place((upto - weight / 2) / total, size), np.arange(len(key)))
    begin = _runs(key, at)
    with np.errstate(over="ignore", invalid="ignore"):
        w = np.add.reduceat(weight, begin)
        middle = np.where(np.diff(np.r_[begin, len(key)]) > 1, np.add.reduceat(mean * weight, begin) / w, mean[begin])
    key, mean, weight = key[begin], middle, w
    if last:
        _, upto, total = _upto(key, weight)
        wide = place(upto / total, size) - place((upto - weight) / total, size) > 3  # neighbours that are joined span no more
        n = np.where(wide, np.minimum(weight, 3), 1)
        end = np.cumsum(n)
        key, mean, weight = np.repeat(key, n), np.repeat(mean, n), np.repeat(np.where(wide, weight - 2, weight), n)
        weight[(end - n)[wide]] = weight[(end - 1)[wide]] = 1
    return key, mean, weight


class _Held(NamedTuple):
    """States, or values as states of one: keys as Arrow columns, ends, and clusters, of which each row has so many."""

    keys: pa.Table
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray
    mean: np.ndarray
    weight: np.ndarray

    @staticmethod
    def read(b: pa.RecordBatch, names: list[str]) -> _Held:
        keys, flat = pa.Table.from_batches([b.select(names)]), lambda n: b.column(n).to_numpy(zero_copy_only=False)
        if "v" in b.schema.names:
            v, one = flat("v"), np.ones(b.num_rows, np.int64)
            return _Held(keys, v, v, one, v, one)
        count = b.column("mean").value_lengths().to_numpy(zero_copy_only=False)
        return _Held(keys, flat("low"), flat("high"), count, b.column("mean").flatten().to_numpy(), b.column("weight").flatten().to_numpy())

    def only(self, rows: np.ndarray) -> _Held:
        at = np.repeat(rows, self.count)
        return _Held(self.keys.filter(pa.array(rows)), self.low[rows], self.high[rows], self.count[rows], self.mean[at], self.weight[at])

    def batch(self) -> pa.RecordBatch:
        ends = pa.array(np.r_[0, np.cumsum(self.count)].astype(np.int32))
        each = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (self.mean, self.weight)]
        n = np.add.reduceat(self.weight, np.cumsum(self.count) - self.count)
        keys = [c.combine_chunks() for c in self.keys.columns]
        return pa.RecordBatch.from_arrays([*keys, pa.array(self.low), pa.array(self.high), pa.array(n), *each], names=[*self.keys.column_names, "low", "high", "n", "mean", "weight"])


def _numbered(keys: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A row of each key, and each row's key as the number of that."""
    code, kinds = np.zeros(len(keys), np.int64), 1
    for c in keys.columns:
        c = pa.concat_arrays(c.chunks)
        one = (pc.add(c, pa.scalar(0.0, c.type)) if pa.types.is_floating(c.type) else c).dictionary_encode("encode")  # minus zero is zero
        if kinds * len(one.dictionary) >= 1 << 62:
            kept, code = np.unique(code, return_inverse=True)
            kinds = len(kept)
        code, kinds = code * len(one.dictionary) + one.indices.to_numpy(), kinds * len(one.dictionary)
    _, row, code = np.unique(code, return_index=True, return_inverse=True)
    return row, code


def _merged(held: list[_Held], size: int, last: bool) -> tuple[_Held, int]:
    """A state a key, and the row of the key that came last."""
    keys = pa.concat_tables([h.keys for h in held])
    low, high, count, mean, weight = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
    row, code = _numbered(keys)
    lows, highs = np.full(len(row), np.inf), np.full(len(row), -np.inf)
    np.minimum.at(lows, code, low)
    np.maximum.at(highs, code, high)
    key, mean, weight = clustered(np.repeat(code, count), mean, weight, size, last)
    return _Held(keys.take(pa.array(row)), lows, highs, np.bincount(key, minlength=len(row)), mean, weight), int(code[-1])


def _task_digests(n_keys: int, size: int, last: bool):
    """A task's rows as states, of which it holds a bounded number of clusters. last: rows lie in order of their keys, and each key's are all here."""
    names, most, most_keys = [*[f"_k{n}" for n in range(n_keys)], "_s"], HELD_VALUES, HELD_KEYS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Held] = []
        n_held = 0
        for b in batches:
            values = b.num_rows if "v" in b.schema.names else len(b.column("mean").flatten())
            step = max(1, b.num_rows * most // max(values, 1))
            for at in range(0, b.num_rows, step):
                held.append(_Held.read(b.slice(at, step), names))
                n_held += len(held[-1].mean)
                if n_held <= most:
                    continue
                one, newest = _merged(held, size, False)
                held, n_held = [one], len(one.mean)
                if n_held > most // 2 or len(one.keys) > most_keys:
                    open_ = np.arange(len(one.keys)) == newest if last else np.zeros(len(one.keys), bool)
                    if not open_.all():
                        done = one.only(~open_)
                        yield (_merged([done], size, True)[0] if last else done).batch()
                    held = [one.only(open_)] if last else []
                    n_held = sum(len(h.mean) for h in held)
        if held:
            yield _merged(held, size, last)[0].batch()

    return run


def _digests(rows: DataFrame, keys: list[str], names: list[str], size: int) -> DataFrame:
    """States in the tasks, then all of a key together; a row a key and name, or one row."""
    by = _by(keys)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), "low double, high double, n bigint, mean array<double>, weight array<bigint>"])
    parts = rows.mapInArrow(_task_digests(len(keys), size, False), schema)
    dealt = (parts.repartition(*by) if keys else parts.repartition(1)).sortWithinPartitions(*by)
    last = dealt.mapInArrow(_task_digests(len(keys), size, True), schema)
    states = last.select(*by, F.struct("low", "high", "n", F.arrays_zip("mean", "weight").alias("centroids")).cast(DIGEST).alias("state"))
    if not keys:
        return _wide(states, keys, names)
    return states.select(*[F.col(f"_k{n}").alias(k) for n, k in enumerate(keys)], *[F.when(F.col("_s") == k, F.col("state")).alias(n) for k, n in enumerate(names)])


def build_digests(df: DataFrame, keys: list[str], names: list[str], values: list[Column], size: int) -> DataFrame:
    return _digests(_long(df, keys, [v.cast("double") for v in values]).where(~F.isnan("v")), keys, names, size)


def merge_digests(df: DataFrame, keys: list[str], names: list[str], size: int) -> DataFrame:
    long = _long(df, keys, [F.col(n) for n in names]).where("v.n > 0")
    return _digests(long.select(*_by(keys), "v.low", "v.high", F.col("v.centroids.mean").alias("mean"), F.col("v.centroids.weight").alias("weight")), keys, names, size)


def digest_weight(c: Column) -> Column:
    return F.coalesce(c["n"], F.lit(0).cast("bigint"))


def digest_quantile(c: Column, q: float | Column) -> Column:
    """The value of a rank, between the middles of the clusters around it; the ends are the least and the greatest value."""
    q = F.lit(float(q)) if isinstance(q, (int, float)) else q
    want = q * c["n"]
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(0.0).alias("rank"), c["low"].alias("mean"), F.lit(None).cast("double").alias("found"))

    def step(t, x):
        rank = t["upto"] + x["weight"] / 2
        share = F.when(rank > t["rank"], (want - t["rank"]) / (rank - t["rank"])).otherwise(1.0)
        here = F.when(t["found"].isNull() & (want <= rank), t["mean"] + (x["mean"] - t["mean"]) * share)
        return F.struct((t["upto"] + x["weight"]).alias("upto"), rank.alias("rank"), x["mean"].alias("mean"), F.coalesce(t["found"], here).alias("found"))

    last = lambda t: F.coalesce(t["found"], t["mean"] + (c["high"] - t["mean"]) * F.least(F.try_divide(want - t["rank"], t["upto"] - t["rank"]), F.lit(1.0)))
    return F.when(digest_weight(c) == 0, 0.0).when(q <= 0, c["low"]).when(q >= 1, c["high"]).otherwise(F.aggregate(c["centroids"], start, step, last))


def digest_rank(c: Column, x: float | Column) -> Column:
    """The share of values up to x. Clusters of one value several times over count whole at that value; one cluster at it, by half if it joins values."""
    x = F.lit(float(x)) if isinstance(x, (int, float)) else x
    null = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(0.0).alias("rank"), c["low"].alias("mean"), null.alias("next_rank"), null.alias("next_mean"), F.lit(0.0).alias("at"), F.lit(0).alias("n_at"), F.lit(0.0).alias("under"))

    def step(t, k):
        rank = t["upto"] + k["weight"] / 2
        below, at = k["mean"] < x, k["mean"] == x
        above = ~below & ~at & t["next_rank"].isNull()
        return F.struct(
            (t["upto"] + k["weight"]).alias("upto"), F.when(below, rank).otherwise(t["rank"]).alias("rank"), F.when(below, k["mean"]).otherwise(t["mean"]).alias("mean"), F.when(above, rank).otherwise(t["next_rank"]).alias("next_rank"),
            F.when(above, k["mean"]).otherwise(t["next_mean"]).alias("next_mean"), (t["at"] + F.when(at, k["weight"]).otherwise(0)).alias("at"), (t["n_at"] + at.cast("int")).alias("n_at"), (t["under"] + F.when(below, k["weight"]).otherwise(0)).alias("under"),
        )

    def last(t):
        to_rank, to_mean = F.coalesce(t["next_rank"], c["n"].cast("double")), F.coalesce(t["next_mean"], c["high"])
        between = t["rank"] + F.coalesce(F.try_divide((x - t["mean"]) * (to_rank - t["rank"]), to_mean - t["mean"]), F.lit(0.0))
        there = t["under"] + F.when((t["n_at"] > 1) | (t["at"] == 1), t["at"]).otherwise(t["at"] / 2)
        return F.when(t["n_at"] > 0, there).otherwise(between) / c["n"]

    return F.when(digest_weight(c) == 0, 0.0).when(x < c["low"], 0.0).when(x >= c["high"], 1.0).otherwise(F.aggregate(c["centroids"], start, step, last))


def _points(mean: np.ndarray, weight: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and values that lie on the digest's curve: its ends and its clusters' middles."""
    upto = np.cumsum(weight)
    return np.r_[0.0, upto - weight / 2, upto[-1]], np.r_[low, mean, high]


def digest_quantiles(c: Column, qs: list[float]) -> Column:
    """Many quantiles of one digest at once; nulls for an empty one."""
    at = np.array(qs)

    @F.pandas_udf("array<double>")
    def read(mean: pd.Series, weight: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        def one(m, w, a, b):
            if m is None or not len(m):
                return None
            x, y = _points(np.asarray(m, float), np.asarray(w, float), a, b)
            return np.interp(at * x[-1], x, y)

        return pd.Series([one(*r) for r in zip(mean, weight, low, high, strict=True)])

    return read(c["centroids"]["mean"], c["centroids"]["weight"], c["low"], c["high"])


def digest_ranks(c: Column, xs: list[float]) -> Column:
    """The shares of values up to each x, as digest_rank() gives them."""
    at = np.array(xs)

    @F.pandas_udf("array<double>")
    def read(mean: pd.Series, weight: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        def one(m, w, a, b):
            if m is None or not len(m):
                return None
            m, w = np.asarray(m, float), np.asarray(w, float)
            x, y = _points(m, w, a, b)
            keep = np.r_[True, y[1:] > y[:-1]] | np.r_[y[1:] > y[:-1], True]
            got = np.interp(at, y[keep], x[keep])
            upto = np.r_[0, np.cumsum(w)]
            left, right = np.searchsorted(m, at, "left"), np.searchsorted(m, at, "right")
            mass, n = upto[right] - upto[left], right - left
            got = np.where(n > 0, upto[left] + np.where((n > 1) | (mass == 1), mass, mass / 2), got)
            return np.where(at < a, 0, np.where(at >= b, upto[-1], got)) / upto[-1]

        return pd.Series([one(*r) for r in zip(mean, weight, low, high, strict=True)])

    return read(c["centroids"]["mean"], c["centroids"]["weight"], c["low"], c["high"])


# frequent items


def _top(counts: DataFrame, offsets: DataFrame, keys: list[str], names: list[str], room: int) -> DataFrame:
    """counts: a row an item, with n; offsets: a row a key, with total and offset."""
    by = _by(keys)
    order = W.partitionBy(*by).orderBy(F.desc("n"), "v")
    kept = counts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= room + 1)
    items = F.sort_array(F.collect_list(F.when(F.col("_n") <= room, F.struct(F.col("_n").alias("rank"), F.col("v").alias("item"), F.col("n").alias("count")))))
    one = kept.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("_n") == room + 1, F.col("n"))), F.lit(0)).alias("more"), items.alias("items"))
    renamed = offsets.select(*[F.col(b).alias(f"_o{b}") for b in by], "total", "offset")
    both = one.join(renamed, [F.col(b).eqNullSafe(F.col(f"_o{b}")) for b in by])
    less = F.filter(F.transform("items", lambda x: F.struct(x["item"].alias("item"), (x["count"] - F.col("more")).alias("count"))), lambda x: x["count"] > 0)
    state = F.struct((F.col("offset") + F.col("more")).alias("offset"), "total", less.alias("items")).cast(TOP)
    return _wide(both.select(*by, state.alias("state")), keys, names)


def build_tops(df: DataFrame, keys: list[str], names: list[str], values: list[Column], room: int) -> DataFrame:
    by = _by(keys)
    counts = _long(df, keys, [v.cast("string") for v in values]).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    return _top(counts, counts.groupBy(*by).agg(F.sum("n").alias("total"), F.lit(0).cast("bigint").alias("offset")), keys, names, room)


def merge_tops(df: DataFrame, keys: list[str], names: list[str], room: int) -> DataFrame:
    by, long = _by(keys), _long(df, keys, [F.col(n) for n in names])
    counts = long.select(*by, F.explode("v.items").alias("i")).groupBy(*by, F.col("i.item").alias("v")).agg(F.sum("i.count").alias("n"))
    return _top(counts, long.groupBy(*by).agg(F.sum("v.total").alias("total"), F.sum("v.offset").alias("offset")), keys, names, room)


def frequent_items(c: Column, mode: str = "NO_FALSE_POSITIVES", threshold: Column | int | None = None) -> Column:
    """Items with estimate and bounds, the most frequent first.

    An item's count is at least what it holds and at most the offset more. NO_FALSE_POSITIVES: items that surely occur
    more often than the threshold; NO_FALSE_NEGATIVES: all held items that may. Without a threshold it is the offset,
    above which every item is held.
    """
    limit = c["offset"] if threshold is None else F.greatest(F.lit(threshold) if isinstance(threshold, int) else threshold, c["offset"])
    rows = F.transform(c["items"], lambda x: F.struct(x["item"].alias("item"), (x["count"] + c["offset"]).alias("estimate"), x["count"].alias("lower"), (x["count"] + c["offset"]).alias("upper")))
    bound = {"NO_FALSE_POSITIVES": "lower", "NO_FALSE_NEGATIVES": "upper"}[mode]
    return F.filter(rows, lambda x: x[bound] > limit)


def total_weight(c: Column) -> Column:
    return F.coalesce(c["total"], F.lit(0).cast("bigint"))


# coupons


def _coupons(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    by = _by(keys)
    slots = rows.groupBy(*by, "slot").agg(F.bit_or("bits").alias("bits"))
    if keys:
        slots = slots.repartition(*by[:-1])
    one = slots.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("slot", "bits"))).cast(COUPONS).alias("state"))
    return _wide(one, keys, names)


def build_coupons(df: DataFrame, keys: list[str], names: list[str], values: list[Column], lg_k: int) -> DataFrame:
    long = _long(df, keys, [v.cast("string") for v in values])
    hashed = F.xxhash64("v")
    rest = F.shiftrightunsigned(hashed, lg_k)  # a positive number
    column = F.when(rest == 0, 64 - lg_k).otherwise(F.bit_count(rest.bitwiseAND(-rest) - 1))
    rows = long.select(*_by(keys), hashed.bitwiseAND(F.lit((1 << lg_k) - 1)).cast("int").alias("slot"), column.cast("int").alias("column"))
    return _coupons(rows.select(*_by(keys), "slot", F.expr("shiftleft(1L, column)").alias("bits")), keys, names)


def merge_coupons(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    long = _long(df, keys, [F.col(n) for n in names])
    return _coupons(long.select(*_by(keys), F.inline("v")), keys, names)


def coupon_estimate(c: Column, lg_k: int) -> Column:
    """The number of values for which the expected number of coupons is the one held, by halving an interval."""
    k = float(1 << lg_k)
    held = F.aggregate(c, F.lit(0.0), lambda t, x: t + F.bit_count(x["bits"]))
    chances = F.array(*[F.lit(math.log1p(-(2.0**-j) / k)) for j in range(1, 65 - lg_k)])

    def expected(n):
        return F.aggregate(chances, F.lit(0.0), lambda t, p: t - F.expm1(n * p)) * k

    def step(t, _):
        middle = F.sqrt(t["low"] * t["high"])
        few = expected(middle) < t["held"]
        return F.struct(F.when(few, middle).otherwise(t["low"]).alias("low"), F.when(few, t["high"]).otherwise(middle).alias("high"), t["held"].alias("held"))

    start = F.struct(F.lit(0.5).alias("low"), F.lit(1e19).alias("high"), held.alias("held"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda t: F.sqrt(t["low"] * t["high"]))
    return F.when(c.isNull() | (F.size(c) == 0), 0.0).otherwise(found)


def coupon_error(lg_k: int) -> float:
    """Relative standard error of the estimate."""
    return math.log(2) / math.sqrt(1 << lg_k)
