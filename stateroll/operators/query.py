"""Query operators over merged states: filter, range, roll-up, having, top-n, order and comparison, all lazy."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stateroll.functions import calendar as C
from stateroll.operators import states as S

OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*(v if isinstance(v, list) else [v])), "not_in": lambda c, v: ~c.isin(*(v if isinstance(v, list) else [v])),
    "contains": lambda c, v: c.cast("string").contains(str(v)), "starts_with": lambda c, v: c.cast("string").startswith(str(v)), "ends_with": lambda c, v: c.cast("string").endswith(str(v)),
    "is_null": lambda c, v: c.isNull(), "not_null": lambda c, v: c.isNotNull(),
}
OTHER_NAMES = {"=": "eq", "==": "eq", "!=": "ne", "<>": "ne", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "not in": "not_in", "is_not_null": "not_null"}


def predicate(column: str, spec: Any) -> Column:
    """A value, a list of values, or {op, value}."""
    c = F.col(column)
    if not isinstance(spec, dict):
        return c.isin(*(spec if isinstance(spec, list) else [spec]))
    name = str(spec.get("op", "")).strip().lower()
    op = OTHER_NAMES.get(name, name)
    if op not in OPERATORS:
        raise ValueError(f"unsupported operator {spec.get('op')!r} on {column!r}; known: {', '.join(OPERATORS)}")
    value = spec.get("values", spec.get("value"))
    if value is None and op not in ("is_null", "not_null"):
        raise ValueError(f"operator {op!r} on {column!r} needs a value")
    return OPERATORS[op](c, value)


def filtered(df: DataFrame, filters: dict[str, Any]) -> DataFrame:
    for column, spec in filters.items():
        if column not in df.columns:
            raise ValueError(f"no column {column!r}; there are {', '.join(df.columns)}")
        df = df.where(predicate(column, spec))
    return df


def scoped(df: DataFrame, authored: dict[str, Any], interactive: dict[str, Any], time: tuple[str, ...] = ("Day", "Week", "Month", "Quarter", "Year", "Hour")) -> tuple[DataFrame, list[str]]:
    """Filters on stored dimensions apply, authored ones before interactive ones; the names of the others come back."""
    every = interactive | authored
    known = {k: v for k, v in every.items() if k in df.columns and k not in time}
    return filtered(df, known), sorted(set(every) - set(known))


def time_range(df: DataFrame, grain: str, start: Any = None, end: Any = None) -> DataFrame:
    """Both ends included; by day, or by month label. Other grains aren't trimmed."""
    grain = C.grain(grain)
    if grain == "daily":
        name, bound = next((c for c in ("Day", "day", "as_of_date", "as_of") if c in df.columns), None), lambda v: F.lit(str(v)[:10]).cast("date")
    elif grain == "monthly":
        name, bound = next((c for c in ("Month", "month", "period") if c in df.columns), None), lambda v: F.lit(str(v)[:7])
    else:
        return df
    if name is None:
        return df
    if start is not None:
        df = df.where(F.col(name) >= bound(start))
    return df if end is None else df.where(F.col(name) <= bound(end))


def period_prune(df: DataFrame, grain: str, start: Any = None, end: Any = None) -> DataFrame:
    """A predicate on the partition column, from the range asked for."""
    if C.grain(grain) not in ("daily", "monthly") or "period" not in df.columns:
        return df
    if start is not None:
        df = df.where(F.col("period") >= str(start)[:7])
    return df if end is None else df.where(F.col("period") <= str(end)[:7])


def group_columns(df: DataFrame, dims: list[str], grain: str) -> list[str]:
    """The time column of the grain, if there, and the dimensions."""
    time = C.TIME_COLUMN.get(C.grain(grain))
    out = [time] if time and time in df.columns else []
    for d in dims:
        if d not in df.columns:
            raise ValueError(f"no dimension {d!r}")
        out += [d] if d not in out else []
    return out


def top_n(df: DataFrame, n: int, by: str | None = None, within: list[str] | None = None, groups: list[str] | None = None) -> DataFrame:
    """The largest n by a column, nulls last; of each group if within is given. Ties by all other columns."""
    groups = groups or []
    numeric = [f.name for f in df.schema if f.name not in groups and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    by = by or (numeric[0] if numeric else df.columns[-1])
    order = [F.desc_nulls_last(by), *[F.col(c) for c in df.columns if c != by and df.schema[c].dataType.typeName() not in ("array", "struct", "map", "binary")]]
    n = max(1, int(n))
    if not within:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*within).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def ordered(df: DataFrame, order: list[str] | None, default: list[str]) -> DataFrame:
    """Names, `-name` for descending."""
    by = []
    for item in order or default:
        name = item.strip().lstrip("-").strip()
        if name not in df.columns:
            raise ValueError(f"no column {name!r} to order by")
        by.append(F.desc(name) if item.strip().startswith("-") else F.col(name))
    return df.orderBy(*by) if by else df


def prior_period(df: DataFrame, time: str, dims: list[str], values: list[str] | None = None) -> DataFrame:
    """_prev, _delta and _pct_change against the row before of the same dims; null where there is none or it is 0."""
    values = values or [f.name for f in df.schema if f.name not in (time, *dims) and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    w = W.partitionBy(*[F.col(d) for d in dims] or [F.lit(0)]).orderBy(time)
    out = df
    for v in values:
        prev = F.lag(v).over(w)
        out = out.withColumn(f"{v}_prev", prev).withColumn(f"{v}_delta", F.col(v) - F.col(f"{v}_prev"))
        out = out.withColumn(f"{v}_pct_change", F.when(F.col(f"{v}_prev") != 0, (F.col(v) - F.col(f"{v}_prev")) / F.col(f"{v}_prev")))
    return out


def provenance(df: DataFrame, stored_grain: str) -> DataFrame:
    """Of the rows that a result was made from: runs, chunks, hashes, how many rows, and the newest."""
    return df.agg(
        F.sort_array(F.collect_set("pipeline_run_id")).alias("run_ids"), F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"), F.sort_array(F.collect_set("config_hash")).alias("config_hashes"),
        F.count(F.lit(1)).alias("rows_scanned"), F.max("created_at").alias("latest_created_at"), F.lit(stored_grain).alias("stored_grain"),
    )


def readiness(df: DataFrame, config_hash: str) -> DataFrame:
    """ready: rows of this hash; stale: only rows of others; unpublished: none. An empty range of a ready table is ready."""
    n, own = F.count(F.lit(1)), F.count_if(F.col("config_hash") == config_hash)
    return df.agg(own.alias("current_rows"), n.alias("published_rows")).withColumn("state", F.when(F.col("current_rows") > 0, "ready").when(F.col("published_rows") > 0, "stale").otherwise("unpublished"))


def dimension_values(df: DataFrame, column: str, limit: int = 50) -> DataFrame:
    return df.select(column).dropna().distinct().orderBy(column).limit(limit)


def filter_options(df: DataFrame, column: str, limit: int = 500) -> DataFrame:
    """Texts that aren't empty, in case-blind order."""
    text = F.col(column).cast("string").alias("option")
    return df.select(text).where("option IS NOT NULL AND option <> ''").distinct().orderBy(F.lower("option"), "option").limit(limit)


def available_range(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"))


def relative_bounds(preset: str, latest: dt.date, today: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """7d, 30d, 90d or ytd, up to the latest data or today, whichever is earlier."""
    end = min(latest, today or dt.date.today())
    if preset == "ytd":
        return end.replace(month=1, day=1), end
    return end - dt.timedelta(days=int(preset.rstrip("d")) - 1), end


def kpi_card(df: DataFrame, day: str, metric: Callable[[Callable[[Column], Column]], Column], start: dt.date, end: dt.date, target: float | None = None) -> DataFrame:
    """A value over [start, end], over the window of equal length right before, and their differences.

    metric gets a function that limits a column to a window (null outside) and returns an aggregate.
    """
    days = (end - start).days + 1
    within = lambda a, b: lambda c: F.when(F.col(day).between(F.lit(a), F.lit(b)), c)
    one = df.agg(metric(within(start, end)).alias("value"), metric(within(start - dt.timedelta(days=days), start - dt.timedelta(days=1))).alias("previous"))
    one = one.withColumn("delta", F.col("value") - F.col("previous")).withColumn("pct_change", F.when(F.col("previous") != 0, (F.col("value") - F.col("previous")) / F.col("previous")))
    return one if target is None else one.withColumn("target_delta", F.col("value") - F.lit(float(target)))


def sparkline(df: DataFrame, time: str, n: int) -> DataFrame:
    """The last n points, in order of time."""
    return df.orderBy(F.desc(time)).limit(n).orderBy(time)


def combined(left: DataFrame, right: DataFrame, dims: list[str], values: list[str]) -> DataFrame:
    """A second metric beside the first, on the dims that both have; without any, a value of one row is set beside all."""
    on = [d for d in dims if d in left.columns and d in right.columns]
    right = right.select(*on, *values)
    return left.join(right, on, "left") if on else left.crossJoin(F.broadcast(right.limit(1)))


def planned(dims: list[str], default: str | None = None) -> tuple[str, list[str]]:
    """The grain of a report and its dimensions without time columns: the finest time column asked for, else the default, else summary."""
    times = {v: k for k, v in C.TIME_COLUMN.items()}
    asked = [times[d] for d in dims if d in times]
    return (min(asked, key=C.GRAINS.index) if asked else C.grain(default or "summary")), [d for d in dims if d not in times]


def coverage(latest: list[DataFrame]) -> DataFrame:
    """The date that all metrics reach: each of latest has one text or date column, a period's label counts as its last day."""
    every = None
    for df in latest:
        label = F.col(df.columns[0]).cast("string")
        end = F.when(F.length(label) == 4, F.try_to_date(F.concat(label, F.lit("-12-31")))).when(F.length(label) == 7, F.last_day(F.try_to_date(F.concat(label, F.lit("-01"))))).otherwise(F.try_to_date(label))
        one = df.agg(F.max(end).alias("d"))
        every = one if every is None else every.union(one)
    return every.agg(F.min("d").alias("covered_until"))


def quality(kind: str, lg_k: int = S.LG_K) -> str:
    """What to say of a metric's method."""
    if kind in ("approx_distinct_count", "set_op"):
        return f"approximate, relative standard error {1.04 / 2 ** (lg_k / 2):.4f}"
    if kind in ("quantile", "distribution", "curve_from_digests", "calibration_from_digests", "topk_items"):
        return "approximate, from a sketch"
    return "statistical estimate" if kind in ("variant_compare", "contingency_test", "proportion_test") else "exact"


@dataclass(frozen=True)
class Query:
    """A metric over a table of states, step by step; to_frame() is lazy."""

    table: DataFrame
    states: tuple
    derive: Callable[[DataFrame], DataFrame]
    outputs: tuple[str, ...]
    dims: tuple[str, ...] = ()
    grain_name: str = "summary"
    filters: dict = field(default_factory=dict)
    start: Any = None
    end: Any = None
    having_: dict = field(default_factory=dict)
    order: tuple[str, ...] = ()
    top: tuple | None = None
    compare_: str | None = None
    keep_states: bool = False

    def by(self, *dims: str) -> Query:
        return replace(self, dims=dims)

    def where(self, **filters: Any) -> Query:
        return replace(self, filters=self.filters | filters)

    def grain(self, name: str) -> Query:
        return replace(self, grain_name=C.grain(name))

    def between(self, start: Any, end: Any) -> Query:
        return replace(self, start=start, end=end)

    def having(self, **specs: Any) -> Query:
        return replace(self, having_=self.having_ | specs)

    def order_by(self, *names: str) -> Query:
        return replace(self, order=names)

    def top_n(self, n: int, by: str | None = None, within: list[str] | None = None) -> Query:
        return replace(self, top=(n, by, within))

    def compare(self, mode: str = "prior_period") -> Query:
        if mode != "prior_period":
            raise ValueError(f"unsupported comparison {mode!r}")
        return replace(self, compare_=mode)

    def raw(self) -> Query:
        return replace(self, keep_states=True)

    def to_frame(self) -> DataFrame:
        df = C.with_coarser(self.table)
        df = time_range(filtered(df, self.filters), "daily" if "Day" in df.columns else self.grain_name, self.start, self.end)
        keys = group_columns(df, list(self.dims), self.grain_name)
        out = self.derive(S.merge(df, keys, list(self.states)))
        out = out.select(*keys, *self.outputs, *[s.name for s in self.states if self.keep_states and s.name not in self.outputs])
        if self.compare_:
            time = C.TIME_COLUMN.get(self.grain_name)
            if time not in keys:
                raise ValueError("a comparison needs a time axis")
            out = prior_period(out, time, [k for k in keys if k != time])
        out = filtered(out, self.having_)
        if self.top:
            out = top_n(out, *self.top, groups=keys)
        return ordered(out, list(self.order), keys)

    def to_pandas(self):
        return self.to_frame().toPandas()
