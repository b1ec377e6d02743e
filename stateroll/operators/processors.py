"""Processors: reductions of a transformed source to one row of mergeable states per key.

A processor has build(df) (rows to states at its finest key) and merge(df, keys) (states to coarser keys); both are
groupBy().agg(). Custom kinds register in plans.registry.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stateroll.functions.calendar import TIME_COLUMN, calendar_column
from stateroll.operators import states as S
from stateroll.operators.ordering import numbered
from stateroll.operators.states import State


# What stands for a boolean.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes"), ("false", "0", "no")


def _as_boolean(v) -> bool | None:
    if isinstance(v, str):
        word = v.strip().lower()
        return True if word in TRUE_WORDS else False if word in FALSE_WORDS else None
    return bool(v) if isinstance(v, (bool, int, float)) and v in (0, 1) else None


def _as_integer(v) -> int | None:
    """Whole numbers of 64 bits, digit for digit; numbers that aren't whole, or don't fit, are none."""
    try:
        exact = v if isinstance(v, int) else Decimal(v.strip()) if isinstance(v, str) else Decimal(v)
    except (ArithmeticError, TypeError, ValueError, AttributeError):
        return None
    if isinstance(exact, Decimal):
        if not exact.is_finite() or exact.adjusted() > 18 or exact != exact.to_integral_value():
            return None
    return int(exact) if -(1 << 63) <= exact < 1 << 63 else None


def _as_double(v) -> float | None:
    try:
        return float(v)
    except (ArithmeticError, TypeError, ValueError):
        return None


def compatible(values: list, dtype: T.DataType) -> list:
    """Configured values in the column's type; those that don't fit are left out."""
    if isinstance(dtype, T.StringType):
        return [str(v) for v in values]
    kinds = ((T.BooleanType, _as_boolean), (T.IntegralType, _as_integer), ((T.FloatType, T.DoubleType), _as_double))
    read = next((f for kind, f in kinds if isinstance(dtype, kind)), None)
    return list(values) if read is None else [got for v in values if (got := read(v)) is not None]


def in_values(df: DataFrame, column: str, values: list) -> Column:
    """Whether a column holds one of the values, brought to its type; none fits: false."""
    fit = compatible(values, df.schema[column].dataType)
    return F.col(column).isin(*fit) if fit else F.lit(False)


@dataclass
class Processor:
    """What all kinds share: filter, dimensions, the calendar columns of the grain and coarser ones, states."""

    group_by: list[str]
    states: list[State]
    time: str | None = None
    calendar: list[str] = field(default_factory=lambda: ["Day", "Month", "Quarter", "Year"])
    where: Column | None = None

    def rows(self, df: DataFrame) -> DataFrame:
        df = df if self.where is None else df.where(self.where)
        return df.withColumns({c: calendar_column(c, F.col(self.time)) for c in self.calendar if c not in df.columns}) if self.time else df

    @property
    def keys(self) -> list[str]:
        return [*self.group_by, *(self.calendar if self.time else [])]

    def build(self, df: DataFrame) -> DataFrame:
        return S.build(self.rows(df), self.keys, self.states)

    def merge(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return S.merge(df, keys, self.states)

    def compact(self, df: DataFrame, grain: str) -> DataFrame:
        """Partials, re-keyed and merged at a grain."""
        column = TIME_COLUMN.get(grain)
        return self.merge(df, [*self.group_by, *([column] if column else [])])


@dataclass
class BinaryOutcome(Processor):
    """Rows with a configured outcome only, flagged positive (1) or negative (0) in `flag`; dedup lets a success beat a non-success."""

    outcome: str = "Outcome"
    positive: list = field(default_factory=list)
    negative: list = field(default_factory=list)
    dedup_keys: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    variant: str | None = None

    def rows(self, df: DataFrame) -> DataFrame:
        df = super().rows(df)
        pos, neg = in_values(df, self.outcome, self.positive), in_values(df, self.outcome, self.negative)
        df = df.where(pos | neg).withColumn("flag", pos.cast("int"))
        if self.dedup_keys:
            by = [F.desc("flag"), *[F.col(c) for c in self.order]]
            df = df.withColumn("_n", F.row_number().over(W.partitionBy(*self.dedup_keys).orderBy(*by))).where("_n = 1").drop("_n")
        return df

    @property
    def keys(self) -> list[str]:
        return [*self.group_by, *([self.variant] if self.variant else []), *(self.calendar if self.time else [])]

    @staticmethod
    def outcome_states(where: Column | None = None) -> list[State]:
        """Count, Positives and Negatives."""
        pos, neg = F.col("flag") == 1, F.col("flag") == 0
        given = lambda c: c if where is None else c & where
        return [State("Count", "count", where=where), State("Positives", "count", where=given(pos)), State("Negatives", "count", where=given(neg))]


def numeric_states(name: str, sketch: str = "tdigest", where: Column | None = None) -> list[State]:
    """Count, sum, mean, variance, extremes and a quantile sketch of a property; pooled ones ignore `where`."""
    return [
        State(f"{name}_Count", "count", name, where), State(f"{name}_Sum", "value_sum", name, where), State(f"{name}_Mean", "pooled_mean", name, weight=f"{name}_Count"),
        State(f"{name}_Var", "pooled_variance", name, mean=f"{name}_Mean", weight=f"{name}_Count"), State(f"{name}_Min", "min", name, where), State(f"{name}_Max", "max", name, where), State(f"{name}_Digest", sketch, name, where),
    ]


@dataclass
class ScoreDistribution(BinaryOutcome):
    """Binary outcomes with a score digest for each outcome; groups without a positive are dropped."""

    score: str = "Propensity"

    def build(self, df: DataFrame) -> DataFrame:
        pos, neg = F.col("flag") == 1, F.col("flag") == 0
        self.states = [*self.outcome_states(), State("PositiveScores", "tdigest", self.score, pos), State("NegativeScores", "tdigest", self.score, neg)]
        return super().build(df).where("Positives > 0")


@dataclass
class EntityLifecycle(Processor):
    """Per customer, Year (text) and Quarter: holdings, value, first and last purchase; period is the month of the last."""

    customer: str = "CustomerID"
    order: str = "OrderID"
    monetary: str = "Amount"
    date: str = "PurchaseDate"
    lifespan_years: int | None = None

    def build(self, df: DataFrame) -> DataFrame:
        df = df if self.where is None else df.where(self.where)
        day = F.to_date(self.date)
        if self.lifespan_years:
            df = df.where(day >= F.date_sub(F.current_date(), 365 * self.lifespan_years))
        df = df.withColumns({"Year": F.year(day).cast("string"), "Quarter": calendar_column("Quarter", day), "_day": day})
        self.states = self.lifecycle_states()
        got = S.build(df, [*self.group_by, self.customer, "Year", "Quarter"], self.states)
        return got.withColumn("period", F.date_format("MaxPurchasedDate", "yyyy-MM"))

    def lifecycle_states(self) -> list[State]:
        return [State("unique_holdings", "count", self.order, distinct=True), State("lifetime_value", "value_sum", self.monetary), State("MinPurchasedDate", "min", "_day"), State("MaxPurchasedDate", "max", "_day")]

    def merge(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return S.merge(df, keys, self.lifecycle_states())


@dataclass
class Funnel(Processor):
    """Independent conditions, each a stage: how many rows are in it, and a sketch of the entities in it."""

    stages: dict[str, Column | str] = field(default_factory=dict)
    entity: str | None = None
    sketch: str = "theta"

    def build(self, df: DataFrame) -> DataFrame:
        self.states = self.stage_states()
        return super().build(df)

    def stage_states(self) -> list[State]:
        out = [State(f"{n}_Count", "count", where=c) for n, c in self.stages.items()]
        return out + ([State(f"{n}_Entities", self.sketch, self.entity, c) for n, c in self.stages.items()] if self.entity else [])


@dataclass
class Snapshot(Processor):
    """Stock figures by the date they hold for. periodic: dims by as_of; accumulating: each entity's last row by its latest milestone."""

    as_of: str | None = None
    entity: str | None = None
    milestones: list[str] = field(default_factory=list)
    tie_order: list[str] = field(default_factory=list)

    def with_as_of(self, df: DataFrame) -> DataFrame:
        if self.milestones:
            return df.withColumn("as_of", F.greatest(*[F.to_date(m) for m in self.milestones]) if len(self.milestones) > 1 else F.to_date(self.milestones[0]))
        name = self.as_of or next((c for c in ("as_of_date", "Day", "day") if c in df.columns), None)
        return df.withColumn("as_of", F.to_date(name) if name else F.current_date())

    def build(self, df: DataFrame) -> DataFrame:
        df = self.with_as_of(df if self.where is None else df.where(self.where))
        return S.build(df, [*self.group_by, "as_of"], self.states)

    def latest_in_period(self, built: DataFrame, grain: str) -> DataFrame:
        """Of each dims and period only the rows of its latest date."""
        period = calendar_column(TIME_COLUMN[grain], F.col("as_of"))
        return self.latest(built.withColumn(TIME_COLUMN[grain], period), [*self.group_by, TIME_COLUMN[grain]])

    @staticmethod
    def latest(df: DataFrame, keys: list[str]) -> DataFrame:
        if not keys:
            return df.crossJoin(F.broadcast(df.agg(F.max("as_of").alias("_last")))).where("as_of = _last").drop("_last")
        return df.withColumn("_last", F.max("as_of").over(W.partitionBy(*keys))).where("as_of = _last").drop("_last")

    def merge_latest(self, built: DataFrame, keys: list[str]) -> DataFrame:
        """Stocks don't add up over time: a key's latest date only, summed over the rest."""
        return S.merge(self.latest(built, keys), keys, self.states)

    def last_rows(self, df: DataFrame, created: str | None = None) -> DataFrame:
        """The last row of each entity by as_of, then by creation, then by tie_order."""
        df = self.with_as_of(df)
        by = [F.desc_nulls_last("as_of"), *([F.desc(created)] if created else []), *[F.desc(c) for c in self.tie_order]]
        return df.withColumn("_n", F.row_number().over(W.partitionBy(self.entity).orderBy(*by))).where("_n = 1").drop("_n")


def customer_sample(df: DataFrame, column: str, fraction: float) -> DataFrame:
    """Whole customers, by the first 48 bits of the SHA-256 of the id as text; the fraction is a multiple of one millionth. Rows without an id are no customer's."""
    threshold = round(fraction * 1_000_000)
    if abs(threshold - fraction * 1_000_000) > 1e-9 or not 0 < threshold <= 1_000_000:
        raise ValueError("the fraction must be a multiple of 0.000001, above 0 and at most 1")
    drawn = F.conv(F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 12), 16, 10).cast("long")
    return df.where(drawn % 1_000_000 < threshold)


def personalization(df: DataFrame, keys: list[str], customer: str, action: str) -> DataFrame:
    """Per key: 1 less the mean cosine between customers' action counts, from sums per action and not from pairs."""
    n = df.where(F.col(customer).isNotNull() & F.col(action).isNotNull()).groupBy(*keys, customer, action).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = W.partitionBy(*keys, customer)
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(one))
    first = F.row_number().over(one.orderBy(action)) == 1  # a row a customer counts it
    by_action = n.withColumns({"v": F.col("n") / norm, "first": first.cast("double")}).groupBy(*keys, action).agg(F.sum("v").alias("s"), F.sum("first").alias("c"))
    sums = by_action.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("c").alias("m"))
    m = F.col("m")
    value = F.when(m <= 1, 0.0).otherwise(F.least(F.greatest(1 - F.try_divide(F.col("ss") - m, m * (m - 1)), F.lit(0.0)), F.lit(1.0)))
    return sums.where("m > 0").select(*keys, value.alias("personalization")) if keys else sums.select(F.when(F.coalesce(m, F.lit(0.0)) == 0, 0.0).otherwise(value).alias("personalization"))


def novelty(df: DataFrame, keys: list[str], customer: str, interaction: str, action: str) -> DataFrame:
    """Per key: the self-information of what was shown, per user and slot."""
    counts = df.groupBy(*keys, action).agg(F.count(F.lit(1)).alias("n"))
    users = df.groupBy(*keys).agg(F.count_distinct(customer).alias("users"))
    slots = df.groupBy(*keys, interaction).agg(F.count(F.lit(1)).alias("k")).groupBy(*keys).agg(F.max("k").alias("slots"))
    joined = counts.join(users, keys).join(slots, keys)
    info = F.sum(F.col("n") * -(F.log2(F.col("n") / F.when(F.col("users") > 0, F.col("users"))) + 1e-10))
    per = F.max(F.col("users") * F.col("slots"))
    return joined.groupBy(*keys).agg(F.when(per > 0, info / per).otherwise(0.0).alias("novelty"))


def source_order_slice(df: DataFrame, order: list[str]) -> DataFrame:
    """A sampling operator: a stretch of rows in the given order. All of fewer than 50 000 rows; from the middle (half, to even) on, all of fewer than 100 000; else 50 000 from there.

    Recipes don't call it; who wants whole tables leaves it out.
    """
    n = df.count()
    if n < 50_000:
        return df
    first, size = (round(n / 2), n) if n < 100_000 else (round(n / 2), 50_000)
    ranked = numbered(df, [F.col(c) for c in order], "_n").withColumn("_n", F.col("_n") - 1)
    return ranked.where((F.col("_n") >= first) & (F.col("_n") < first + size)).drop("_n")
