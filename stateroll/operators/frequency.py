"""Exposure frequency: how often a customer had seen an action at a placement before a response.

Rows are shuffled by contact, by (customer, action, placement) and by (customer, interaction): all finer than a customer,
so that one who holds much of the table is many tasks' work. The number of exposures in a window needs no as-of join: it
is a rank less a range-frame count. A null alternative group equals a null alternative group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTACT = ["customer", "interaction", "action", "placement", "rank"]


@dataclass
class FrequencyResponse:
    """Column names of the source, outcome values, and the window. order: columns that settle the row order of a contact."""

    customer: str
    interaction: str
    action: str
    placement: str
    rank: str
    outcome: str
    time: str
    positive: list
    exposure: list
    candidate: list = field(default_factory=list)
    propensity: str | None = None
    priority: str | None = None
    order: list[str] = field(default_factory=list)
    alternatives: list[str] = field(default_factory=list)
    window_hours: int = 168
    max_frequency: int = 7
    dims: list[str] = field(default_factory=list)

    def events(self, df: DataFrame) -> DataFrame:
        """Rows that matter, under fixed names, times in whole seconds."""
        own = {"customer": self.customer, "interaction": self.interaction, "action": self.action, "placement": self.placement, "rank": self.rank}
        positive = F.col(self.outcome).isin(*self.positive)
        exposed = positive | F.col(self.outcome).isin(*self.exposure)
        known = exposed | F.col(self.outcome).isin(*self.candidate) if self.candidate else exposed
        number = lambda c: F.col(c).cast("double") if c else F.lit(None).cast("double")
        out = df.where(known).select(
            *[F.col(v).alias(k) for k, v in own.items()], F.unix_timestamp(F.col(self.time).cast("timestamp")).alias("s"), positive.alias("positive"), exposed.alias("exposed"),
            number(self.propensity).alias("propensity"), number(self.priority).alias("priority"), F.struct(*[F.col(c) for c in self.order] or [F.lit(0)]).alias("ord"),
            *[F.col(d).alias(f"d_{d}") for d in self.dims], *[F.col(a).alias(f"a_{a}") for a in self.alternatives],
            *([F.col("seen_current")] if "seen_current" in df.columns else [F.lit(True).alias("seen_current")]),
        )
        return out.where(" AND ".join(f"{c} IS NOT NULL" for c in [*CONTACT, "s"]))

    def contacts(self, events: DataFrame) -> DataFrame:
        """One row a contact: earliest time, any flag, and other values from its most telling row."""
        first = [F.desc("positive"), F.desc("exposed"), F.desc("seen_current"), F.col("s"), F.col("ord")]
        w = W.partitionBy(*CONTACT).orderBy(*first).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        carried = [c for c in events.columns if c.startswith(("d_", "a_"))]
        picked = events.select(
            *CONTACT, "s", "positive", "exposed", "seen_current", "ord", *[F.first(c).over(w).alias(c) for c in carried],
            F.first("propensity", ignorenulls=True).over(w).alias("propensity"), F.first("priority", ignorenulls=True).over(w).alias("priority"),
        )
        return picked.groupBy(*CONTACT).agg(
            F.min("s").alias("s"), F.bool_or("positive").alias("positive"), F.bool_or("exposed").alias("exposed"), F.bool_or("seen_current").alias("seen_current"), F.bool_or(~F.col("seen_current")).alias("seen_history"),
            F.min("ord").alias("ord"), *[F.first(c).alias(c) for c in [*carried, "propensity", "priority"]],
        )

    def frequencies(self, contacts: DataFrame) -> DataFrame:
        """Exposed first-rank contacts with `frequency`: how many of the same customer, action and placement lie in (time - window, time], itself the last, capped."""
        key = ["customer", "action", "placement"]
        seq = F.row_number().over(W.partitionBy(*key).orderBy("s", "interaction", "ord"))
        old = F.count(F.lit(1)).over(W.partitionBy(*key).orderBy("s").rangeBetween(W.unboundedPreceding, -self.window_hours * 3600))
        return contacts.where("exposed AND rank = 1").withColumn("frequency", F.least(seq - old, F.lit(self.max_frequency)).cast("int"))

    def daily_frequencies(self, contacts: DataFrame) -> DataFrame:
        """The same by days: the place within its own day, and all exposures of the window's earlier days."""
        key = ["customer", "action", "placement"]
        days = max(1, math.ceil(self.window_hours / 24))
        rows = contacts.where("exposed AND rank = 1").withColumn("day_no", F.floor(F.col("s") / 86400))
        seq = F.row_number().over(W.partitionBy(*key, "day_no").orderBy("s", "interaction", "ord"))
        before = F.count(F.lit(1)).over(W.partitionBy(*key).orderBy("day_no").rangeBetween(-(days - 1), -1)) if days > 1 else F.lit(0)
        return rows.withColumn("frequency", F.least(seq + before, F.lit(self.max_frequency)).cast("int"))

    def runners(self, contacts: DataFrame) -> DataFrame:
        """The best contact of a lower rank for each customer, interaction and alternative group: rank 2, else the smallest."""
        group = ["customer", "interaction", *[f"a_{a}" for a in self.alternatives]]
        by = [F.desc(F.col("rank") == 2), F.col("rank"), F.col("action"), F.col("placement"), F.col("s"), F.col("ord")]
        rows = contacts.where("rank > 1 AND seen_current").withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*by))).where("_n = 1")
        return rows.select(*[F.col(g).alias(f"r_{g}") for g in group], F.col("propensity").alias("r_propensity"), F.col("priority").alias("r_priority"))

    def responses(self, df: DataFrame, daily: bool = False) -> DataFrame:
        """Focal contacts with their frequency, runner-up and derived flags."""
        return self.responses_of(self.contacts(self.events(df)), daily)

    def responses_of(self, contacts: DataFrame, daily: bool = False) -> DataFrame:
        focal = (self.daily_frequencies if daily else self.frequencies)(contacts).where("seen_current AND NOT seen_history")
        runner = self.runners(contacts)
        group = ["customer", "interaction", *[f"a_{a}" for a in self.alternatives]]
        joined = focal.join(runner, [F.col(g).eqNullSafe(F.col(f"r_{g}")) for g in group], "left")
        there = F.col("r_customer").isNotNull() & F.col("r_propensity").isNotNull()
        both = there & F.col("priority").isNotNull() & F.col("r_priority").isNotNull()
        return joined.select(
            *CONTACT, "s", "frequency", *[F.col(f"d_{d}").alias(d) for d in self.dims], F.to_date(F.timestamp_seconds("s")).alias("Day"), F.col("positive").alias("clicked"), there.alias("comparable"),
            (there & F.col("positive")).alias("comparable_click"), F.col("r_customer").isNotNull().alias("runner_available"), F.when(there, F.col("r_propensity")).alias("runner_propensity"),
            both.alias("priority_comparable"), F.when(both, F.col("priority")).alias("focal_priority"), F.when(both, F.col("r_priority")).alias("runner_priority"),
        )

    def build(self, df: DataFrame, daily: bool = False, keys: list[str] | None = None) -> DataFrame:
        return self.summed(self.responses(df, daily), keys)

    def summed(self, responses: DataFrame, keys: list[str] | None = None) -> DataFrame:
        total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
        keys = [*self.dims, "frequency", "Day"] if keys is None else keys
        return responses.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("Contacts"), F.count_if("clicked").alias("Clicks"), F.count_if("comparable").alias("Comparable"), F.count_if("comparable_click").alias("ComparableClicks"),
            total("runner_propensity").alias("RunnerPropensity"), F.count_if("priority_comparable").alias("PriorityComparable"), total("focal_priority").alias("FocalPriority"), total("runner_priority").alias("RunnerPriority"),
        )


def lookback_days(window_hours: int, lag_hours: int = 0) -> int:
    return math.ceil((window_hours + lag_hours) / 24)


def with_history(current: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of the current chunk and of earlier ones, told apart by seen_current."""
    return current.withColumn("seen_current", F.lit(True)).unionByName(history.withColumn("seen_current", F.lit(False)), allowMissingColumns=True)


def asof_join(left: DataFrame, right: DataFrame, on: list[str], time: str, values: list[str], bucket: Column | None = None) -> DataFrame:
    """Each left row with the values of the right row of its key with the greatest time at or before its own; no pairs.

    bucket: a coarser time, such as the day, that never falls as time goes on. With it a key's rows are dealt by bucket,
    so that a key which holds much of the table is many tasks' work; the last values of earlier buckets, a row a key and
    bucket, are carried over. Without it a key is one task's.
    """
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(*on, time, F.struct(*values).alias("_value")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("_bucket", F.lit(0) if bucket is None else bucket)
    own = [*on, "_bucket"]
    w = W.partitionBy(*own).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("_found", F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    if bucket is not None:
        last = both.groupBy(*own).agg(F.max_by("_value", F.when(F.col("_side") == 0, F.col(time))).alias("_last"))
        before = W.partitionBy(*on).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        carried = last.select(*[F.col(k).alias(f"_c{n}") for n, k in enumerate(own)], F.last("_last", ignorenulls=True).over(before).alias("_carried"))
        found = found.join(carried, [F.col(k).eqNullSafe(F.col(f"_c{n}")) for n, k in enumerate(own)], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, on: list[str], low: Column, high: Column, point: Column, how: str = "inner", width: float | None = None) -> DataFrame:
    """Equality on `on`, and right's point within [low, high] of left; how: inner or left.

    width: a length that no interval exceeds, of numbers. With it both sides are dealt by bins of that width as well: an interval
    goes to the bin in which it begins, a point to its own bin and to the one before, so that each pair meets once, a key
    that holds much of the table is as many tasks' work as it has bins, and only rows of neighbouring bins are compared. An
    interval that is longer all the same is joined without bins, so that none loses a pair. Without a width a key is one task's.
    """
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c) == F.col(f"_r_{c}") for c in on]
    drop = [f"_r_{c}" for c in on]
    if width is None:
        return left.join(renamed, [*same, point.between(low, high)], how).drop(*drop)
    if not width > 0:
        raise ValueError("the width must be above 0")
    number = lambda c: F.floor(c.cast("double") / width).cast("long")
    long = F.coalesce(high.cast("double") - low.cast("double") > width, F.lit(False))
    dealt = left.withColumns({"_long": long, "_bin": number(low)})
    own = number(point)
    points = renamed.withColumn("_rbin", F.explode(F.array(own, own - 1)))
    near = dealt.where("NOT _long").join(points, [*same, F.col("_bin") == F.col("_rbin"), point.between(low, high)], how)
    far = dealt.where("_long").join(renamed.withColumn("_rbin", F.lit(None).cast("long")), [*same, point.between(low, high)], how)
    return near.unionByName(far).drop(*drop, "_long", "_bin", "_rbin")
