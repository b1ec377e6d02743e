"""Calendar columns, grains and period labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grains from fine to coarse.
GRAINS = ["hourly", "daily", "weekly", "monthly", "quarterly", "yearly", "summary"]
# Other names of grains.
ALIASES = {"hour": "hourly", "day": "daily", "week": "weekly", "month": "monthly", "quarter": "quarterly", "year": "yearly", "all": "summary", "all_time": "summary", "all-time": "summary"}
#: The time column that a grain groups by, and the columns that a stored level keeps.
TIME_COLUMN = {"hourly": "Hour", "daily": "Day", "weekly": "Week", "monthly": "Month", "quarterly": "Quarter", "yearly": "Year"}
LEVEL_COLUMNS = {"hourly": ["Hour", "Day", "Month"], "daily": ["Day", "Month"], "weekly": ["Week", "Month"], "monthly": ["Month"], "quarterly": ["Quarter", "Year"], "yearly": ["Year"], "summary": []}
DEFAULT_OUTPUTS = ["Day", "Week", "Month", "Quarter", "Year"]


def grain(name: str) -> str:
    """A grain by any of its names, whatever its case, blanks around it, or blanks for `_`."""
    asked = name.strip().lower().replace(" ", "_")
    out = ALIASES.get(asked, asked)
    if out not in GRAINS:
        raise ValueError(f"unknown grain {name!r}")
    return out


def calendar_column(name: str, t: Column) -> Column:
    return {
        "Day": lambda: F.to_date(t),
        "Hour": lambda: F.date_format(t, "yyyy-MM-dd'T'HH"),
        "Month": lambda: F.date_format(t, "yyyy-MM"),
        "Year": lambda: F.year(t).cast("smallint"),
        "Quarter": lambda: F.concat(F.year(t).cast("string"), F.lit("_Q"), F.quarter(t).cast("string")),
        "Week": lambda: F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0")),
    }.get(name, lambda: F.date_format(t, "yyyy-MM-dd"))()


def nearest_second(t: Column | str) -> Column:
    """Whole seconds of the epoch, rounded: halves to the even second."""
    t = F.col(t) if isinstance(t, str) else t
    whole, part = F.unix_timestamp(t), F.extract(F.lit("SECOND"), t) % 1
    return whole + F.when(part > 0.5, 1).when(part == 0.5, F.pmod(whole, F.lit(2))).otherwise(0)


def derive_calendar(df: DataFrame, source: str, outputs: list[str] | None = None) -> DataFrame:
    return df.withColumns({o: calendar_column(o, F.col(source)) for o in outputs or DEFAULT_OUTPUTS})


def with_coarser(df: DataFrame) -> DataFrame:
    """Month, Week, Quarter and Year from Day where they are missing; Quarter and Year from a Month label."""
    add: dict[str, Column] = {}
    if "Day" in df.columns:
        day = F.col("Day").cast("date")
        add = {c: calendar_column(c, day) for c in ("Month", "Week", "Quarter", "Year") if c not in df.columns}
    elif "Month" in df.columns:
        year, month = F.substring("Month", 1, 4), F.substring("Month", 6, 2).cast("int")
        add = {"Year": year.cast("smallint"), "Quarter": F.concat(year, F.lit("_Q"), F.ceil(month / 3).cast("string"))}
        add = {k: v for k, v in add.items() if k not in df.columns}
    return df.withColumns(add) if add else df


def period_label(level: str) -> Column:
    """What a row's partition is called: its month if daily or weekly, its day if hourly, else its own label; ALL without time."""
    return {
        "hourly": F.col("Day").cast("string"), "daily": F.date_format("Day", "yyyy-MM"), "weekly": F.col("Week"), "monthly": F.col("Month"),
        "quarterly": F.col("Quarter"), "yearly": F.col("Year").cast("string"), "summary": F.lit("ALL"),
    }[level]


def stored_level(levels: list[str], wanted: str) -> str:
    """The coarsest stored grain that the wanted one can be rolled up from. Weeks roll up to nothing but all time."""
    fine = [g for g in levels if GRAINS.index(g) <= GRAINS.index(wanted) and (g != "weekly" or wanted in ("weekly", "summary"))]
    if not fine:
        raise ValueError(f"no stored grain is as fine as {wanted}")
    return max(fine, key=GRAINS.index)


def exposed(df: DataFrame, level: str) -> DataFrame:
    """day as Day, and period as the label that the level has."""
    renames = {"day": "Day"} if "day" in df.columns and "Day" not in df.columns else {}
    label = {"monthly": "Month", "quarterly": "Quarter", "yearly": "Year"}.get(level)
    if label and "period" in df.columns and label not in df.columns:
        renames["period"] = label
    return with_coarser(df.withColumnsRenamed(renames))


def multi_grain(df: DataFrame, dims: list[str], states: dict[str, Column], grains: list[str]) -> DataFrame:
    """The same exact states at several grains in one pass; `grain` says which a row belongs to."""
    times = [TIME_COLUMN[g] for g in grains if g != "summary"]
    sets = [[*dims, *([TIME_COLUMN[g]] if g != "summary" else [])] for g in grains]
    got = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*dims, *times]]).agg(F.grouping_id().alias("_g"), *[v.alias(k) for k, v in states.items()])
    every = [*dims, *times]
    name = None
    for g, s in zip(grains, sets, strict=True):
        mask = sum(1 << (len(every) - 1 - k) for k, c in enumerate(every) if c not in s)
        name = F.when(F.col("_g") == mask, g) if name is None else name.when(F.col("_g") == mask, g)
    return got.withColumn("grain", name).drop("_g")
