"""Scalar expressions with pinned edge cases, as functions that build Columns.

Spark's own functions are used as they are where their semantics fit; what is here fixes nulls, zero denominators,
rounding and date units. Names of dtypes are those of DTYPES.
"""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DTYPES = {
    "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "Float32": "float", "Float64": "double",
    "String": "string", "Date": "date", "Datetime": "timestamp_ntz", "Boolean": "boolean",
}
#: strftime codes and the pattern letters that Spark has for them.
PATTERNS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "I": "hh", "f": "SSSSSS", "Z": "z", "z": "xx", "3f": "SSS"}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def param(params: dict, name: str) -> Column:
    if name not in params:
        raise KeyError(f"parameter {name!r} has no value")
    return F.lit(params[name])


def raw(text: str) -> Column:
    return F.expr(text)


def all_of(*args: Column) -> Column:
    return reduce(lambda a, b: a & b, args)


def any_of(*args: Column) -> Column:
    return reduce(lambda a, b: a | b, args)


def negated(x: Column) -> Column:
    return ~x


def add(*args: Column) -> Column:
    return reduce(lambda a, b: a + b, args)


def sub(*args: Column) -> Column:
    return reduce(lambda a, b: a - b, args)


def mul(*args: Column) -> Column:
    return reduce(lambda a, b: a * b, args)


def div(*args: Column) -> Column:
    """True division from left to right, as IEEE has it: x/0 is an infinity, 0/0 is NaN."""

    def one(a: Column, b: Column) -> Column:
        a, b = a.cast("double"), b.cast("double")
        zero = F.when(a.isNull(), F.lit(None)).when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return F.when(b == 0, zero).otherwise(F.try_divide(a, b))

    return reduce(one, args)


def safe_div(num: Column | str, den: Column | str) -> Column:
    """0.0 where the denominator is zero; null where either is null."""
    n, d = _col(num), _col(den)
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(n.cast("double"), d.cast("double")))


def neg(x: Column) -> Column:
    return -x


def ceil(x: Column, dtype: str = "double") -> Column:
    return F.ceil(x).cast(dtype)


def floor(x: Column, dtype: str = "double") -> Column:
    return F.floor(x).cast(dtype)


def log(x: Column, base: float | None = None) -> Column:
    return F.ln(x) if base is None else F.log(float(base), x)


def rounded(x: Column, ndigits: int = 0) -> Column:
    """Half away from zero."""
    return F.round(x, ndigits)


def cast(x: Column, dtype: str) -> Column:
    """Strict: a value that doesn't fit fails the query."""
    return x.cast(DTYPES[dtype])


def concat(args: list[Column], sep: str = "") -> Column:
    """Null if any part is null."""
    parts = [args[0], *(y for x in args[1:] for y in (F.lit(sep), x))] if sep else args
    return F.concat(*[p.cast("string") for p in parts])


def is_in(x: Column, values: list) -> Column:
    return x.isin(*values)


def not_in(x: Column, values: list) -> Column:
    return ~x.isin(*values)


def matches(x: Column, pattern: str) -> Column:
    """Whether the pattern occurs anywhere."""
    return x.rlike(pattern)


def case(branches: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F.when(*branches[0])
    for when, then in branches[1:]:
        out = out.when(when, then)
    return out.otherwise(otherwise)


def date_trunc(x: Column, unit: str) -> Column:
    """day, month, quarter, year, hour or week_iso (weeks begin on Monday); a timestamp for hour, else a date."""
    if unit == "hour":
        return F.date_trunc("hour", x)
    return F.trunc(x, {"week_iso": "week", "day": "day"}.get(unit, unit)) if unit != "day" else F.to_date(x)


def date_diff(start: Column, end: Column, unit: str) -> Column:
    """Whole units from start to end, towards zero; a month is 30 days and a year 365, rounded down."""
    of = lambda u: F.timestamp_diff(u, start.cast("timestamp"), end.cast("timestamp"))
    if unit in ("months", "years"):
        return F.floor(of("DAY") / {"months": 30, "years": 365}[unit]).cast("bigint")
    return of({"seconds": "SECOND", "minutes": "MINUTE", "hours": "HOUR", "days": "DAY"}[unit])


def date_part(x: Column, part: str) -> Column:
    """year, month, day, quarter, hour or weekday (Monday 1 to Sunday 7)."""
    of = {"year": F.year, "month": F.month, "day": F.dayofmonth, "quarter": F.quarter, "hour": F.hour, "weekday": lambda c: F.weekday(c) + 1}
    return of[part](x)


def now() -> Column:
    """The moment this expression is built, in UTC."""
    return F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp_ntz")


def pattern(fmt: str) -> str:
    """A strftime format as Spark's pattern."""
    out, k = "", 0
    quoted = lambda s: "'" + s.replace("'", "''") + "'" if s.isalpha() or s == "'" else s
    while k < len(fmt):
        if fmt[k] != "%":
            out += quoted(fmt[k])
            k += 1
        elif fmt[k + 1] == "%":
            out += "%"
            k += 2
        else:
            code = next(c for c in (fmt[k + 1 : k + 3], fmt[k + 1 : k + 2]) if c in PATTERNS)
            out += PATTERNS[code]
            k += 1 + len(code)
    return out.replace("''", "") if "%%" not in fmt else out


def strftime(x: Column, fmt: str) -> Column:
    return F.date_format(x, pattern(fmt))


def strptime(x: Column, fmt: str) -> Column:
    """Strict: a text that doesn't fit fails the query."""
    return F.to_timestamp(x, pattern(fmt))
