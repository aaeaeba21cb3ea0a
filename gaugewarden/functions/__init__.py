"""Column functions shared by the operators."""

import math

from pyspark.sql import Column, functions as F


def period_label(day: Column, years: int = 3, first_year: int = 2010) -> Column:
    """``2010-2012`` style label of the period a day falls in."""
    start = (F.floor((F.year(day) - first_year) / years) * years + first_year).cast("int")
    return F.concat_ws("-", start, start + years - 1)


def seasonal(day: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year, on a circle of 366 days in every year."""
    angle = F.lit(2 * math.pi) * F.dayofyear(day) / 366
    return F.sin(angle), F.cos(angle)


def flag(condition: Column) -> Column:
    """0/1 flag where an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def row_sum(cols: list[str]) -> Column:
    """Sum across columns that skips nulls."""
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return total


def round_to_day(ts: Column) -> Column:
    """Nearest day: from noon on, the next one."""
    return F.to_date(ts + F.expr("INTERVAL 12 HOURS"))


def day_part(text: Column) -> Column:
    """The date in a ``day hour`` text."""
    return F.to_date(F.split(text, " ").getItem(0))


def name_prefix(text: Column) -> Column:
    """The part of a column name before the first underscore."""
    return F.substring_index(text, "_", 1)


def hash_order(seed: int, *cols: str) -> Column:
    """A reproducible pseudo-random order of keys, the same in any engine with MD5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def quick_round(col: str, places: int) -> Column:
    """``round`` with the same result, without a decimal number per row unless the value is large or close to a tie."""
    scaled = F.col(col) * 10.0**places
    clear = (F.abs(scaled) < 1e12) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)  # errors of the product are under 1e-3
    return F.when(clear, F.floor(scaled + 0.5) / 10.0**places).otherwise(F.round(col, places))


def safe_ratio(num: Column, den: Column) -> Column:
    """Ratio that is 0 when nothing is counted in the denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.nullif(den, F.lit(0)))
