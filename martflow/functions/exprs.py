"""Column-expression helpers shared by every builder.

Everything here returns a ``Column`` made of built-in functions, so it
stays inside whole-stage codegen; nothing is evaluated eagerly.

Money is handled as integer cents wherever it is summed or averaged:
integer sums are exact and independent of partitioning and task order,
so the same query gives the same bits on 8 cores or 8,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Col = Column | str


def c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cents(x: Col) -> Column:
    """Money value (2 decimals, stored as double) -> exact long cents."""
    return F.round(c(x) * 100).cast("long")


def from_cents(x: Col) -> Column:
    """Long cents -> double money value (nearest double to the exact amount)."""
    return c(x) / F.lit(100.0)


def money_sum(x: Col) -> Column:
    """Exact sum of a money column (null when there are no rows)."""
    return from_cents(F.sum(cents(x)))


def money_avg(x: Col) -> Column:
    """Exact average of a money column: sum of cents / count / 100."""
    return F.sum(cents(x)) / F.count(c(x)) / F.lit(100.0)


def ratio(num: Col, den: Col, scale: int, guard: Col | None = None) -> Column:
    """round(num / den, scale) when den > 0, else NULL (guarded, ANSI safe)."""
    cond = (c(den) > 0) if guard is None else c(guard)
    return F.when(cond, F.round(c(num) / c(den), scale))


def count_if(cond: Column) -> Column:
    """sum(CASE WHEN cond THEN 1 ELSE 0 END) as a bigint (0 on no match)."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def days(ts_end: Col, ts_start: Col) -> Column:
    return F.datediff(c(ts_end), c(ts_start))


def add_days(ts: Col, n: Col | int) -> Column:
    """timestamp_ntz + n days (n may be a column)."""
    n_col = F.lit(n) if isinstance(n, int) else c(n)
    return c(ts) + F.make_dt_interval(days=n_col.cast("int"))


def month_start(ts: Col) -> Column:
    """First instant of the month, kept as timestamp_ntz (date_trunc returns LTZ)."""
    return F.date_trunc("month", c(ts)).cast("timestamp_ntz")


def ntz(literal: str) -> Column:
    """A timestamp_ntz literal from 'YYYY-MM-DD[ HH:MM:SS]'."""
    return F.to_timestamp_ntz(F.lit(literal))


def side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row tables as one row: the columns of the others as scalar
    subqueries of the first (no join)."""
    out = first
    for other in others:
        row = other.select(F.struct(*other.columns).alias("_row")).scalar()
        out = out.select("*", *[row[name].alias(name) for name in other.columns])
    return out
