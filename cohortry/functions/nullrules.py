"""Column helpers with R's rules for missing values.

Each returns a plain Column of built-in functions, so plans stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def n_distinct(c, count_null: bool = True) -> Column:
    """Distinct count in which a missing value counts as one more value."""
    c = column(c)
    if not count_null:
        return F.count_distinct(c)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def n_distinct_where(condition: Column, c, count_null: bool = True) -> Column:
    """``n_distinct(c)`` over the rows that satisfy ``condition``."""
    c, condition = column(c), F.coalesce(condition, F.lit(False))
    seen = F.count_distinct(F.when(condition, c))
    if not count_null:
        return seen
    return seen + F.coalesce(F.max((condition & c.isNull()).cast("int")), F.lit(0))


def strict_mean(c) -> Column:
    """Mean that is missing as soon as one value is missing."""
    c = column(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.avg(c))


def paste0(*cols) -> Column:
    """Concatenate, printing missing values as ``NA``."""
    return F.concat(*[F.coalesce(column(c).cast("string"), F.lit("NA")) for c in cols])


def str_c(*cols) -> Column:
    """Concatenate; missing if any part is missing."""
    return F.concat(*[column(c).cast("string") for c in cols])


def in_set(c, values) -> Column:
    """Membership that is never missing."""
    values = list(values)
    if not values:
        return F.lit(False)
    known = [v for v in values if v is not None]
    hit = F.coalesce(column(c).isin(known), F.lit(False)) if known else F.lit(False)
    return hit | column(c).isNull() if len(known) < len(values) else hit


def matches(c, pattern: str) -> Column:
    """Regular-expression test; missing text does not match."""
    return F.coalesce(column(c).rlike(pattern), F.lit(False))


def contains_text(c, text: str) -> Column:
    return F.coalesce(column(c).contains(text), F.lit(False))


def divide(a, b) -> Column:
    return F.try_divide(column(a).cast("double"), column(b).cast("double"))


def as_number(c) -> Column:
    """Text to double; anything unreadable becomes missing."""
    return column(c).try_cast("double")


def log10_positive(c) -> Column:
    c = column(c)
    return F.when(c > 0, F.log10(c))


def log2_positive(c) -> Column:
    c = column(c)
    return F.when(c > 0, F.log2(c))
