from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; its doubles are rounded like the SQL's."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


#: Columns of probabilities, and how names of others end; their small values keep their digits.
PROBABILITIES, ENDING = ("p_value", "p_adj"), "_p"
SMALL = 1e-3


def tidy(df: DataFrame) -> DataFrame:
    """Six decimals, and six significant digits for probabilities below ``SMALL``.

    The nudge keeps a sum that is exactly between two roundings, but for its last bit, from
    rounding differently on two engines.
    """
    def tidied(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return value
        plain = F.round(value + F.lit(1e-10), 6) + F.lit(0.0)
        if field.name in PROBABILITIES or field.name.endswith(ENDING):
            digits = F.format_string("%.5e", value.cast("double")).cast("double")
            plain = F.when((value > 0) & (value < SMALL), digits).otherwise(plain)
        return plain.alias(field.name)

    return df.select(*[tidied(f) for f in df.schema.fields])
