"""Long and wide forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name of the column for a missing name.
NO_NAME = "NA"
#: Names that are looked up for columns, at most: each becomes a column of the plan.
MOST_COLUMNS = 10_000


def wide_from_long(df: DataFrame, rows: list[str], names_from: str, values_from: str,
                   names: list | None = None, fill=None, drop_unlisted: bool = False,
                   most: int = MOST_COLUMNS) -> DataFrame:
    """One row per ``rows`` key, one column per name; a missing name has the column ``NA``.

    Without ``names`` they are looked up in the data; more than ``most`` of them are an error. With ``names``, a row of another name
    is an error when the result is computed, unless ``drop_unlisted`` asks to leave it out.
    """
    name = F.coalesce(F.col(names_from).cast("string"), F.lit(NO_NAME))
    df = df.withColumn(names_from, name)
    if names is None:
        names = sorted(r[0] for r in df.select(names_from).distinct().limit(most + 1).collect())
        if len(names) > most:
            raise ValueError(f"{names_from} has more than {most} names")
    else:
        names = [NO_NAME if n is None else str(n) for n in names]
        if not drop_unlisted:
            unknown = F.raise_error(F.concat(F.lit(f"unlisted name in {names_from}: "), F.col(names_from)))
            df = df.withColumn(names_from, F.when(F.col(names_from).isin(names), F.col(names_from)).otherwise(unknown))
    wide = df.groupBy(*rows).pivot(names_from, list(names)).agg(F.first(values_from))
    return wide if fill is None else wide.fillna(fill, [str(n) for n in names])


def long_from_wide(df: DataFrame, keys: list[str], columns: list[str], names_to: str,
                   values_to: str) -> DataFrame:
    return df.unpivot(keys, columns, names_to, values_to)


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns from ``first`` to ``last``, both included."""
    names = df.columns
    return names[names.index(first): names.index(last) + 1]


def transpose(df: DataFrame, row_name: str, new_row_name: str, names: list | None = None) -> DataFrame:
    """Swap rows and columns of a wide frame; ``names`` are the old row names, looked up if not given."""
    columns = [c for c in df.columns if c != row_name]
    long = df.unpivot([row_name], columns, new_row_name, "_value")
    return wide_from_long(long, [new_row_name], row_name, "_value", names)

