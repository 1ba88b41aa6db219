"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cohortry.sources.schemas import canonical, schema_of


def read_columnar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_text(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """Delimited text with a header; the text ``NA`` is a missing value."""
    return (spark.read.schema(schema).option("header", True).option("sep", sep)
            .option("nullValue", "NA").csv(path))


def read_input(spark: SparkSession, path: str, table: str, sep: str | None = None) -> DataFrame:
    """An input table under its declared schema and canonical names.

    Parquet unless ``sep`` is given. A declared column that the input lacks is an error;
    columns of another type are cast.
    """
    schema = schema_of(table)
    raw = read_columnar(spark, path) if sep is None else read_text(spark, path, schema, sep)
    missing = [c for c in schema.names if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks declared columns of {table}: {', '.join(missing)}")
    return canonical(raw.select(*[raw[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in schema]), table)


def save_checkpoint(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Write a named intermediate table to shared storage."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def load_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_text(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option(
        "nullValue", "NA").csv(path)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
