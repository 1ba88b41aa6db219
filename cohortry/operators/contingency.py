"""Independence tests of grouped two-column tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.nullrules import divide
from cohortry.functions.tails import chi_square_tail


def chisq_by(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Chi-square test of the k x 2 table (a, b) per panel; one row per table row.

    A 2 x 2 table gets Yates' correction, a single row is tested for equal
    shares, and a table with an empty row or column has no result. The statistic
    comes from sums of one aggregate: with p = A/N it equals
    (sum a^2/(a+b) - A^2/N) / (p (1-p)).
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    row = x + y
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(x).alias("_a"), F.sum(y).alias("_b"),
        F.sum(divide(x * x, row)).alias("_q"), F.sum(row * row).alias("_rr"),
        F.bool_or(row == 0).alias("_empty"))
    total = F.col("_a") + F.col("_b")
    plain = F.greatest(F.lit(0.0), F.try_divide(
        (F.col("_q") - F.col("_a") * F.col("_a") / total) * total * total,
        F.col("_a") * F.col("_b")))
    margins = (total * total - F.col("_rr")) / 2 * F.col("_a") * F.col("_b")
    cross = F.sqrt(plain * margins / total)
    slack = F.greatest(F.lit(0.0), cross - total / 2)
    defined = ~F.col("_empty") & (F.col("_a") > 0) & (F.col("_b") > 0)
    statistic = (
        F.when(F.col("n_rows") == 1,
               F.try_divide((F.col("_a") - F.col("_b")) * (F.col("_a") - F.col("_b")), total))
        .when(defined & (F.col("n_rows") == 2), F.try_divide(total * slack * slack, margins))
        .when(defined, plain))
    return (
        sums.withColumn("dof", F.greatest(F.lit(1), F.col("n_rows") - 1))
        .withColumn("statistic", F.when(total > 0, statistic))
        .select(*by, "n_rows", "statistic", "dof",
                chi_square_tail("statistic", "dof").alias("p_value")))
