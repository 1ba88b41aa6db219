"""Exact order statistics without ordering the rows: selection by digit histograms.

A double becomes a whole number of 64 bits that orders as the double does. A round counts
the next 16 bits of the rows that still can be the wanted ones, and the histogram, at most
65,536 counts per panel and prefix, tells where each wanted rank lies. Four rounds fix
all 64 bits. Counting combines map-side, so a panel of any size costs its rows nothing but four
reads of two staged columns; no value is sorted and no row is exchanged where the table
of wanted prefixes, one row per panel and rank, is small enough for the engine to broadcast.

Meant for panels of many rows. For very many small panels ``moments.quantiles_by`` is the better plan.

Missing values and NaN are left out, infinities count, and both zeros are one; a quantile between
two values of which one is infinite can be null. A panel without values has no row. A missing key
is a panel of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.operators.running import KEY, panel
from cohortry.session import staged

DIGIT, ROUNDS = 16, 4
FRACTION = 52  # bits of a double's fraction; its exponent is stored 1023 too high
BIAS = 1023


def ordered_bits(value: Column) -> Column:
    """The double as a long in the same order; zero is 0 and signs mirror."""
    size = F.abs(value)
    guess = F.least(F.floor(F.log2(size)), F.lit(BIAS)).cast("int")
    power = F.pow(F.lit(2.0), guess)
    exponent = F.when(size < power, guess - 1).when(size >= power * 2, guess + 1).otherwise(guess)
    fraction = (size / F.pow(F.lit(2.0), exponent) - 1) * float(2 ** FRACTION)
    normal = F.shiftleft((exponent + BIAS).cast("long"), FRACTION) + fraction.cast("long")
    small = (size * float(2.0 ** 537) * float(2.0 ** 537)).cast("long")
    bits = (F.when(size == 0, F.lit(0).cast("long")).when(size < float(2.0 ** -1022), small)
            .when(size == float("inf"), F.lit((2 * BIAS + 1) << FRACTION)).otherwise(normal))
    return F.when(value < 0, -bits).otherwise(bits)


def from_ordered_bits(key: Column) -> Column:
    size = F.abs(key)
    exponent = F.shiftright(size, FRACTION)
    fraction = size.bitwiseAND(F.lit((1 << FRACTION) - 1)).cast("double")
    small = fraction * float(2.0 ** -537) * float(2.0 ** -537)
    normal = (fraction / float(2 ** FRACTION) + 1) * F.pow(F.lit(2.0), (exponent - BIAS).cast("double"))
    value = (F.when(exponent == 0, small).when(exponent == 2 * BIAS + 1, F.lit(float("inf"))).otherwise(normal))
    return F.when(key < 0, -value).otherwise(value)


def _keys(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return staged(df.filter(v.isNotNull() & ~F.isnan(v)).select(panel(by).alias(KEY), ordered_bits(v).alias("_key")))


def _select(keys: DataFrame, ranks: Column) -> DataFrame:
    """``_panel``, ``_n``, ``_name`` and the ``_key`` at each rank.

    ``ranks`` makes, from the panel's size ``_n``, an array of (name, rank from 0).
    """
    wanted = None
    for turn in range(ROUNDS):
        shift = 64 - DIGIT * (turn + 1)
        before = F.shiftright("_key", shift + DIGIT) if turn else F.lit(0).cast("long")
        rows = keys.select(KEY, before.alias("_prefix"), F.shiftright("_key", shift).alias("_next"))
        if wanted is not None:
            rows = rows.join(wanted, [KEY, "_prefix"], "left_semi")
        histogram = rows.groupBy(KEY, "_prefix", "_next").agg(F.count(F.lit(1)).alias("_here"))
        # At most 2^DIGIT rows in a window, whatever the panel's size.
        inside = Window.partitionBy(KEY, "_prefix")
        told = histogram.withColumn("_upto", F.sum("_here").over(inside.orderBy("_next")))
        if wanted is None:
            told = told.withColumn("_n", F.sum("_here").over(inside)).withColumn("_rank", F.explode(ranks)).select(
                "*", F.col("_rank._name").alias("_name"), F.col("_rank._at").alias("_at")).drop("_rank")
        else:
            told = told.join(wanted, [KEY, "_prefix"])
        low = F.col("_upto") - F.col("_here")
        found = told.filter((F.col("_at") >= low) & (F.col("_at") < F.col("_upto"))).select(
            KEY, F.col("_next").alias("_prefix"), "_n", "_name", (F.col("_at") - low).alias("_at"))
        wanted = staged(found) if turn < ROUNDS - 1 else found
    return wanted.select(KEY, "_n", "_name", F.col("_prefix").alias("_key"))


def _quantiles(keys: DataFrame, probs: dict[str, float]) -> DataFrame:
    """``_panel``, ``n`` and a column per probability."""
    place = {name: (F.col("_n") - 1) * F.lit(float(prob)) for name, prob in probs.items()}
    ranks = F.array(*[F.struct(F.lit(f"{side} {name}").alias("_name"), cut(at).cast("long").alias("_at"))
                      for name, at in place.items() for side, cut in (("low", F.floor), ("high", F.ceil))])
    found = _select(keys, ranks).withColumn("_value", from_ordered_bits(F.col("_key")))
    at = {f"{side} {name}": F.max(F.when(F.col("_name") == f"{side} {name}", F.col("_value")))
          for name in probs for side in ("low", "high")}
    wide = found.groupBy(KEY, "_n").agg(*[c.alias(name) for name, c in at.items()])
    outs = []
    for name in probs:
        low, high = F.col(f"low {name}"), F.col(f"high {name}")
        part = place[name] - F.floor(place[name])
        between = low + part * (high - low)
        outs.append(F.when(low == high, low).when(~F.isnan(between), between).alias(name))
    return wide.select(KEY, F.col("_n").alias("n"), *outs)


def _unpack(by: list[str]) -> list[Column]:
    return [F.col(KEY)[name].alias(name) for name in by]


def selected_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per panel, with the number of values ``n``.

    ``probs`` maps output names to probabilities.
    """
    return _quantiles(_keys(df, by, value), probs).select(*_unpack(by), "n", *probs)


def selected_boxes(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers of 1.5 times their distance, and the number of rows outside, per panel."""
    keys = _keys(df, by, value)
    boxes = staged(_quantiles(keys, {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    reach = F.when(F.col("q1") == F.col("q3"), F.lit(0.0)).otherwise(1.5 * (F.col("q3") - F.col("q1")))
    fences = boxes.select(KEY, ordered_bits(F.col("q1") - reach).alias("_from"), ordered_bits(F.col("q3") + reach).alias("_to"))
    inside = F.col("_key").between(F.col("_from"), F.col("_to"))
    reached = keys.join(fences, KEY).groupBy(KEY).agg(
        F.min(F.when(inside, F.col("_key"))).alias("_low"), F.max(F.when(inside, F.col("_key"))).alias("_high"),
        F.count_if(~inside).alias("n_outliers"))
    return boxes.join(reached, KEY).select(
        *_unpack(by), "n", "q1", "median", "q3", from_ordered_bits(F.col("_low")).alias("whisker_low"),
        from_ordered_bits(F.col("_high")).alias("whisker_high"), "n_outliers")
