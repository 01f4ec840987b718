"""Nearest-rank cut-offs per group, outlier selection and competition ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(percentile: Column, count: Column) -> Column:
    """ceil(p / 100 * n) in double arithmetic, at least 1. Rounding of p / 100 is kept on purpose:
    at p = 54, n = 450 the rank is 244, not 243."""
    return F.greatest(F.ceil(percentile.cast("double") / F.lit(100.0).cast("double") * count), F.lit(1)).cast("long")


def histogram(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group..., value, _upto, _above, _n): rows with at most that value, with a larger one, and all.

    Rows are counted by value where they are; windows see one row for each distinct value.
    """
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group).orderBy(value)
    counts = counts.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counts = counts.withColumn("_n", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return counts.withColumn("_above", F.col("_n") - F.col("_upto"))


def cutoffs(df: DataFrame, group: list[str], value: str, percentile: Column, tie: list[str]) -> DataFrame:
    """(group..., population, cutoff): the value at the nearest rank of each group.

    Rows with equal values are interchangeable here, so the order among them (tie) plays no part.
    The percentile may differ between rows of a group only as columns of group do.
    """
    named = df.withColumn("_p", percentile.cast("double"))
    counts = histogram(named, [*group, "_p"], value)
    picked = counts.where((F.col("_upto") >= nearest_rank(F.col("_p"), F.col("_n"))) & (F.col("_upto") - F.col("_c") < nearest_rank(F.col("_p"), F.col("_n"))))
    return picked.select(*group, F.col("_n").cast("long").alias("population"), F.col(value).alias("cutoff"))


def ranks(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """(group..., value, name): 1 + the number of larger values in the group, for each distinct value."""
    return histogram(df, group, value).select(*group, value, (F.col("_above") + 1).cast("long").alias(name))


def outliers(df: DataFrame, group: list[str], first: str, second: str, constructs: str, tie: list[str], percentile: Column, floors: tuple[float, float] = (8, 4), least_constructs: float = 2) -> DataFrame:
    """Rows at or above a cut-off: (first >= max(floor, P) and constructs >= least) or second >= max(floor, P).

    Adds population, both cut-offs and both competition ranks; ties at a cut-off are all kept.
    """
    a = cutoffs(df, group, first, percentile, tie).withColumnRenamed("cutoff", "_a")
    b = cutoffs(df, group, second, percentile, tie).withColumnRenamed("cutoff", "_b").drop("population")
    # Cut first: few rows are left to be ranked, by ranks over all rows.
    joined = df.join(a, group).join(b, group)
    joined = joined.withColumn("first_cutoff", F.greatest(F.lit(floors[0]), F.col("_a"))).withColumn("second_cutoff", F.greatest(F.lit(floors[1]), F.col("_b")))
    by_first = (F.col(first) >= F.col("first_cutoff")) & (F.col(constructs) >= least_constructs)
    out = joined.where(by_first | (F.col(second) >= F.col("second_cutoff"))).drop("_a", "_b")
    for value, name in ((first, "first_rank"), (second, "second_rank")):
        out = out.join(ranks(df, group, value, name), [*group, value])
    return out
