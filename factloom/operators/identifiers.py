"""Characters of identifiers: those outside ASCII letters, digits and underscore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offending(name: Column) -> Column:
    """The first character that isn't [A-Za-z0-9_], a leading @ aside; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(name, "^@", ""), "[^A-Za-z0-9_]", 0), F.lit(""))


def findings(df: DataFrame, key: list[str], name: str, line: str, order: list[str]) -> DataFrame:
    """Rows whose name has an offending character; a repeated key gets its line added from the second on."""
    found = df.withColumn("character", offending(F.col(name))).where(F.col("character").isNotNull())
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return found.withColumn("_rn", rn).withColumn("discriminator", F.when(F.col("_rn") > 1, F.concat_ws(":", F.lit("identifier"), F.col(line).cast("string"))).otherwise("identifier")).drop("_rn")


def snippet(line: Column, at: Column, most: int = 180) -> Column:
    """At most `most` characters of line around position at (from 1), trimmed."""
    start = F.greatest(F.lit(1), F.least(at - most // 2, F.length(line) - most + 1))
    return F.trim(F.substring(line, start, F.lit(most)))
