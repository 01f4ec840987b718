"""Size selection of members, types and files; line and byte measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .percentiles import cutoffs


def line_count(text: Column) -> Column:
    """Lines, where CR LF, LF, CR, NEL, LS and PS end one; an ending line break begins a last, empty line."""
    return F.size(F.split(text, "\r\n|[\n\r\u0085  ]", -1)).cast("long")


def first_line(text: Column, most: int = 180) -> Column:
    """The first line that isn't blank, trimmed and cut."""
    lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r]", -1), lambda s: F.trim(s)), lambda s: s != "")
    return F.substring(F.get(lines, F.lit(0)), 1, most)


def branchy(decisions: Column, constructs: Column, nesting: Column) -> Column:
    return ((decisions >= 8) & (constructs >= 2)) | (nesting >= 4)


def select_members(df: DataFrame, group: list[str], tie: list[str], percentile: Column, least: int = 80, extreme: int = 300) -> DataFrame:
    """Rows (lines, decisions, constructs, nesting) that are long for their group and branchy, or extremely long.

    Adds population, cutoff, by_group and by_extreme; a row may qualify both ways.
    """
    joined = df.join(cutoffs(df, group, "lines", percentile, tie), group)
    long_one = (F.col("lines") >= least) & (F.col("lines") >= F.col("cutoff")) & branchy(F.col("decisions"), F.col("constructs"), F.col("nesting"))
    out = joined.withColumn("by_group", long_one).withColumn("by_extreme", F.col("lines") >= extreme)
    return out.where(F.col("by_group") | F.col("by_extreme"))


def select_types(parts: DataFrame, group: list[str], type_key: list[str], percentile: Column, least: int = 300, extreme: int = 800) -> DataFrame:
    """Types, their lines summed over parts, that are long for their group or extremely long."""
    types = parts.groupBy(*group, *type_key).agg(F.sum("lines").cast("long").alias("lines"), F.count(F.lit(1)).alias("parts"))
    joined = types.join(cutoffs(types, group, "lines", percentile, type_key), group)
    out = joined.withColumn("by_group", (F.col("lines") >= least) & (F.col("lines") >= F.col("cutoff"))).withColumn("by_extreme", F.col("lines") >= extreme)
    return out.where(F.col("by_group") | F.col("by_extreme"))


def select_files(df: DataFrame, text: str, extreme_lines: int = 1000, extreme_bytes: int = 131072) -> DataFrame:
    """Files extremely long in lines or bytes; those of white space only are never selected."""
    out = df.withColumn("lines", line_count(F.col(text))).withColumn("utf8_bytes", F.octet_length(text).cast("long"))
    out = out.withColumn("by_lines", F.col("lines") >= extreme_lines).withColumn("by_bytes", F.col("utf8_bytes") >= extreme_bytes)
    return out.where(F.col(text).rlike(r"\S") & (F.col("by_lines") | F.col("by_bytes")))


def distinct_lines(tokens: DataFrame, owner: list[str], line: str = "start_line") -> DataFrame:
    """Code lines of each owner: distinct lines on which a token starts."""
    return tokens.groupBy(*owner).agg(F.count_distinct(F.col(line)).alias("code_lines"))


def decision_metrics(decisions: DataFrame, owner: list[str]) -> DataFrame:
    """Decisions, constructs, deepest nesting and the first line at that depth, by owner."""
    return decisions.groupBy(*owner).agg(
        F.sum(F.col("counts").cast("long")).alias("decisions"),
        F.count_distinct("construct_id").alias("constructs"),
        F.max("depth").alias("max_nesting"),
        F.min_by("line", F.struct(-F.col("depth"), F.col("ordinal"))).alias("deepest_line"),
    )
