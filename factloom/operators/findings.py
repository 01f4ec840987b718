"""Findings: stable ids, areas, relations through symbols, validation, folder totals and ambiguous names.

A finding is keyed by (analysis_id, project_path, source_path, subject_id, discriminator).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

KEY = ["analysis_id", "project_path", "source_path", "subject_id", "discriminator"]


def finding_id(*parts: Column) -> Column:
    """finding- and 24 hex digits of the digest of the key, joined by NUL."""
    return F.concat(F.lit("finding-"), F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 24))


def project_key(path: Column) -> Column:
    """p-, a slug of at most 32 characters and 8 hex digits that tell equal slugs apart.

    Each character that a slug can't have is a dash; dashes at its ends go before it is cut.
    """
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    slug = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_-]", "-"), "^-+|-+$", "")
    slug = F.when(slug == "", "project").otherwise(F.substring(slug, 1, 32))
    return F.concat(F.lit("p-"), slug, F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))


def type_id(project: Column, symbol: Column) -> Column:
    """t- and 16 hex digits of the digest of project key and symbol."""
    return F.concat(F.lit("t-"), F.substring(F.sha2(F.concat_ws(":", project, symbol), 256), 1, 16))


def areas(subjects: DataFrame, key: list[str]) -> DataFrame:
    """(key..., area): mixed if the subjects' roles (role) are both, else tests or production."""
    t, p = F.bool_or(F.col("role") == "Tests").alias("t"), F.bool_or(F.col("role") != "Tests").alias("p")
    area = F.when(F.col("t") & F.col("p"), "mixed").when(F.col("t"), "tests").otherwise("production")
    return subjects.groupBy(*key).agg(t, p).select(*key, area.alias("area"))


def related(symbols: DataFrame) -> DataFrame:
    """(id, related_id): findings (id, project_path, symbol_id) that share a symbol of a project.

    Both sides are cut to distinct rows first; a symbol that very many findings name still yields
    their pairs, which is what the report asks for.
    """
    own = symbols.select("id", "project_path", "symbol_id").distinct()
    other = own.withColumnRenamed("id", "related_id")
    return own.join(other, ["project_path", "symbol_id"]).where("id <> related_id").select("id", "related_id").distinct()


def source_paths(evidence: DataFrame) -> DataFrame:
    """(id, paths): the sources of a finding and its evidence (id, source_path), distinct and sorted."""
    return evidence.groupBy("id").agg(F.sort_array(F.collect_set("source_path")).alias("paths"))


def violations(found: DataFrame, sources: DataFrame) -> DataFrame:
    """(rule, id) of findings that may not be published.

    found has id, KEY, start_line, evidence_lines (array of struct(line, snippet)), metrics (map);
    sources has project_path, source_path and lines (array of string).
    """
    keyed = found.join(sources, ["project_path", "source_path"], "left")
    repeated = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*KEY))).where("n > 1").select(F.lit("duplicate-key").alias("rule"), "id")
    unknown = keyed.where("lines is null").select(F.lit("unknown-source").alias("rule"), "id")
    outside = keyed.where("lines is not null and (start_line < 1 or start_line > size(lines))").select(F.lit("line-out-of-range").alias("rule"), "id")
    empty = found.where("size(evidence_lines) = 0").select(F.lit("no-evidence").alias("rule"), "id")
    wrong = keyed.where("exists(evidence_lines, e -> instr(coalesce(get(lines, e.line - 1), ''), e.snippet) = 0)").select(F.lit("snippet-not-in-line").alias("rule"), "id")
    infinite = found.where("exists(map_values(metrics), v -> v is null or isnan(v) or abs(v) = double('infinity'))").select(F.lit("metric-not-finite").alias("rule"), "id")
    out = repeated
    for more in (unknown, outside, empty, wrong, infinite):
        out = out.unionByName(more)
    return out


def checked(found: DataFrame, documents: DataFrame, observation: Observation) -> DataFrame:
    """found with id and lines; observation counts what breaks a rule, in the pass that computes the rows.

    A key that comes twice, a source that documents (project_path, source_path, lines) don't have, a
    line outside it and a metric that is no finite number are counted, by rule, and none is dropped.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEY))
    rows = found.withColumn("id", finding_id(*[F.col(k) for k in KEY])).withColumn("_n", n).join(documents.select("project_path", "source_path", "lines").dropDuplicates(["project_path", "source_path"]), ["project_path", "source_path"], "left")
    infinite = F.exists(F.map_values(F.coalesce("metrics", F.create_map().cast("map<string,double>"))), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    broken = {"duplicate-key": F.col("_n") > 1, "unknown-source": F.col("lines").isNull(), "line-out-of-range": ~F.col("start_line").between(1, F.col("lines")), "metric-not-finite": infinite}
    counts = [F.sum(F.when(F.coalesce(on, F.lit(False)), 1).otherwise(0)).alias(rule) for rule, on in broken.items()]
    return rows.observe(observation, F.count(F.lit(1)).alias("findings"), *counts).select(*found.columns)


def folder_rollup(files: DataFrame) -> DataFrame:
    """(folder, files, bytes): every file (path, bytes) counted in each folder above it and in "."."""
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    return files.select(F.explode(above).alias("folder"), "bytes").groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").cast("long").alias("bytes"))


def ambiguous(names: DataFrame, name: str, full: list[str]) -> DataFrame:
    """(name, meanings) of short names that stand for more than one full name."""
    n = F.count_distinct(*[F.col(c) for c in full]).alias("meanings")
    return names.groupBy(name).agg(n).where("meanings > 1")


def short_symbol(symbol: Column) -> Column:
    """The last two dotted parts of a symbol, its kind mark and signature aside."""
    bare = F.regexp_replace(F.regexp_replace(symbol, r"\(.*$", ""), r"^[A-Z]:", "")
    parts = F.split(bare, r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
