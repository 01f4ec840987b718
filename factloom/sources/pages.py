"""The report as rows: every line of every page is a row, and tasks write the pages.

A page is (page, at, text): its path in the report, the place of the line in it, and the line. What
is written goes to a folder aside; only when all tasks are done it is renamed into place.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.findings import KEY, areas, finding_id, folder_rollup, project_key, related, short_symbol, type_id

AREAS = ("production", "tests", "mixed")
FORMAT = "factloom-report"


# --- text as columns -------------------------------------------------------------------------


def code_span(text: Column) -> Column:
    """text as inline code: a fence longer than any run of backticks inside."""
    t = F.coalesce(text, F.lit(""))
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(t, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    pad = F.when(t.startswith("`") | t.endswith("`"), " ").otherwise("")
    return F.concat(F.repeat(F.lit("`"), longest + 1), pad, t, pad, F.repeat(F.lit("`"), longest + 1))


def escape(text: Column) -> Column:
    """text with Markdown's marks escaped, on one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), r"([\\`*_{}\[\]()#+.!|<>-])", r"\\$1"))


def number(value: Column) -> Column:
    """At most two decimals, none that are zero."""
    return F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")


def location(page_source: Column, source: Column, line: Column) -> Column:
    """Lnn in the file that the heading above names, else the path and the line."""
    return code_span(F.when(page_source == source, F.concat(F.lit("L"), line)).otherwise(F.concat(source, F.lit(":"), line)))


def _rows(df: DataFrame, page: Column | str, text: Column, *at: Column | str) -> DataFrame:
    """(page, at, text); at is (part, project, source, line, subject, rest, within), missing ones last."""
    types = ("int", "string", "string", "int", "string", "string", "int")
    given = [F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x for x in at]
    given += [F.lit(None)] * (len(types) - len(given))
    place = F.struct(*[c.cast(t).alias(f"k{i}") for i, (c, t) in enumerate(zip(given, types, strict=True))])
    return df.select((F.lit(page) if isinstance(page, str) else page).alias("page"), place.alias("at"), text.alias("text"))


# --- findings --------------------------------------------------------------------------------


def placed(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """findings with id, area (by the role of their source) and page."""
    f = findings.withColumn("id", finding_id(*[F.col(k) for k in KEY]))
    roles = documents.select("project_path", "source_path", "role").distinct()
    known = areas(f.select("id", "project_path", "source_path").join(roles, ["project_path", "source_path"], "left").select("id", F.coalesce("role", F.lit("Production")).alias("role")), ["id"])
    return f.join(known, "id").withColumn("page", F.concat("area", F.lit("/"), "analysis_id", F.lit(".md")))


def related_lines(found: DataFrame) -> DataFrame:
    """(id, text): the findings that share a finding's subject in its project, by page."""
    pairs = related(found.select("id", "project_path", F.col("subject_id").alias("symbol_id")))
    other = found.select(F.col("id").alias("related_id"), F.col("page").alias("other"))
    pages = pairs.join(other, "related_id").groupBy("id", "other").agg(F.array_join(F.array_sort(F.collect_list("related_id")), ", ").alias("ids"))
    lines = pages.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("other", "ids"))).alias("l"))
    line = F.array_join(F.transform("l", lambda x: F.concat(code_span(F.concat(F.lit("../"), x["other"])), F.lit(": "), x["ids"])), "; ")
    return lines.select("id", F.concat(F.lit("  - Related: "), line).alias("text"))


def evidence_lines(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows of evidence (id, source_path, line, label, detail), distinct, below their findings; what is
    the finding's own place and has no detail is left out."""
    e = evidence.select("id", F.col("source_path").alias("at_path"), "line", "label", "detail").distinct()
    e = e.join(found, "id").where((F.col("at_path") != F.col("source_path")) | (F.col("line") != F.col("start_line")) | (F.coalesce("detail", F.lit("")) != ""))
    detail = F.when(F.trim(F.coalesce("detail", F.lit(""))) != "", F.concat(F.lit(" — "), escape(F.col("detail")))).otherwise("")
    text = F.concat(F.lit("    - "), location(F.col("source_path"), F.col("at_path"), F.col("line")), F.lit(" "), code_span(short_symbol(F.col("label"))), detail)
    within = F.row_number().over(Window.partitionBy("id").orderBy("at_path", "line", "label", "detail")) + 10
    heads = e.select("page", "project_path", "source_path", "start_line", "subject_id", "id").distinct()
    own = ["project_path", "source_path", "start_line", "subject_id", "id"]
    return _rows(heads, F.col("page"), F.lit("  - Evidence:"), 1, *own, 10).unionByName(_rows(e, F.col("page"), text, 1, *own, within))


def finding_pages(found: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Pages of all findings (placed): a page for each area and analysis, by project and file."""
    own = ["project_path", "source_path", "start_line", "subject_id", "id"]
    title = found.select("page", "analysis_id", "area").distinct()
    head = F.concat(F.lit("# "), escape(F.col("analysis_id")), F.lit("\n\nFindings of the "), F.col("area"), F.lit(" area. They are candidates to look at, not defects. `Lnn` is a line of the file named above.\n"))
    projects, files = found.select("page", "project_path").distinct(), found.select("page", "project_path", "source_path").distinct()
    metrics = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("metrics", F.create_map().cast("map<string,double>")))), lambda e: F.concat(e["key"], F.lit(" "), number(e["value"]))), ", ")
    line = F.concat(F.lit("- "), code_span(F.col("subject_id")), F.lit(", "), code_span(F.concat(F.lit("L"), F.col("start_line"))), F.lit(", "), F.coalesce("discriminator", F.lit("")), F.when(metrics != "", F.concat(F.lit(": "), metrics)).otherwise(""), F.lit(" ("), F.col("id"), F.lit(")"))
    same = found.join(related_lines(found), "id")
    rows = [
        _rows(title, F.col("page"), head, 0), _rows(projects, F.col("page"), F.concat(F.lit("\n## "), code_span(F.col("project_path"))), 1, "project_path"),
        _rows(files, F.col("page"), F.concat(F.lit("\n### "), code_span(F.col("source_path")), F.lit("\n")), 1, "project_path", "source_path"), _rows(found, F.col("page"), line, 1, *own, 0),
        _rows(same, F.col("page"), F.col("text"), 1, *own, 1_000_000),
    ]
    if evidence is not None:
        rows.append(evidence_lines(found, evidence))
    return reduce(DataFrame.unionByName, rows)


def audit_map(found: DataFrame) -> DataFrame:
    """maps/audit/index.md: where each finding is told, by file."""
    page = "maps/audit/index.md"
    head = found.sparkSession.createDataFrame([(0,)], "i int")
    files = found.select("project_path", "source_path").distinct()
    line = F.concat(F.lit("- "), F.col("id"), F.lit(" L"), F.col("start_line"), F.lit(" → "), code_span(F.concat(F.lit("../../"), F.col("page"))))
    return reduce(DataFrame.unionByName, [
        _rows(head, page, F.lit("# Findings by file\n"), 0), _rows(files, page, F.concat(F.lit("\n## "), code_span(F.col("source_path")), F.lit("\n")), 1, "project_path", "source_path"),
        _rows(found, page, line, 1, "project_path", "source_path", "start_line", "subject_id", "id"),
    ])


def area_pages(found: DataFrame) -> DataFrame:
    """An index for each area, with the findings of each analysis; an area without findings says so."""
    spark = found.sparkSession
    every = spark.createDataFrame([(a,) for a in AREAS], "area string")
    page = F.concat("area", F.lit("/index.md"))
    counts = found.groupBy("area", "analysis_id").agg(F.count(F.lit(1)).alias("n"))
    none = every.join(counts.select("area").distinct(), "area", "left_anti")
    line = F.concat(F.lit("- "), code_span(F.concat("analysis_id", F.lit(".md"))), F.lit(": "), F.col("n"), F.lit(" findings"))
    return reduce(DataFrame.unionByName, [_rows(every, page, F.concat(F.lit("# "), F.initcap("area"), F.lit(" findings\n")), 0), _rows(none, page, F.lit("No findings in this area."), 1), _rows(counts, page, line, 2, "analysis_id")])


# --- maps ------------------------------------------------------------------------------------


def project_maps(projects: DataFrame, documents: DataFrame, types: DataFrame, declarations: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages of projects: what they hold, and what their types depend on and are used by.

    projects has project_path and references, documents project_path, source_path, role and bytes,
    types type_id and project_path, declarations type_id and source_path, edges (a, b) of type ids.
    """
    p = projects.select("project_path", "references").dropDuplicates(["project_path"]).withColumn("key", project_key(F.col("project_path")))
    folder = lambda name: F.concat(F.lit("maps/"), "key", F.lit(f"/{name}.md"))
    d = documents.join(p.select("project_path", "key"), "project_path")
    files = d.groupBy("project_path").agg(F.count(F.lit(1)).alias("files"), F.bool_or(F.col("role") == "Tests").alias("tests"))
    t = types.select("type_id", "project_path").distinct().join(p.select("project_path", "key"), "project_path").withColumn("id", type_id(F.col("key"), F.col("type_id")))
    held = t.groupBy("project_path").agg(F.count(F.lit(1)).alias("types"))
    all_ = p.join(files, "project_path", "left").join(held, "project_path", "left")
    refs = F.array_join(F.transform(F.array_sort("references"), code_span), ", ")
    text = F.concat(F.lit("\n## "), code_span(F.col("project_path")), F.lit("\n\nKey: "), code_span(F.col("key")), F.lit("; role: "), F.when(F.col("tests"), "tests").otherwise("production"), F.lit(". Files: "), F.coalesce("files", F.lit(0)), F.lit("; types: "), F.coalesce("types", F.lit(0)), F.lit(". References: "), F.when(F.size("references") > 0, refs).otherwise("none"), F.lit("."))
    head = p.sparkSession.createDataFrame([(0,)], "i int")
    rows = [_rows(head, "maps/projects.md", F.lit("# Projects"), 0), _rows(all_, "maps/projects.md", text, 1, "project_path")]
    rows.append(_rows(p, folder("structure"), F.concat(F.lit("# Structure of "), code_span(F.col("project_path")), F.lit("\n\n## Folders\n")), 0))
    tree = reduce(DataFrame.unionByName, [folder_rollup_by_project(d)])
    rows.append(_rows(tree, folder("structure"), F.concat(F.lit("- "), code_span(F.col("folder")), F.lit(": "), F.col("files"), F.lit(" files, "), F.col("bytes"), F.lit(" bytes")), 1, "folder"))
    rows.append(_rows(p, folder("structure"), F.lit("\n## Types\n"), 2))
    sources = declarations.select("type_id", "source_path").distinct().groupBy("type_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("source_path")), code_span), ", ").alias("sources"))
    rows.append(_rows(t.join(sources, "type_id", "left"), folder("structure"), F.concat(F.lit("- "), F.col("id"), F.lit(" "), code_span(F.col("type_id")), F.lit(": "), F.coalesce("sources", F.lit("no source"))), 3, "type_id"))
    end = lambda side, name: t.select(F.col("type_id").alias(side), F.col("id").alias(f"{name}_id"), F.col("project_path").alias(f"{name}_project"), F.col("key").alias(f"{name}_key"))
    e = edges.select("a", "b").distinct().join(end("a", "from"), "a").join(end("b", "to"), "b")
    for own, page, one, other in (("from", "dependencies-outgoing", "a", "b"), ("to", "dependencies-incoming", "b", "a")):
        rows.append(_rows(p, folder(page), F.concat(F.lit("# Dependencies of "), code_span(F.col("project_path")), F.lit(", " + page.rpartition("-")[2] + "\n")), 0))
        far = "to" if own == "from" else "from"
        rows.append(_rows(e, F.concat(F.lit("maps/"), f"{own}_key", F.lit(f"/{page}.md")), F.concat(F.lit("- "), code_span(F.col(one)), F.lit(" → " if own == "from" else " ← "), code_span(F.col(other)), F.lit(" in "), code_span(F.col(f"{far}_project"))), 1, one, other))
    return reduce(DataFrame.unionByName, rows)


def folder_rollup_by_project(documents: DataFrame) -> DataFrame:
    """(key, folder, files, bytes): folder_rollup within each project; paths carry the key while they are counted."""
    whole = folder_rollup(documents.select(F.concat("key", F.lit("/"), "source_path").alias("path"), "bytes"))
    return whole.where("folder <> '.'").select(F.substring_index("folder", "/", 1).alias("key"), F.when(F.instr("folder", "/") > 0, F.regexp_replace("folder", "^[^/]*/", "")).otherwise(".").alias("folder"), "files", "bytes")


# --- writing ---------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    pages: int


class ReportWriter(DataSourceWriter):
    """Writes pages in tasks, to a folder that all of them share, and renames it when all are there."""

    def __init__(self, options: dict[str, str]):
        self.aside, self.target = options["aside"], options["target"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        now, out, n = None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, Path(self.aside, now))  # a task that runs again puts the same page there

        try:
            for r in rows:
                if r["page"] != now:
                    close()
                    now, n = r["page"], n + 1
                    path = Path(self.aside, now)
                    path.parent.mkdir(parents=True, exist_ok=True)
                    out = open(path.with_name(f".{path.name}.{os.getpid()}"), "w", encoding="utf-8", newline="\n")  # noqa: SIM115
                out.write(r["text"] + "\n")
            close()
        except BaseException:
            if out is not None:
                out.close()
            raise
        return Written(n)

    def commit(self, messages: list) -> None:
        os.rename(self.aside, self.target)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ReportWriter(dict(self.options))


def write(pages: DataFrame, aside: Path, target: Path) -> None:
    """Writes pages (page, at, text): a page's rows meet in one task, in order, and pass through it one by one."""
    from ..runtime import ship

    spark = pages.sparkSession
    ship(spark)
    spark.dataSource.register(ReportSource)
    rows = pages.repartition("page").sortWithinPartitions("page", "at").select("page", "text")
    try:
        rows.write.format(FORMAT).option("aside", str(aside)).option("target", str(target)).mode("append").save()
    except BaseException:
        shutil.rmtree(aside, ignore_errors=True)  # what fails before the writer has begun isn't aborted by it
        raise
