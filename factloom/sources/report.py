"""Publication of findings as a tree of Markdown files, written aside by tasks and renamed into place."""

from __future__ import annotations

import errno
import json
import re
import secrets
import shutil
import time
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.findings import KEY, finding_id
from ..runtime import cut
from . import facts, pages

RETRIES = (0.02, 0.04, 0.08, 0.16)


def run_id(now: datetime | None = None) -> str:
    now = now or datetime.now(timezone.utc)
    return now.strftime("%Y%m%dT%H%M%SZ") + "-" + secrets.token_hex(4)


def code_span(text: str) -> str:
    """text as inline code: a fence longer than any run of backticks inside."""
    longest = max((len(m) for m in re.findall("`+", text)), default=0)
    fence, pad = "`" * (longest + 1), " " if text[:1] == "`" or text[-1:] == "`" else ""
    return f"{fence}{pad}{text}{pad}{fence}"


def escape(text: str) -> str:
    """text with Markdown's marks escaped, on one line."""
    return re.sub(r"([\\`*_{}\[\]()#+.!|<>-])", r"\\\1", re.sub(r"\s+", " ", text)).strip()


def number(value: float) -> str:
    """At most two decimals, none that are zero."""
    return f"{value:.2f}".rstrip("0").rstrip(".")


def link(path: str) -> str:
    return "/".join(quote(p) for p in path.split("/"))


def ordered(findings: DataFrame) -> DataFrame:
    """Findings in their canonical order, with ids."""
    f = findings.withColumn("id", finding_id(*[F.col(k) for k in KEY]))
    return f.orderBy("project_path", "source_path", "start_line", "subject_id", "discriminator")


def totals(findings: DataFrame, by: list[str]) -> DataFrame:
    """(by..., findings, projects, files): findings, distinct projects and distinct files."""
    return findings.groupBy(*by).agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("project_path").alias("projects"), F.count_distinct("project_path", "source_path").alias("files"))


def _index(counts: dict[str, tuple[int, int, int]], by_area: dict[str, int], options: dict | None) -> str:
    """The root page: what was run and found, and where the rest is. Its size goes with the number of analyses."""
    out = ["# Review", "", "Findings are candidates to look at, not defects.", "", "## Areas", "", "| Area | Findings |", "| --- | ---: |"]
    out += [f"| [{a}]({a}/index.md) | {by_area.get(a, 0)} |" for a in pages.AREAS]
    out += ["", "## Maps", "", "- [Findings by file](maps/audit/index.md)", "- [Projects](maps/projects.md)", "", "## Analyses", ""]
    out += [f"- {escape(n)}: {c[0]} findings in {c[2]} files of {c[1]} projects" if c[0] else f"- {escape(n)}: none" for n, c in counts.items()]
    if options:
        out += ["", "## Options", "", "```json", json.dumps(options, sort_keys=True, indent=2), "```"]
    return "\n".join(out)


def report_rows(found: dict[str, DataFrame], options: dict | None, tables: dict[str, DataFrame]) -> DataFrame:
    """All pages of the report as rows (page, at, text)."""
    every = reduce(DataFrame.unionByName, [found[n] for n in sorted(found)])
    documents = tables["documents"]
    placed = cut(pages.placed(every, documents))
    counts = {name: (0, 0, 0) for name in sorted(found)} | {r[0]: tuple(r)[1:] for r in totals(placed, ["analysis_id"]).orderBy("analysis_id").collect()}
    by_area = {r["area"]: r["count"] for r in placed.groupBy("area").count().collect()}
    spark = every.sparkSession
    index = pages._rows(spark.createDataFrame([(_index(counts, by_area, options),)], "t string"), "index.md", F.col("t"), 0)
    projects = tables["projects"].select("project_path", F.coalesce("project_refs", F.array().cast("array<string>")).alias("references"))
    files = documents.select("project_path", "source_path", "role", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    edges = tables["type_edges"].select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).where("a <> b")
    maps = pages.project_maps(projects, files, tables["types"], tables["type_declarations"], edges)
    return reduce(DataFrame.unionByName, [index, pages.area_pages(placed), pages.finding_pages(placed), pages.audit_map(placed), maps])


def publish(found: dict[str, DataFrame], output: str | Path, options: dict | None = None, tables: dict[str, DataFrame] | None = None) -> Path:
    """Writes the report below output, which all executors share, and returns its folder; a failure leaves nothing behind.

    The folder is made aside by the tasks that write its pages and renamed when all are done; if
    the name is taken, another is drawn. tables are the facts that areas and maps are made from.
    """
    output = Path(output).resolve()
    output.mkdir(parents=True, exist_ok=True)
    if not found:
        raise ValueError("no analysis was run")
    tables = tables or facts.empty(next(iter(found.values())).sparkSession)
    rows = report_rows(found, options, tables)
    for wait in (*RETRIES, None):
        name = run_id()
        aside = output / f".report-tmp-{name}"
        try:
            aside.mkdir()
            pages.write(rows, aside, output / name)
            return output / name
        except OSError as e:
            shutil.rmtree(aside, ignore_errors=True)
            # Locks pass; a full disk or a missing folder doesn't.
            if wait is None or e.errno not in (errno.EACCES, errno.EBUSY, errno.EAGAIN, errno.ETXTBSY):
                raise
            time.sleep(wait)
    raise AssertionError
