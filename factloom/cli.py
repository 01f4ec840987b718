"""Command line: reviews a folder of fact tables and publishes the report.

    python -m factloom.cli FACTS [--config FILE] [--output FOLDER]

Prints one JSON line: to stdout with the report's folder and counts, or to stderr with an error.
Exit codes: 0 done, 2 input not valid, 3 analysis failed or its findings break a rule, 4 report not
written, 130 interrupted, which ends what Spark still runs. Unless it is 0, nothing is published.
"""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from pathlib import Path

from pyspark.sql import Observation
from pyspark.sql import functions as F

from .analyses import READS, RunFacts, registry
from .operators import sizes
from .operators.findings import checked
from .options import InvalidOptions
from .runtime import cut, drop
from .sources import config as configuration
from .sources import facts, report


class Failed(Exception):
    def __init__(self, code: int, kind: str, why: str):
        super().__init__(why)
        self.code, self.kind = code, kind


def review(folder: str, config: str | None, output: str | None, spark=None) -> dict:
    from .runtime import session

    root = Path(folder)
    if not root.is_dir():
        raise Failed(2, "INVALID_INPUT", f"{folder} is no folder")
    known = registry()
    try:
        text = Path(config).read_text(encoding="utf-8") if config else configuration.default("facts", known)
        settings = configuration.parse(text, known)
    except (InvalidOptions, OSError) as e:
        raise Failed(2, "INVALID_INPUT", str(e)) from e
    names = [n for n in facts.SCHEMAS if (root / f"{n}.parquet").exists()]
    if not names:
        raise Failed(2, "INVALID_INPUT", f"no fact tables in {folder}")
    spark = spark or session("review")
    tag, found, counts = None, {}, {}
    try:
        try:
            tables = facts.read(spark, folder, names, [t for a, on, _ in settings["analyses"] if on for t in ("documents", *READS[a.descriptor.id])])
        except ValueError as e:
            raise Failed(2, "INVALID_INPUT", str(e)) from e
        facts_of_run = RunFacts(tables)
        spark.addTag(tag := f"review-{uuid.uuid4().hex}")
        documents = tables["documents"].select("project_path", "source_path", sizes.line_count(F.coalesce("text", F.lit(""))).alias("lines"))
        for a, on, options in settings["analyses"]:
            if on:
                seen = Observation()
                found[a.descriptor.id] = cut(checked(a.run(facts_of_run, options), documents, seen))
                counts[a.descriptor.id] = seen.get["findings"]
                if broken := {k: v for k, v in seen.get.items() if k != "findings" and v}:
                    raise Failed(3, "INVALID_FINDINGS", f"{a.descriptor.id}: " + ", ".join(f"{v} {k}" for k, v in sorted(broken.items())))
        options = {a.descriptor.id: {"enabled": on, "options": o.general, "testOptions": o.tests} for a, on, o in settings["analyses"]}
        try:
            out = report.publish(found, output or root / settings["outputDirectory"], options, tables)
        except OSError as e:
            raise Failed(4, "REPORT_FAILED", str(e)) from e
    except Failed:
        raise
    except KeyboardInterrupt:
        if tag:
            spark.interruptTag(tag)  # stages that run on are of no use
        raise
    except Exception as e:
        raise Failed(3, "ANALYSIS_FAILED", str(e).split("\n")[0]) from e
    finally:
        if tag:
            spark.removeTag(tag)
            facts_of_run.artifacts.close()
        for df in found.values():
            drop(df)
    return {"report": str(out), "findings": counts}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom", description=__doc__.split("\n")[0])
    parser.add_argument("facts")
    parser.add_argument("--config")
    parser.add_argument("--output")
    own = parser.parse_args(args)
    try:
        print(json.dumps(review(own.facts, own.config, own.output), sort_keys=True))
        return 0
    except Failed as e:
        print(json.dumps({"error": e.kind, "message": str(e)}), file=sys.stderr)
        return e.code
    except KeyboardInterrupt:
        print(json.dumps({"error": "CANCELLED"}), file=sys.stderr)
        return 130


if __name__ == "__main__":
    sys.exit(main())
