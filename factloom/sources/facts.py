"""Fact tables: their schemas, readers of table folders and of source text trees."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify

SCHEMAS = {
    "projects": "project_path string, project_name string, metadata_refs array<string>, project_refs array<string>",
    "documents": "project_path string, source_path string, role string, text string, is_source_generated boolean",
    "members": "project_path string, source_path string, role string, symbol_id string, kind string, start_line int, lines long, decisions long, constructs long, nesting long",
    "type_parts": "project_path string, source_path string, role string, symbol_id string, start_line int, lines long",
    "body_tokens": "project_path string, source_path string, owner_id string, line int, tokens array<string>",
    "statements": "project_path string, source_path string, owner_id string, list_id int, ordinal long, form string, tokens long, eligible boolean, nested_executable boolean, binding_barrier boolean, parts array<struct<category:string,text:string,symbol:string,type_key:string>>",
    "types": "type_id string, project_path string, is_test boolean",
    "type_declarations": "type_id string, project_path string, source_path string, start_line int",
    "type_edges": "from_id string, to_id string, kind int, project_path string, source_path string, start int",
    "forwarders": "project_path string, symbol_id string, type_id string, source_path string, decl_line int, target_symbol_id string, call_line int",
    "functions": "symbol_id string, project_path string, source_path string, start_line int, is_test boolean, is_root boolean, decisions long, nesting long",
    "calls": "from_id string, to_id string, kind string",
    "operations": "symbol string, kind string, target string, getter string, setter string, place string, is_nameof boolean, is_call_syntax boolean, candidates array<string>, source_path string, start int",
    "methods": "symbol string, definition string, identity string, is_sealed boolean, is_virtual boolean, is_abstract boolean, is_override boolean, container_kind string",
    "call_uncertainty": "symbol_id string, affected_symbol_id string, is_global boolean",
    "declarations": "project_path string, source_path string, symbol_id string, kind string, name string, parent_symbol_id string, accessibility string, attributes array<string>, start_line int",
    "references": "symbol_id string, kind string, project_path string, source_path string, start int, is_self boolean",
    "protected": "symbol string",
    "entry_points": "symbol string",
    "markup": "file_path string, text string",
    "symbols": "symbol string, symbol_kind string, name string, type string, assembly string, project string, is_source boolean, is_static boolean, accessibility string, first_parameter string, overrides string, overrides_source boolean, value_core string, value_wraps int, method_kind string, is_implicit boolean, container_kind string, full_name string, value_type string",
    "contracts": "type string, contract string, contract_source boolean, member_source boolean, implementation string, arguments array<string>",
    "base_types": "type string, base string",
    "invocations": "project string, assembly string, target_type string, target_name string, target_source boolean, typeof_type string, has_name_parameter boolean, name string, type_arguments array<string>, argument_types array<string>",
    "attributes": "id string, project string, owner string, owner_kind string, owner_type string, classes array<struct<name:string,assembly:string,is_source:boolean,version:string>>, interfaces array<struct<name:string,assembly:string,is_source:boolean,version:string>>, types array<string>, text string, named_types map<string,string>, named_texts map<string,string>, is_error boolean",
    "reference_uncertainty": "symbol string",
}


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def read(spark: SparkSession, folder: str, names: list[str] | None = None, needed: list[str] | None = None) -> dict[str, DataFrame]:
    """The named fact tables of a folder, <folder>/<name>.parquet each, by schema; others are empty.

    A table that is needed and not among names is an error: no findings from facts that were never
    given.
    """
    if missing := sorted(set(needed or []) - set(names or [])):
        raise ValueError(f"fact tables missing: {', '.join(missing)}")
    tables = empty(spark)
    for name in names or []:
        tables[name] = spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")
    return tables


def _files(spark: SparkSession, folder: str, endings: list[str]) -> DataFrame:
    """(source_path, length, content) of the files below folder with one of the endings, paths relative to it.

    Spark lists and reads the files; nothing is opened on the driver. Spark's readers skip files
    without bytes, so these are listed by name.
    """
    glob = "*{" + ",".join(endings) + "}"
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).format("binaryFile").load(folder).select("path", "length", "content")
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    bare, listed = [], fs.listFiles(top, True)
    while listed.hasNext():
        status = listed.next()
        hidden = any(part[:1] in "_." for part in status.getPath().toString()[len(fs.makeQualified(top).toString()) :].split("/") if part)
        if status.getLen() == 0 and not hidden and status.getPath().getName().endswith(tuple(endings)):
            bare.append((status.getPath().toString(), 0, b""))
    if bare:
        files = files.unionByName(spark.createDataFrame(bare, "path string, length long, content binary"))
    root = F.lit(re.sub("^[a-z]+:/*", "/", fs.makeQualified(top).toString().rstrip("/")))
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    return files.select(F.substring(path, F.length(root) + 2, F.length(path)).alias("source_path"), "length", "content")


def read_text_tree(spark: SparkSession, folder: str, ending: str = ".cs") -> DataFrame:
    """(source_path, text, generated) of the files below folder, whole texts, paths relative to it."""
    rows = _files(spark, folder, [ending]).select("source_path", F.decode("content", "UTF-8").alias("text"))
    return rows.withColumn("generated", classify.is_generated(F.col("source_path"), F.col("text")))


def markup(spark: SparkSession, folder: str, most_files: int = 2000, most_bytes: int = 1 << 20) -> DataFrame:
    """(file_path, text) of .razor, .xaml and .js files outside build and tool folders, paths relative to folder.

    More files or bytes than allowed are an error; nothing is dropped.
    """
    files = _files(spark, folder, [".razor", ".xaml", ".js"])
    # The folders count below the root only, wherever the root lies.
    files = files.where(~F.col("source_path").rlike(r"(?i)(^|/)(\.codex|\.git|bin|generated|node_modules|obj|temp)/"))
    n, largest = files.agg(F.count(F.lit(1)), F.coalesce(F.max("length"), F.lit(0))).first()
    if n > most_files or largest > most_bytes:
        raise ValueError(f"{n} markup files of up to {largest} bytes; at most {most_files} of {most_bytes} are read")
    return files.select(F.col("source_path").alias("file_path"), F.decode("content", "UTF-8").alias("text"))
