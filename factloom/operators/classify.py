"""Roles of projects and origins of documents, from names, paths and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the classification rules.
TEST_ASSEMBLY_PREFIXES = ["xunit", "nunit", "mstest", "microsoft.testplatform", "microsoft.visualstudio.testplatform", "microsoft.visualstudio.testtools.unittesting", "microsoft.testing"]
TEST_NAME_SUFFIXES = ["Tests", "Test", "UnitTests", "UnitTest", "IntegrationTests", "IntegrationTest", "FastTests", "ComponentTests", "TestKit", "Specs", "Spec"]
TEST_PATH_SEGMENTS = ["test", "tests", "unittests", "integrationtests", "fasttests", "componenttests", "testkit", "spec", "specs"]
GENERATED_FILE_SUFFIXES = [".g.cs", ".g.i.cs", ".generated.cs", ".designer.cs"]
GENERATED_MARKER = "<auto-generated"
HEADER_LINES = 5


def has_test_suffix(name: Column) -> Column:
    """name ends with a suffix (any case) that is all of it, follows a dot or begins in upper case."""
    ends = F.lit(False)
    for s in TEST_NAME_SUFFIXES:
        at = F.length(name) - len(s) + 1
        start = F.substring(name, at, F.lit(1))
        before = F.when(at > 1, F.substring(name, at - 1, F.lit(1)))
        ok = (at == 1) | (before == ".") | start.rlike(r"^\p{Lu}")
        ends = ends | ((at >= 1) & F.lower(name).endswith(s.lower()) & ok)
    return F.coalesce(ends, F.lit(False))


def is_test_assembly(path: Column) -> Column:
    """The file name without its last extension begins with a test framework's prefix (any case)."""
    name = F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1), r"\.[^.]*$", "")
    return F.lower(name).rlike("^(" + "|".join(p.replace(".", r"\.") for p in TEST_ASSEMBLY_PREFIXES) + ")")


def has_test_segment(path: Column) -> Column:
    """A directory or file of the path has one of the test names (any case)."""
    return F.arrays_overlap(F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/"), F.array(*map(F.lit, TEST_PATH_SEGMENTS)))


def project_role(name: Column, path: Column, references: Column) -> tuple[Column, Column]:
    """(role, reason): the first of reference, name, file name and path that marks tests, else Production."""
    file_name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    reason = (
        F.when(F.coalesce(F.exists(references, is_test_assembly), F.lit(False)), "TestReferenceAssembly")
        .when(has_test_suffix(name), "ProjectNameSuffix")
        .when(has_test_suffix(file_name), "ProjectFileNameSuffix")
        .when(F.coalesce(has_test_segment(path), F.lit(False)), "ProjectPathSegment")
        .otherwise("NoTestMarker")
    )
    return F.when(reason != "NoTestMarker", "Tests").otherwise("Production"), reason


def is_generated(path: Column, text: Column) -> Column:
    """A generated document: by folder, by file name, or by a marker in its first lines."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    by_name = F.lit(False)
    for s in GENERATED_FILE_SUFFIXES:
        by_name = by_name | p.endswith(s)
    head = F.slice(F.split(text, "\r\n|\r|\n", -1), 1, HEADER_LINES)
    marked = F.exists(head, lambda line: F.contains(F.lower(line), F.lit(GENERATED_MARKER)))
    return F.contains(p, F.lit("/obj/")) | p.startswith("obj/") | by_name | F.coalesce(marked, F.lit(False))


def is_canonical_path(path: Column) -> Column:
    """Relative, with / between segments, none of which is empty, . or .. ."""
    bad = F.exists(F.split(path, "/", -1), lambda s: s.isin("", ".", ".."))
    return path.isNotNull() & ~F.contains(path, F.lit("\\")) & ~bad
