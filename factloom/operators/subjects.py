"""Which declarations an analysis looks at, who owns them, and how they are told apart and ordered.

Inputs are fact rows; symbols, projects and paths are strings. Operators that need a row for each
of theirs raise instead of dropping what has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .graphs import MAX_ROUNDS, ancestors

# Kinds of declarations, and full names of attributes.
EXECUTABLE = ("method", "constructor", "accessor", "operator", "conversion", "destructor", "property", "indexer")
BODIES = ("method", "constructor", "accessor", "local-function")
NAMED = ("namespace", "class", "record", "struct", "interface", "enum", "enum-member", "method", "property", "variable", "parameter", "local-function")
TYPES = ("type", "class", "record", "struct", "interface", "enum", "delegate")
GENERATED = ("System.CodeDom.Compiler.GeneratedCodeAttribute", "System.Runtime.CompilerServices.CompilerGeneratedAttribute")
XUNIT = ("Xunit.FactAttribute", "Xunit.TheoryAttribute", "Xunit.v3.IFactAttribute")
NUNIT = ("NUnit.Framework.TestAttribute", "NUnit.Framework.TestCaseAttribute", "NUnit.Framework.TestCaseSourceAttribute")
MSTEST = ("Microsoft.VisualStudio.TestTools.UnitTesting.TestMethodAttribute", "Microsoft.VisualStudio.TestTools.UnitTesting.DataTestMethodAttribute")
MSTEST_CLASS = "Microsoft.VisualStudio.TestTools.UnitTesting.TestClassAttribute"
NUNIT_FIXTURE = "NUnit.Framework.TestFixtureAttribute"
EXCLUDED = ("NUnit.Framework.IgnoreAttribute", "NUnit.Framework.ExplicitAttribute", "Microsoft.VisualStudio.TestTools.UnitTesting.IgnoreAttribute")


def _any(values: Column, wanted: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(values, F.array(*map(F.lit, wanted))), F.lit(False))


def generated_symbols(declarations: DataFrame, parents: DataFrame) -> DataFrame:
    """(node) of symbols that carry an attribute of GENERATED, or lie in a type that does, however deep.

    declarations has node and attributes, parents node and parent (null at the top).
    """
    marked = declarations.where(_any(F.col("attributes"), GENERATED)).select(F.col("node").alias("ancestor")).distinct()
    return ancestors(parents).join(marked, "ancestor", "left_semi").select("node").distinct()


def executable_members(members: DataFrame) -> DataFrame:
    """members of executable kinds that have a body; properties and indexers only with an expression as body."""
    bare = F.col("kind").isin("property", "indexer")
    return members.where(F.col("kind").isin(*EXECUTABLE) & F.col("has_body") & (~bare | F.col("is_expression_bodied")))


def duplicate_bodies(members: DataFrame) -> DataFrame:
    """members whose bodies are compared for likeness: operators, conversions and destructors aren't."""
    return members.where(F.col("kind").isin(*BODIES) & F.col("has_body"))


def candidate_methods(methods: DataFrame, generated: DataFrame) -> DataFrame:
    """methods that may be reported as unused: ordinary, written, neither of an interface nor
    implementing one nor overriding, and not generated (node)."""
    plain = (F.col("method_kind") == "ordinary") & ~F.col("is_implicit") & (F.col("container_kind") != "interface") & ~F.col("is_override") & ~F.col("implements_interface")
    return methods.where(plain).join(generated.select("node"), "node", "left_anti")


def named_declarations(declarations: DataFrame) -> DataFrame:
    """declarations whose names are looked at; event fields aren't."""
    return declarations.where(F.col("kind").isin(*NAMED))


def transparent_forwarders(methods: DataFrame) -> DataFrame:
    """methods whose only statement passes their arguments on, in order and as they are, to an
    ordinary, written method of another type in the same assembly and project."""
    own = ~(F.col("is_async") | F.col("is_abstract") | F.col("is_extern")) & F.col("is_single_invocation")
    target = (F.col("target_kind") == "ordinary") & ~F.col("target_is_extension") & ~F.col("target_is_generated") & F.lower("target_path").endswith(".cs")
    place = (F.col("target_type") != F.col("type")) & (F.col("target_assembly") == F.col("assembly")) & (F.col("target_project") == F.col("project"))
    same = F.col("has_allowed_receiver") & F.col("has_identity_return") & F.col("forwards_all_arguments")
    return methods.where(own & target & place & same)


def active_test_roots(methods: DataFrame, attributes: DataFrame, parents: DataFrame) -> DataFrame:
    """(node) of test methods that run: methods has node and is_test_project.

    attributes has node (a method or type), names (the attribute's class, its bases and interfaces)
    and arguments (named values as text). A method or a type around it that is ignored or explicit
    rules the method out. xUnit's own attribute counts unless it is explicit, or skipped without a
    condition; an MSTest method needs a test class around it.
    """
    a = attributes.select("node", "names", "arguments")
    value = lambda k: F.coalesce(F.element_at("arguments", k), F.lit(""))
    fixture = _any(F.col("names"), (NUNIT_FIXTURE,)) & ((value("Ignore") != "") | (value("Explicit") == "true"))
    # The method itself, and the types around it.
    out = a.where(_any(F.col("names"), EXCLUDED)).select(F.col("node").alias("ancestor")).distinct()
    types = a.where(fixture).select(F.col("node").alias("ancestor")).distinct()
    around = ancestors(parents)
    ruled = around.join(out, "ancestor", "left_semi").select("node").unionByName(around.where("depth > 0").join(types, "ancestor", "left_semi").select("node")).distinct()
    given = lambda k: F.element_at("arguments", k).isNotNull()
    skipped = (value("Explicit") == "true") | (given("Skip") & ~given("SkipWhen") & ~given("SkipUnless"))
    active = a.where((_any(F.col("names"), XUNIT) & ~skipped) | _any(F.col("names"), NUNIT)).select("node")
    classes = a.where(_any(F.col("names"), (MSTEST_CLASS,))).select(F.col("node").alias("parent")).distinct()
    ms = a.where(_any(F.col("names"), MSTEST)).select("node").join(parents, "node").join(classes, "parent", "left_semi").select("node")
    found = active.unionByName(ms).distinct()
    return methods.where("is_test_project").select("node").join(found, "node", "left_semi").join(ruled, "node", "left_anti")


def entry_chain(entries: DataFrame, parents: DataFrame) -> DataFrame:
    """(node): the entry points (node) and every type around them."""
    return ancestors(parents).join(entries.select("node"), "node", "left_semi").select(F.col("ancestor").alias("node")).distinct()


def without_projects(candidates: DataFrame, excluded: DataFrame) -> DataFrame:
    """candidates outside the projects (project) left out whole."""
    return candidates.join(excluded.select("project"), "project", "left_anti")


def scope_exclusions(excluded: DataFrame) -> DataFrame:
    """(project, reason), each once: what the report says was left out."""
    return excluded.select("project", "reason").distinct()


def project_references(projects: DataFrame) -> DataFrame:
    """(project, target): direct references (references) among the projects given, themselves aside, each once."""
    rows = projects.select("project", F.explode("references").alias("target")).where("project <> target").distinct()
    return rows.join(projects.select(F.col("project").alias("target")), "target", "left_semi").select("project", "target")


def reference_areas(projects: DataFrame, references: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(origin, project): every project with itself and all that its references (project, target) lead to."""
    r = cut(references.select("project", "target").distinct())
    seen = cut(projects.select(F.col("project").alias("origin"), "project").distinct())
    frontier = seen
    for _ in range(max_rounds):
        step = frontier.join(r, "project").select("origin", F.col("target").alias("project")).distinct()
        frontier = cut(step.join(seen, ["origin", "project"], "left_anti"))
        if frontier.limit(1).count() == 0:
            return seen
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError("references didn't end")


def resolved_owners(symbols: DataFrame, owners: DataFrame) -> DataFrame:
    """symbols (symbol, assembly, ...) with the one project whose assembly declares them.

    None or several projects (project, assembly) for one of the assemblies named is an error.
    """
    wanted = symbols.select("assembly").distinct()
    counted = wanted.join(owners.select("project", "assembly").distinct(), "assembly", "left").groupBy("assembly").agg(F.count("project").alias("n"), F.min("project").alias("project"))
    counted = cut(counted)
    bad = [r["assembly"] for r in counted.where("n <> 1").orderBy("assembly").limit(3).collect()]
    if bad:
        raise ValueError(f"not one owner for {', '.join(map(str, bad))}")
    return symbols.join(counted.select("assembly", "project"), "assembly")


def same_identity(symbols: DataFrame, declared: DataFrame, key: list[str]) -> DataFrame:
    """symbols joined to the declared rows of their key, where exactly one has it on the declared side.

    An identity that several declarations share is none: its symbols are left out.
    """
    once = declared.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return symbols.join(declared.join(once, key, "left_semi"), key)


def type_map(types: DataFrame, declarations: DataFrame) -> DataFrame:
    """(type, name, namespace, files): each type with its sources, distinct and sorted; one without any is an error."""
    files = declarations.groupBy("type").agg(F.sort_array(F.collect_set("source_path")).alias("files"))
    joined = cut(types.select("type", "name", "namespace").join(files, "type", "left"))
    if joined.where("files is null").limit(1).count():
        raise ValueError("a type has no declaration")
    return joined


def mapped_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(from_id, to_id) of edges (a, b), each once, by the ids (node, id) of the map; an endpoint without one is an error."""
    e = cut(edges.select("a", "b").distinct())
    ends = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    if ends.join(ids.select("node"), "node", "left_anti").limit(1).count():
        raise ValueError("an edge ends at a type that the map doesn't have")
    a, b = ids.select(F.col("node").alias("a"), F.col("id").alias("from_id")), ids.select(F.col("node").alias("b"), F.col("id").alias("to_id"))
    return e.join(a, "a").join(b, "b").select("from_id", "to_id")


def one_declaration(parts: DataFrame, key: list[str]) -> DataFrame:
    """One row of parts for each key: with a body first, then by path and offset, nulls last; of rows equal in these any one."""
    order = F.struct((~F.coalesce("has_body", F.lit(False))).alias("bare"), F.col("source_path").isNull().alias("no_path"), "source_path", F.col("offset").isNull().alias("no_offset"), "offset")
    return parts.groupBy(*key).agg(F.min_by(F.struct(*[F.col(c) for c in parts.columns if c not in key]), order).alias("_at")).select(*[c if c in key else F.col("_at")[c].alias(c) for c in parts.columns])


def first_documents(documents: DataFrame, fold_case: bool = False) -> DataFrame:
    """documents that aren't generated and end in .cs, the first by path, name and id for each physical path of a project."""
    kept = documents.where(~F.col("generated") & F.lower("path").endswith(".cs"))
    place = F.lower("path") if fold_case else F.col("path")
    order = F.struct("path", "name", "id")
    return kept.withColumn("_place", place).groupBy("project", "_place").agg(F.min(order).alias("at")).select("project", "at.*")


def cluster_order(clusters: DataFrame) -> DataFrame:
    """clusters (cluster, score) with rank: larger scores first, then by their first member's project, source, line and identity.

    The report lists clusters in this order, so ranks are over all of them.
    """
    w = Window.orderBy(F.desc("score"), "project_path", "source_path", "line", "identity")
    return clusters.withColumn("rank", F.row_number().over(w).cast("long"))


def occurrence_order(group: list[str]) -> Column:
    """The place of an occurrence in its group: by project, source, owner, offset and length."""
    return F.row_number().over(Window.partitionBy(*group).orderBy("project_path", "source_path", "owner_id", "first", "length")).cast("long")


def all_uncertain(findings: DataFrame, by: list[str]) -> DataFrame:
    """(by..., all_uncertain): whether each finding is marked; the mark then goes to the head of the report."""
    return findings.groupBy(*by).agg(F.bool_and(F.coalesce("uncertain", F.lit(False))).alias("all_uncertain"))


def inside(root: str, path: Column) -> Column:
    """path below root with / as separator; an error if it leaves it."""
    plain = F.regexp_replace(path, r"\\", "/")
    own = F.lit(root.rstrip("/") + "/")
    bad = ~F.startswith(plain, own) | plain.rlike(r"(^|/)\.\.(/|$)")
    return F.when(bad, F.raise_error(F.concat(F.lit("not below the root: "), path)).cast("string")).otherwise(F.substring(plain, F.length(own) + 1, F.length(plain)))
