"""The ten analyses as compositions of operators over fact tables.

Facts are DataFrames by name, see sources.facts.SCHEMAS. Each analysis returns findings with the
key columns of operators.findings.KEY, start_line and metrics (map<string,double>).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import calls, classify, fragments, graphs, identifiers, markup, percentiles, protection, references, similarity, sizes, subjects
from .options import Analysis, Descriptor, Effective, Option, Registry
from .runtime import Artifacts, cut

Facts = Mapping[str, DataFrame]


class RunFacts(dict):
    """Fact tables of one run, with what its analyses share."""

    def __init__(self, tables: Facts) -> None:
        super().__init__(tables)
        self.artifacts = Artifacts()


def _shared(facts: Facts, name: str, build) -> DataFrame:
    """What build gives, once a run where facts are a run's."""
    return facts.artifacts.get(name, build) if isinstance(facts, RunFacts) else build()


#: The fact tables that each analysis reads.
READS = {
    "method-control-flow-outliers": ("members",),
    "code-size-candidates": ("documents", "members", "type_parts"),
    "duplicate-code-candidates": ("body_tokens",),
    "structural-duplication-candidates": ("statements",),
    "type-dependency-cycle-candidates": ("type_declarations", "type_edges", "types"),
    "type-dependency-hub-candidates": ("type_declarations", "type_edges", "types"),
    "indirection-drift-candidates": ("forwarders",),
    "missing-test-evidence-candidates": ("attributes", "call_uncertainty", "calls", "declarations", "documents", "functions", "methods", "operations", "symbols"),
    "dead-code-candidates": ("attributes", "base_types", "contracts", "declarations", "documents", "entry_points", "invocations", "markup", "projects", "protected", "reference_uncertainty", "references", "symbols"),
    "non-ascii-identifiers": ("declarations",),
}


def _whole(low: int, high: int | None = None):
    return lambda v: isinstance(v, int) and v >= low and (high is None or v <= high)


def _by_role(options: Effective, name: str) -> Column:
    return F.when(F.col("role") == "Tests", F.lit(options.tests[name])).otherwise(F.lit(options.general[name]))


def _finding(df: DataFrame, analysis: str, discriminator: Column | str, subject: str, metrics: dict[str, Column | str]) -> DataFrame:
    pairs = [x for k, v in sorted(metrics.items()) for x in (F.lit(k), (F.col(v) if isinstance(v, str) else v).cast("double"))]
    bag = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    kind = F.lit(discriminator) if isinstance(discriminator, str) else discriminator
    return df.select(F.lit(analysis).alias("analysis_id"), "project_path", "source_path", F.col(subject).cast("string").alias("subject_id"), kind.alias("discriminator"), F.col("start_line").cast("int").alias("start_line"), bag.alias("metrics"))


def control_flow_outliers(facts: Facts, o: Effective) -> DataFrame:
    m = facts["members"].where("kind = 'method'")
    out = percentiles.outliers(m, ["project_path"], "decisions", "nesting", "constructs", ["symbol_id"], _by_role(o, "percentile"))
    return _finding(out, "method-control-flow-outliers", "control-flow-outlier", "symbol_id", {"decisionCount": "decisions", "maximumNesting": "nesting", "constructCount": "constructs", "groupSize": "population", "decisionCutoff": "first_cutoff", "nestingCutoff": "second_cutoff", "decisionRank": "first_rank", "nestingRank": "second_rank"})


def code_size(facts: Facts, o: Effective) -> DataFrame:
    def split(f, df: DataFrame) -> DataFrame:
        parts = [f(df.where((F.col("role") == "Tests") == (role == "Tests")), o.of(role)) for role in ("Production", "Tests")]
        return parts[0].unionByName(parts[1])

    a = "code-size-candidates"
    members = split(lambda d, v: sizes.select_members(d, ["project_path"], ["symbol_id"], F.lit(v["percentile"]), v["minMember"], v["extremeMember"]), facts["members"])
    out = _finding(members, a, "member-size", "symbol_id", {"codeLines": "lines", "cutoff": "cutoff", "groupSize": "population", "byGroup": F.col("by_group").cast("int"), "byExtreme": F.col("by_extreme").cast("int")})
    first = facts["type_parts"].groupBy("project_path", "symbol_id").agg(F.min_by(F.struct("source_path", "start_line"), F.struct("source_path", "start_line")).alias("at"))
    types = split(lambda d, v: sizes.select_types(d, ["project_path"], ["symbol_id"], F.lit(v["percentile"]), v["minType"], v["extremeType"]), facts["type_parts"])
    types = types.join(first, ["project_path", "symbol_id"]).select("*", "at.source_path", "at.start_line")
    out = out.unionByName(_finding(types, a, "type-size", "symbol_id", {"codeLines": "lines", "partCount": "parts", "cutoff": "cutoff", "groupSize": "population"}))
    files = split(lambda d, v: sizes.select_files(d, "text", v["extremeFileLines"], v["extremeFileUtf8Bytes"]), facts["documents"]).withColumn("start_line", F.lit(1))
    return out.unionByName(_finding(files, a, "file-size", "source_path", {"lineCount": "lines", "utf8Bytes": "utf8_bytes"}))


def duplicate_code(facts: Facts, o: Effective) -> DataFrame:
    bodies = facts["body_tokens"]
    sets = similarity.gram_sets(bodies, "owner_id", "tokens", o.general["minTokens"])
    found = similarity.clusters(similarity.similar_pairs(sets, similarity.LEVELS[o.general["minimumSimilarity"]]))
    # The member that stands for a cluster is the first by project, source, line and identity.
    place = F.struct("project_path", "source_path", F.col("line").alias("start_line"), F.col("owner_id").alias("subject"))
    at = bodies.select(F.col("owner_id").alias("member"), place.alias("at"))
    least = F.lit(similarity.LEVELS[o.general["minimumSimilarity"]])
    rows = found.join(at, "member").groupBy("cluster_id", "score").agg(F.count(F.lit(1)).alias("members"), F.min("at").alias("at")).select("*", "at.*").withColumn("threshold", least)
    return _finding(rows, "duplicate-code-candidates", "duplicate-code-cluster", "subject", {"memberCount": "members", "similarityScore": "score", "minimumSimilarityThreshold": "threshold"})


def structural_duplication(facts: Facts, o: Effective) -> DataFrame:
    key = ["project_path", "source_path", "owner_id"]
    found = fragments.maximal(fragments.groups(fragments.shared_windows(fragments.barred(facts["statements"]), key, 3, 60), key, once=True), key)
    first = found.groupBy("group", "owners", "occurrences", "tokens").agg(F.min_by(F.struct(*key, F.col("first").alias("first"), (F.col("last") - F.col("first") + 1).alias("n")), F.struct(*key, "first")).alias("x"))
    rows = first.select("*", "x.*").withColumn("start_line", F.col("first"))
    kind = F.concat_ws(":", F.lit("structural-duplicate"), F.col("first").cast("string"), F.col("n").cast("string"))
    return _finding(rows, "structural-duplication-candidates", kind, "owner_id", {"tokenCount": "tokens", "statementCount": "n", "memberCount": "occurrences", "executableCount": "owners"})


def _type_edges(facts: Facts) -> tuple[DataFrame, DataFrame]:
    e = _shared(facts, "type_edges", lambda: _bound_edges(facts))
    return e.where("not from_test").select("a", "b").distinct(), e.where("from_test").select("a", "b").distinct()


def _bound_edges(facts: Facts) -> DataFrame:
    """(a, b, from_test), each once: edges between types of the solution, none to itself or to a test's type."""
    types = facts["types"]
    e = facts["type_edges"].join(types.select(F.col("type_id").alias("from_id"), F.col("is_test").alias("from_test")), "from_id").join(types.select(F.col("type_id").alias("to_id"), F.col("is_test").alias("to_test")), "to_id").where("from_id <> to_id and not to_test")
    return e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "from_test").distinct()


def dependency_cycles(facts: Facts, o: Effective) -> DataFrame:
    edges, _ = _type_edges(facts)
    files = facts["type_declarations"].select(F.col("type_id").alias("node"), F.col("source_path").alias("file"), F.col("project_path").alias("project"))
    found = graphs.qualified_components(graphs.strong_components(edges), edges, files)
    at = facts["type_declarations"].groupBy(F.col("type_id").alias("component")).agg(F.min(F.struct("project_path", "source_path", "start_line")).alias("at"))
    rows = found.join(at, "component").select("*", "at.*")
    return _finding(rows, "type-dependency-cycle-candidates", "strongly-connected-production-type-group", "component", {"typeCount": "nodes", "fileCount": "files", "projectCount": "projects", "internalEdgeCount": "internal_edges"})


def dependency_hubs(facts: Facts, o: Effective) -> DataFrame:
    edges, tests = _type_edges(facts)
    found = graphs.hubs(edges, tests, o.general["minFanIn"], o.general["minFanOut"])
    at = facts["type_declarations"].groupBy(F.col("type_id").alias("node")).agg(F.min(F.struct("project_path", "source_path", "start_line")).alias("at"))
    return _finding(found.join(at, "node").select("*", "at.*"), "type-dependency-hub-candidates", "production-type-dependency-hub", "node", {"fanIn": "fan_in", "fanOut": "fan_out", "testConsumers": "test_consumers"})


def indirection_drift(facts: Facts, o: Effective) -> DataFrame:
    f = facts["forwarders"]
    paths = graphs.forwarding_paths(f.select(F.col("symbol_id").alias("node"), F.col("target_symbol_id").alias("target")))
    on = paths.select("root", "path", F.explode("path").alias("symbol_id")).join(f.select("symbol_id", "type_id", F.col("source_path").alias("file")), "symbol_id")
    good = on.groupBy("root", "path").agg(F.count_distinct("type_id").alias("types"), F.count_distinct("file").alias("files")).where("types >= 3 and files >= 3")
    at = f.select(F.col("symbol_id").alias("root"), "project_path", "source_path", F.col("decl_line").alias("start_line"))
    rows = good.join(at, "root").withColumn("edges", F.size("path") - 1)
    return _finding(rows, "indirection-drift-candidates", "transparent-forwarding-path", "root", {"forwardingEdges": "edges", "typeCount": "types", "fileCount": "files"})


def _generated_paths(facts: Facts) -> DataFrame:
    """(project_path, source_path) of documents that are generated."""
    on = F.coalesce("is_source_generated", F.lit(False)) | classify.is_generated(F.col("source_path"), F.col("text"))
    return _shared(facts, "generated_paths", lambda: facts["documents"].where(on).select("project_path", "source_path").distinct())


def _test_roots(facts: Facts, written: DataFrame) -> DataFrame:
    """(node) of written functions that a test runner starts: those marked so, and those whose attributes say so."""
    known = facts["attributes"].where("owner_kind in ('method', 'type')")
    own = lambda c: F.transform(F.filter(F.coalesce(c, F.array().cast("array<struct<name:string,assembly:string,is_source:boolean,version:string>>")), protection.genuine), lambda x: x["name"])
    attributes = known.select(F.col("owner").alias("node"), F.concat(own(F.col("classes")), own(F.col("interfaces"))).alias("names"), F.col("named_texts").alias("arguments"))
    parents = facts["symbols"].select(F.col("symbol").alias("node"), F.col("type").alias("parent")).distinct()
    by_attribute = subjects.active_test_roots(written.select("node", F.col("is_test").alias("is_test_project")), attributes, parents)
    return written.where("is_root").select("node").unionByName(by_attribute).distinct()


def missing_evidence(facts: Facts, o: Effective) -> DataFrame:
    v, nodes = o.general, facts["functions"].withColumn("node", F.col("symbol_id"))
    edges, doubts = calls.call_graph(facts["operations"], facts["methods"], nodes.select(F.col("node").alias("symbol")))
    edges = edges.select("a", "b").unionByName(facts["calls"].select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))).distinct()
    given = facts["call_uncertainty"].select(F.col("symbol_id").alias("source"), F.col("affected_symbol_id").alias("node"), "is_global")
    affected = doubts.select("source", "node", "is_global").unionByName(given).distinct()
    symbols = facts["declarations"].select(F.col("symbol_id").alias("node"), "attributes", F.col("parent_symbol_id").alias("parent"))
    written = nodes.join(_generated_paths(facts), ["project_path", "source_path"], "left_anti").join(subjects.generated_symbols(symbols, symbols), "node", "left_anti")
    roots = cut(_test_roots(facts, written))
    known = nodes.select("node", (~F.col("is_test")).alias("is_production")).join(roots.withColumn("is_root", F.lit(True)), "node", "left").withColumn("is_root", F.coalesce("is_root", F.lit(False)))
    edges = cut(edges)
    kinds = graphs.reach(edges, known)
    # Nothing leads on from a global doubt alone; what it affects is marked with everything else.
    doubt = graphs.uncertain(edges, nodes.select("node"), affected, roots)
    rows = written.join(kinds, "node").join(doubt, "node")
    some = (F.col("decisions") >= v["minDecisionCount"]) | (F.col("nesting") >= v["minDecisionNesting"])
    more = (F.col("decisions") >= v["minIndirectDecisionCount"]) | (F.col("nesting") >= v["minIndirectDecisionNesting"])
    rows = rows.where(((F.col("kind") == "NoPath") & some) | ((F.col("kind") == "Indirect") & more))
    kind = F.when(F.col("kind") == "NoPath", "no-static-test-path").otherwise("indirect-test-path-only")
    return _finding(rows, "missing-test-evidence-candidates", kind, "node", {"decisionCount": "decisions", "maximumNesting": "nesting", "uncertain": F.col("uncertain").cast("int")})


def _dead_code_candidates(facts: Facts, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(types, methods) that may be reported: written by hand, in projects that aren't excluded, and
    methods that neither override nor implement anything. Declarations without a row in symbols are plain ones."""
    d = facts["declarations"].withColumn("symbol", F.col("symbol_id")).withColumn("project", F.col("project_path"))
    d = subjects.without_projects(d, excluded).drop("project").join(_generated_paths(facts), ["project_path", "source_path"], "left_anti")
    node = F.col("symbol_id").alias("node")
    marked = subjects.generated_symbols(facts["declarations"].select(node, "attributes"), facts["declarations"].select(node, F.col("parent_symbol_id").alias("parent")))
    no = F.lit(False)
    facets = facts["symbols"].select("symbol", F.coalesce("method_kind", F.lit("ordinary")).alias("method_kind"), F.coalesce("is_implicit", no).alias("is_implicit"), F.coalesce("container_kind", F.lit("class")).alias("container_kind"), F.col("overrides").isNotNull().alias("is_override")).dropDuplicates(["symbol"])
    kept = facts["contracts"].where("implementation is not null").select(F.col("implementation").alias("symbol"), F.lit(True).alias("implements_interface")).distinct()
    d = d.join(facets, "symbol", "left").join(kept, "symbol", "left").withColumn("node", F.col("symbol"))
    d = d.withColumns({"method_kind": F.coalesce("method_kind", F.lit("ordinary")), "container_kind": F.coalesce("container_kind", F.lit("class")), **{c: F.coalesce(c, no) for c in ("is_implicit", "is_override", "implements_interface")}})
    types = d.where(F.col("kind").isin(*subjects.TYPES) & ~F.col("is_implicit")).join(marked, "node", "left_anti")
    methods = subjects.candidate_methods(d.where("kind = 'method'"), marked)
    columns = ["symbol", *facts["declarations"].columns]
    return types.select(*columns), methods.select(*columns)


def dead_code(facts: Facts, o: Effective) -> DataFrame:
    d, refs = facts["declarations"], facts["references"]
    marks, open_ = protection.indirect_uses(facts["invocations"], facts["attributes"], facts["symbols"], facts["contracts"], facts["base_types"], o.general["entryPointAttributes"])
    projects = facts["projects"].select(F.col("project_path").alias("project"), F.coalesce("project_refs", F.array().cast("array<string>")).alias("references"))
    every = projects.select("project").unionByName(open_.select("project")).unionByName(facts["symbols"].where("project is not null").select("project")).distinct()
    areas = subjects.reference_areas(every, subjects.project_references(projects))
    folders = projects.select("project", F.regexp_extract("project", r"^(.*)/[^/]*$", 1).alias("dir"))
    used_by_markup = markup.markup_marks(facts["markup"], folders, facts["symbols"], facts["attributes"], areas)
    marks = cut(protection.combined([marks, used_by_markup], facts["symbols"]))
    types, methods = _dead_code_candidates(facts, protection.excluded_area(open_, areas))
    parents = d.select(F.col("symbol_id").alias("node"), F.col("parent_symbol_id").alias("parent"))
    contained = parents.where("parent is not null").select(F.col("node").alias("symbol"), F.col("parent").alias("type"))
    protected = references.with_attributes(d, o.general["entryPointAttributes"]).select(F.col("symbol_id").alias("symbol")) if o.general["entryPointAttributes"] else d.limit(0).select(F.col("symbol_id").alias("symbol"))
    protected = protected.unionByName(facts["protected"].select("symbol"))
    if o.general["apiSurface"] == "external_library":
        seen = F.col("accessibility").isin("Public", "Protected", "ProtectedOrInternal")
        open_all = graphs.visible_all_the_way(graphs.ancestors(parents), d.select(F.col("symbol_id").alias("node"), seen.alias("is_visible")))
        protected = protected.unionByName(open_all.where("protected").select(F.col("node").alias("symbol")))
    protected = references.with_parents(protected, contained).unionByName(marks.where("is_protected").select("symbol"))
    entries = facts["entry_points"].select(F.col("symbol").alias("node"))
    protected = protected.unionByName(subjects.entry_chain(entries, parents).select(F.col("node").alias("symbol"))).unionByName(entries.select(F.col("node").alias("symbol")))
    # A symbol's reference to itself says nothing about the type around it either.
    outer = refs.where(~F.col("is_self")).select(F.col("symbol_id").alias("symbol"), "kind", F.col("source_path").alias("place"))
    used = references.fan_out(outer, contained).select("symbol", F.lit(False).alias("is_self"))
    uncertain = cut(facts["reference_uncertainty"].select("symbol").unionByName(marks.where("is_uncertain").select("symbol")).distinct())
    # A type that holds a candidate which may be used may be used itself.
    held = methods.join(uncertain, "symbol", "left_semi").select(F.col("parent_symbol_id").alias("symbol"))
    found = references.unreferenced(types, used, protected, uncertain.unionByName(held.where("symbol is not null")))
    lone = references.unreferenced(methods, used, protected, uncertain)
    lone = references.without_reported_parents(lone, found.select(F.col("symbol_id").alias("parent_symbol_id")), ["parent_symbol_id"])
    rows = found.withColumn("what", F.lit("type-candidate")).unionByName(lone.withColumn("what", F.lit("method-candidate")).select(*found.columns, "what"))
    return _finding(rows, "dead-code-candidates", F.col("what"), "symbol_id", {})


def non_ascii(facts: Facts, o: Effective) -> DataFrame:
    found = identifiers.findings(facts["declarations"], ["project_path", "source_path", "symbol_id", "kind"], "name", "start_line", ["start_line"])
    kind = F.when(F.col("discriminator") == "identifier", F.col("kind")).otherwise(F.concat_ws(":", "kind", F.col("start_line").cast("string")))
    return _finding(found.withColumn("discriminator", kind), "non-ascii-identifiers", F.col("discriminator"), "symbol_id", {})


def registry() -> Registry:
    """The ten analyses with their options."""
    positive = _whole(1)
    p = Option("percentile", 90, _whole(50, 99), "50 to 99")
    size = [("minMember", 80), ("extremeMember", 300), ("minType", 300), ("extremeType", 800), ("extremeFileLines", 1000), ("extremeFileUtf8Bytes", 131072)]
    attributes = Option("entryPointAttributes", [], lambda v: all(isinstance(x, str) and "." in x and x == x.strip() for x in v), "full names of attributes")
    r = Registry()
    for d, run in (
        (Descriptor("method-control-flow-outliers", 2, ("Which methods branch far more than their project's others?",), (p,), ("percentile",)), control_flow_outliers),
        (Descriptor("code-size-candidates", 2, ("Which members, types and files are too long to review?",), (p, *[Option(n, v, positive) for n, v in size]), ("percentile", *[n for n, _ in size])), code_size),
        (Descriptor("duplicate-code-candidates", 2, ("Which bodies are alike?",), (Option("minTokens", 30, positive), Option("minimumSimilarity", "near", lambda v: v in similarity.LEVELS, "exact, near or fuzzy"))), duplicate_code),
        (Descriptor("structural-duplication-candidates", 2, ("Which runs of statements are repeated elsewhere?",)), structural_duplication),
        (Descriptor("type-dependency-cycle-candidates", 1, ("Which types depend on each other in a circle?",)), dependency_cycles),
        (Descriptor("type-dependency-hub-candidates", 1, ("Which types have many dependents and many dependencies?",), (Option("minFanIn", 10, positive), Option("minFanOut", 10, positive))), dependency_hubs),
        (Descriptor("indirection-drift-candidates", 2, ("Which calls only pass through a chain of forwarders?",)), indirection_drift),
        (Descriptor("missing-test-evidence-candidates", 1, ("Which branching code does no test reach?",), tuple(Option(n, v, positive) for n, v in (("minDecisionCount", 3), ("minDecisionNesting", 2), ("minIndirectDecisionCount", 5), ("minIndirectDecisionNesting", 3)))), missing_evidence),
        (Descriptor("dead-code-candidates", 3, ("Which types and methods does nothing refer to?",), (Option("apiSurface", "external_library", lambda v: v in ("external_library", "closed_solution")), attributes)), dead_code),
        (Descriptor("non-ascii-identifiers", 2, ("Which names hold characters beyond ASCII?",)), non_ascii),
    ):
        r.add(Analysis(d, run))
    return r


def run_all(facts: Facts, configured: list[dict] | None = None) -> dict[str, DataFrame]:
    """Findings of each enabled analysis, by id in order; all are enabled if nothing is configured."""
    r = registry()
    configured = [{"id": a.descriptor.id} for a in r] if configured is None else configured
    return {a.descriptor.id: a.run(facts, options) for a, enabled, options in r.configure(configured) if enabled}
