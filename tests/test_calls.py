"""The call graph and missing test evidence on small fact rows."""

import re

import pytest
from pyspark.sql import functions as F

from factloom.analyses import run_all
from factloom.operators import calls
from factloom.sources import facts

from .fact_rows import table

FOUND = dict(symbol="f", is_nameof=False, is_call_syntax=True, candidates=[], source_path="a.cs", start=1)


def graph(spark, operations, methods=(), nodes=("f", "g", "h")):
    edges, doubt = calls.call_graph(table(spark, "operations", [FOUND | o for o in operations]), table(spark, "methods", list(methods)), spark.createDataFrame([(n,) for n in nodes], "symbol string"))
    return sorted((r["a"], r["b"], r["kind"]) for r in edges.collect()), sorted((r["node"] or "", r["kind"], r["is_global"]) for r in doubt.collect())


@pytest.mark.parametrize("kind,edge", [("invocation", "Invocation"), ("object_creation", "ObjectCreation"), ("event_add", "EventAdd"), ("event_remove", "EventRemove"), ("unary", "UserOperator"), ("binary", "UserOperator"), ("compound", "UserOperator"), ("increment", "UserOperator"), ("conversion", "UserConversion")])
def test_kinds_of_edges(spark, kind, edge):
    assert graph(spark, [dict(kind=kind, target="g")] * 2) == ([("f", "g", edge)], [])


@pytest.mark.parametrize("place,kinds", [(None, ["PropertyGet"]), ("assigned", ["PropertySet"]), ("out", ["PropertySet"]), ("ref", ["PropertyGet", "PropertySet"]), ("compound", ["PropertyGet", "PropertySet"]), ("increment", ["PropertyGet", "PropertySet"])])
def test_properties_are_read_and_written(spark, place, kinds):
    edges, _ = graph(spark, [dict(kind="property", getter="g", setter="h", place=place)])
    assert sorted(k for _, _, k in edges) == kinds


def test_targets_are_normalized_and_found_in_other_compilations(spark):
    methods = [dict(symbol="g<int>", definition="g"), dict(symbol="other.h", definition="other.h", identity="H"), dict(symbol="h", definition="h", identity="H"), dict(symbol="twice", definition="twice", identity="T"), dict(symbol="t1", definition="t1", identity="T"), dict(symbol="t2", definition="t2", identity="T")]
    edges, _ = graph(spark, [dict(kind="invocation", target=t) for t in ("g<int>", "other.h", "twice", "unknown")], methods, ("f", "g", "h", "t1", "t2"))
    assert edges == [("f", "g", "Invocation"), ("f", "h", "Invocation")]


def test_uncertainty(spark):
    methods = [dict(symbol="g", definition="g", is_virtual=True), dict(symbol="h", definition="h", is_override=True, is_sealed=True), dict(symbol="i", definition="i", container_kind="interface")]
    operations = [dict(kind="invocation", target="g"), dict(kind="invocation", target="h"), dict(kind="invocation", target="i"), dict(kind="binary", target="g"), dict(kind="method_reference", target="h"), dict(kind="method_reference", target="g", is_nameof=True), dict(kind="unresolved"), dict(kind="unresolved", candidates=["g", "x"]), dict(kind="unresolved", is_call_syntax=False)]
    edges, doubt = graph(spark, operations, methods)
    assert edges == [("f", "g", "Invocation"), ("f", "g", "UserOperator"), ("f", "h", "Invocation")]
    assert doubt == [("", "UnresolvedBinding", True), ("g", "UnresolvedBinding", False), ("g", "VirtualOrInterfaceDispatch", True), ("h", "MethodGroup", False), ("i", "VirtualOrInterfaceDispatch", True), ("x", "UnresolvedBinding", False)]


def test_virtual_calls_reach_overrides_below_and_the_nearest_above(spark):
    types = spark.createDataFrame([("A", None), ("B", "A"), ("C", "B"), ("D", "B"), ("E", None)], "type string, base string")
    spans = {r["type"]: (r["low"], r["high"]) for r in calls.type_intervals(types).collect()}
    assert spans == {"A": (1, 5), "B": (2, 5), "C": (3, 4), "D": (4, 5), "E": (5, 6)}
    made = spark.createDataFrame([("A", "s", "A.s"), ("C", "s", "C.s"), ("E", "s", "E.s"), ("D", "t", "D.t")], "type string, slot string, method string")
    sent = spark.createDataFrame([("B", "s"), ("B", "s"), ("C", "s"), ("D", "s"), ("C", "t")], "receiver string, slot string")
    got = sorted(map(tuple, calls.dispatch_targets(sent, made, types).collect()))
    assert got == [("B", "s", "A.s"), ("B", "s", "C.s"), ("C", "s", "C.s"), ("D", "s", "A.s")]


def test_dispatch_targets_meet_by_receiver(spark):
    """No join is on the slot alone: a slot that very many types declare would pair them all with all receivers."""
    types = spark.range(100).select(F.col("id").alias("type"), F.when(F.col("id") > 0, 0).cast("long").alias("base"))
    rows = types.select("type", (F.col("type") % 1).alias("slot"), F.col("type").alias("method"))
    out = calls.dispatch_targets(types.select(F.col("type").alias("receiver"), (F.col("type") % 1).alias("slot")), rows, types)
    plan = re.sub(r"#\d+L?", "", out._jdf.queryExecution().executedPlan().toString())
    assert "Join" in plan and not re.search(r"Join \[slot\], \[slot\]", plan)
    assert out.count() == 199


def function(symbol, project="p", is_test=False, is_root=False, decisions=0, nesting=0, path="a.cs"):
    return dict(symbol_id=symbol, project_path=project, source_path=path, start_line=1, is_test=is_test, is_root=is_root, decisions=decisions, nesting=nesting)


def evidence(spark, **rows):
    tables = facts.empty(spark) | {n: table(spark, n, r) for n, r in rows.items()}
    found = run_all(tables, [{"id": "missing-test-evidence-candidates"}])["missing-test-evidence-candidates"]
    return sorted((r["subject_id"], r["discriminator"], int(r["metrics"]["uncertain"])) for r in found.collect())


def test_missing_evidence_over_typed_edges(spark):
    """A root calls Entry and Direct; Entry makes Indirect, deeply nested; Uncovered has three decisions."""
    functions = [function("Test", is_test=True), function("Entry"), function("Direct", decisions=9), function("Indirect", decisions=1, nesting=5), function("Uncovered", decisions=3), function("Simple", decisions=1), function("Made", decisions=9, path="x.g.cs")]
    operations = [FOUND | o for o in (dict(symbol="Test", kind="invocation", target="Entry"), dict(symbol="Test", kind="property", getter="Direct"), dict(symbol="Entry", kind="object_creation", target="Indirect"))]
    fact = [("Xunit.FactAttribute", "xunit.core", False, "2.0")]
    attributes = [dict(id="1", project="p", owner="Test", owner_kind="method", owner_type="T", classes=fact, interfaces=[], types=[], named_types={}, named_texts={}, is_error=False)]
    symbols = [dict(symbol="Test", symbol_kind="method", type="T")]
    given = dict(functions=functions, operations=operations, attributes=attributes, symbols=symbols, documents=[dict(project_path="p", source_path="x.g.cs", role="Production", text="", is_source_generated=False)])
    wanted = [("Indirect", "indirect-test-path-only", 0), ("Uncovered", "no-static-test-path", 0)]
    assert evidence(spark, **given) == wanted
    # A skipped test is no root: nothing is reached.
    skipped = evidence(spark, **given | dict(attributes=[attributes[0] | dict(named_texts={"Skip": "later"})]))
    assert {(s, d) for s, d, _ in skipped} == {("Direct", "no-static-test-path"), ("Indirect", "no-static-test-path"), ("Uncovered", "no-static-test-path")}
    # A call that may go elsewhere leaves everything uncertain and adds no path.
    doubtful = evidence(spark, **given | dict(methods=[dict(symbol="Entry", definition="Entry", is_virtual=True)]))
    assert doubtful == [(s, d, 1) for s, d, _ in wanted]
    # A method used as a value makes what it leads to uncertain, and only that.
    value = [FOUND | dict(symbol="Test", kind="method_reference", target="Uncovered")]
    assert evidence(spark, **given | dict(operations=operations + value)) == [wanted[0], ("Uncovered", "no-static-test-path", 1)]
