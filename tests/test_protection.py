"""Protection rules and dead code on small fact rows: reflection, registrations, attributes, test frameworks, providers."""

import pytest
from pyspark.sql import functions as F

from factloom.analyses import run_all
from factloom.operators import graphs, protection
from factloom.plans.catalog import QUERIES
from factloom.sources import facts

from .fact_rows import table


def marks(df):
    return {r["symbol"]: ("P" if r["is_protected"] else "") + ("U" if r["is_uncertain"] else "") for r in df.groupBy("symbol").agg(F.bool_or("is_protected").alias("is_protected"), F.bool_or("is_uncertain").alias("is_uncertain")).collect()}


def members(spark):
    rows = [dict(symbol=f"T{i}", symbol_kind="type", name=f"T{i}", assembly="a" if i < 3 else "b", project="p") for i in range(1, 5)]
    rows += [dict(symbol=f"T1.{n}", symbol_kind=k, name=n.split("#")[0], type="T1", assembly="a", project="p") for n, k in (("Go", "method"), ("Go#2", "method"), ("Stop", "method"), ("Size", "property"))]
    rows += [dict(symbol="T2.Run", symbol_kind="method", name="Run", type="T2", overrides="Base.Run", overrides_source=False), dict(symbol="T2.Own", symbol_kind="method", name="Own", type="T2", overrides="T1.Go", overrides_source=True)]
    rows += [dict(symbol="T3.Invoke", symbol_kind="method", name="Invoke", type="T3", first_parameter=protection.MIDDLEWARE_CONTEXT), dict(symbol="T3.InvokeAsync", symbol_kind="method", name="InvokeAsync", type="T3", first_parameter="string"), dict(symbol="T3.Dispose", symbol_kind="method", name="Dispose", type="T3")]
    return table(spark, "symbols", rows)


@pytest.mark.parametrize("call,wanted", [
    (dict(target_type="System.Type", target_name="GetMethod", has_name_parameter=True, name="Go"), {"T1.Go": "P", "T1.Go#2": "P"}),
    (dict(target_type="System.Type", target_name="GetMethod", has_name_parameter=True, name=None), {"T1.Go": "U", "T1.Go#2": "U", "T1.Stop": "U"}),
    (dict(target_type="System.Type", target_name="GetMethods", has_name_parameter=False, name=None), {"T1.Go": "P", "T1.Go#2": "P", "T1.Stop": "P"}),
    (dict(target_type="System.Type", target_name="GetProperty", has_name_parameter=True, name="Go"), {}),
    (dict(target_type="System.Type", target_name="GetProperties", has_name_parameter=False, name=None), {"T1.Size": "P"}),
    (dict(target_type="System.Type", target_name="GetMethod", has_name_parameter=True, name="Go", target_source=True), {}),
    (dict(target_type="My.Type", target_name="GetMethod", has_name_parameter=True, name="Go"), {}),
    (dict(target_type="System.Type", target_name="GetMethod", has_name_parameter=True, name="Go", typeof_type=None), {}),
    (dict(target_type="System.Reflection.Assembly", target_name="GetTypes", typeof_type=None), {"T1": "U", "T2": "U"}),
])
def test_reflection(spark, call, wanted):
    calls = table(spark, "invocations", [dict(project="p", assembly="a", target_source=False, typeof_type="T1") | call] * 2)
    assert marks(protection.reflected(calls, members(spark))) == wanted


def test_registrations_and_middleware(spark):
    contracts = table(spark, "contracts", [
        dict(type="T3", contract="System.IDisposable", contract_source=False, member_source=False, implementation="T3.Dispose"),
        dict(type="T1", contract="I.Own", contract_source=True, member_source=True, implementation="T1.Go"),
        dict(type="T2", contract="System.IBase", contract_source=False, member_source=False, implementation="Base.Other"),
    ])
    call = dict(project="p", assembly="a", target_source=False, type_arguments=[], argument_types=[])
    services = protection.SERVICES + protection.SERVICE_CLASSES[0]
    rows = [call | dict(target_type=services, target_name="AddScoped", type_arguments=["T1", "T2"]), call | dict(target_type=protection.MIDDLEWARE[0][0], target_name="UseMiddleware", type_arguments=["T3"]), call | dict(target_type=services, target_name="Configure", type_arguments=["T4"])]
    got = marks(protection.registered(table(spark, "invocations", rows), members(spark), contracts))
    assert got == {"T1": "P", "T2": "P", "T2.Run": "P", "T3": "P", "T3.Invoke": "P", "T3.Dispose": "P"}
    # A type that is an argument counts as well; a look-alike with source doesn't.
    rows = [call | dict(target_type=services, target_name="AddSingleton", argument_types=["T4"]), call | dict(target_type=services, target_name="AddSingleton", argument_types=["T1"], target_source=True)]
    assert marks(protection.registered(table(spark, "invocations", rows), members(spark), contracts)) == {"T4": "P"}


def klass(name, assembly, is_source=False, version="1.0"):
    return (name, assembly, is_source, version)


def attribute(owner, classes, kind="method", **more):
    return dict(id=f"{owner}{classes[0][0]}", project="p", owner=owner, owner_kind=kind, owner_type="T1", classes=classes, interfaces=[], types=[], named_types={}, named_texts={}, is_error=False) | more


def test_entry_attributes(spark):
    rows = [
        attribute("a", [klass(protection.ENTRY_ATTRIBUTES[0], "System.Runtime")]), attribute("b", [klass(protection.ENTRY_ATTRIBUTES[1], "Mine", True)]), attribute("c", [klass("My.Entry", "Mine", True)], "type"),
        attribute("d", [klass("Microsoft.AspNetCore.Mvc.RouteAttribute", "Microsoft.AspNetCore.Mvc.Core")]), attribute("e", [klass("Microsoft.AspNetCore.Mvc.RouteAttribute", "Microsoft.AspNetCore.Mvc.Core")], "type"),
        attribute("f", [klass("My.Derived", "Mine", True), klass("My.Entry", "Mine", True)]),
    ]
    assert marks(protection.by_attribute(table(spark, "attributes", rows), ["My.Entry"])) == {"a": "P", "c": "P", "d": "P"}


def test_look_alikes_are_not_recognized(spark):
    rows = [attribute("a", [klass("Xunit.FactAttribute", "xunit.core")]), attribute("b", [klass("Xunit.FactAttribute", "Mine", True)]), attribute("c", [klass("My.Fact", "Mine", True), klass("Xunit.FactAttribute", "xunit.core")]), attribute("d", [klass("NUnit.Framework.TestAttribute", "nunit.other")]), attribute("e", [klass("My.V3", "Mine", True)], interfaces=[klass(protection.FACT_INTERFACE, "xunit.v3.core")])]
    known = protection.recognized(table(spark, "attributes", rows))
    assert {r["owner"]: (r["known"], r["is_fact"]) for r in known.collect()} == {"a": (["Xunit.FactAttribute"], False), "b": ([], False), "c": (["Xunit.FactAttribute"], False), "d": ([], False), "e": ([], True)}


def hierarchy(spark):
    """B derives from A; providers of each name in one or both."""
    p = dict(symbol_kind="property", is_static=True, accessibility="Public", value_core="enumerable", value_wraps=0, is_source=True, project="p")
    rows = [dict(symbol=t, symbol_kind="type", name=t, is_source=True, project="p") for t in "AB"]
    rows += [p | dict(symbol="A.One", name="One", type="A"), p | dict(symbol="A.Two", name="Two", type="A"), p | dict(symbol="B.Two", name="Two", type="B"), p | dict(symbol="B.Private", name="Private", type="B", accessibility="Private"), p | dict(symbol="B.Text", name="Text", type="B", value_core="other"), p | dict(symbol="B.Task", name="Task", type="B", value_wraps=1), p | dict(symbol="B.Instance", name="Instance", type="B", is_static=False)]
    symbols = table(spark, "symbols", rows)
    bases = graphs.ancestors(spark.createDataFrame([("A", None), ("B", "A")], "node string, parent string"))
    up = graphs.ancestors(spark.createDataFrame([("A", None), ("B", "Outer"), ("Outer", None)], "node string, parent string"))
    contracts = table(spark, "contracts", [dict(type="B", contract="I", contract_source=True, member_source=True, implementation="B.Instance")])
    return symbols, bases, up, contracts


ALL = {"A.One": "U", "A.Two": "U", "B.Two": "U"}
WHOLE = {"B": "P", "Outer": "P", "B.Instance": "P"}


@pytest.mark.parametrize("name,framework,task,wanted", [
    ("One", "xunit", False, {"A.One": "P"}),
    ("Two", "xunit", False, {"A.Two": "PU", "B.Two": "PU", "A.One": "U"}),
    ("None", "xunit", False, ALL | WHOLE),
    (None, "xunit", False, ALL | WHOLE),
    (None, "nunit", False, ALL | WHOLE | {"B.Private": "U"}),
    (None, "nunit", True, ALL | WHOLE | {"B.Private": "U", "B.Task": "U"}),
])
def test_data_by_name_along_the_bases(spark, name, framework, task, wanted):
    bindings = spark.createDataFrame([("p", framework, "B", name, task, False, False)] * 2, "project string, framework string, source_type string, name string, allows_task boolean, allows_async boolean, is_open boolean")
    assert marks(protection.bound_data(bindings, *hierarchy(spark))) == wanted


def test_bindings_of_attributes(spark):
    x, n = (lambda v="2.0", a="xunit.core": [klass("Xunit.MemberDataAttribute", a, version=v)]), (lambda v: [klass("NUnit.Framework.TestCaseSourceAttribute", "nunit.framework", version=v)])
    rows = [attribute("a", x(), text="D"), attribute("b", x("3.0", "xunit.v3.core"), text="E", named_types={"MemberType": "S"}), attribute("c", n("3.13"), text="F", types=["Q"]), attribute("d", n("3.14.1"), text="G"), attribute("e", n("4.0"), text=None), attribute("f", x(), text="H", named_types={"MemberType": None}), attribute("g", x(), text="I", is_error=True), attribute("h", [klass("Xunit.MemberDataAttribute", "Mine", True)], text="J")]
    got = protection.data_bindings(protection.recognized(table(spark, "attributes", rows)))
    assert sorted((r["name"] or "", r["framework"], r["source_type"], r["allows_task"], r["allows_async"], r["is_open"]) for r in got.collect()) == [
        ("", "nunit", "T1", True, True, False), ("D", "xunit", "T1", False, False, False), ("E", "xunit", "S", True, True, False), ("F", "nunit", "Q", False, False, False),
        ("G", "nunit", "T1", True, False, False), ("H", "xunit", "T1", False, False, True), ("I", "xunit", "T1", False, False, True),
    ]


def test_inherited_hooks_and_fixtures(spark):
    symbols = table(spark, "symbols", [dict(symbol=t, symbol_kind="type", name=t, is_source=True, type="Outer" if t == "B" else None) for t in ("A", "B", "Outer", "Data")] + [dict(symbol="B.SetUp", symbol_kind="method", name="SetUp", type="B", overrides="A.SetUp"), dict(symbol="A.SetUp", symbol_kind="method", name="SetUp", type="A")])
    bases = graphs.ancestors(spark.createDataFrame([("A", None), ("B", "A")], "node string, parent string"))
    up = graphs.ancestors(spark.createDataFrame([("A", None), ("B", "Outer"), ("Outer", None), ("Data", None)], "node string, parent string"))
    contracts = table(spark, "contracts", [dict(type="A", contract="Xunit.IClassFixture`1", contract_source=False, member_source=False, implementation=None, arguments=["Data"]), dict(type="Data", contract="System.IDisposable", contract_source=False, member_source=False, implementation="Data.Dispose", arguments=[])])
    known = protection.recognized(table(spark, "attributes", [attribute("A.SetUp", [klass("NUnit.Framework.SetUpAttribute", "nunit.framework")], owner_type="A")]))
    got = marks(protection.test_members(known, symbols, bases, up, contracts))
    assert got == {s: "P" for s in ("A.SetUp", "B.SetUp", "A", "B", "Outer", "Data", "Data.Dispose")}


def test_collections_and_display_names(spark):
    symbols, bases, up, contracts = hierarchy(spark)
    c = lambda n: [klass(n, "xunit.core")]
    rows = [attribute("T", c(protection.COLLECTION), "type", text="db"), attribute("B", c(protection.DEFINITION), "type", text="db"), attribute("A", c(protection.DEFINITION), "type", text="other"), attribute("T2", c(protection.COLLECTION), "type", text=None, project="q")]
    known = protection.recognized(table(spark, "attributes", rows))
    assert marks(protection.collections(known, up, contracts)) == WHOLE
    assert [tuple(r) for r in protection.open_projects(known, protection.data_bindings(known)).collect()] == [("q", protection.NO_COLLECTION_NAME)]
    own = [klass(protection.UNIT + "DynamicDataAttribute", "MSTest.TestFramework")]
    named = lambda n: table(spark, "attributes", [attribute("m", own, text="One", owner_type="B", named_texts={"DynamicDataDisplayName": n})])
    methods = symbols.unionByName(table(spark, "symbols", [dict(symbol="A.Label", symbol_kind="method", name="Label", type="A", is_static=True, accessibility="Public", value_core="text", value_wraps=0)]))
    assert marks(protection.display_names(protection.recognized(named("Label")), methods, bases)) == {"A.Label": "P"}
    assert marks(protection.display_names(protection.recognized(named("Missing")), methods, bases)) == {"A.Label": "U"}


def run_dead_code(spark, **rows):
    tables = facts.empty(spark) | {n: table(spark, n, r) for n, r in rows.items()}
    options = {"entryPointAttributes": ["My.Entry"], "apiSurface": "closed_solution"}
    found = run_all(tables, [{"id": "dead-code-candidates", "options": options}])["dead-code-candidates"]
    return sorted((r["subject_id"], r["discriminator"]) for r in found.collect())


def decl(symbol, kind="class", parent=None, project="p", **more):
    return dict(project_path=project, source_path="a.cs", symbol_id=symbol, kind=kind, name=symbol, parent_symbol_id=parent, accessibility="Internal", attributes=[], start_line=1) | more


def test_dead_code_looks_at_written_ordinary_declarations(spark):
    rows = [decl("T"), decl("T.A", "method", "T"), decl("T.B", "method", "T"), decl("T.C", "method", "T"), decl("T.D", "method", "T"), decl("G", attributes=["System.CodeDom.Compiler.GeneratedCodeAttribute"]), decl("G.In", "class", "G"), decl("F", source_path="x.g.cs"), decl("E"), decl("E.Main", "method", "E"), decl("N", parent="E")]
    symbols = [dict(symbol="T.B", symbol_kind="method", type="T", overrides="Base.B", overrides_source=True), dict(symbol="T.C", symbol_kind="method", type="T"), dict(symbol="T.D", symbol_kind="method", type="T", method_kind="accessor")]
    used = [dict(symbol_id="T", kind="Direct", project_path="p", source_path="b.cs", start=1, is_self=False)]
    got = run_dead_code(spark, declarations=rows, symbols=symbols, references=used, entry_points=[dict(symbol="E.Main")], contracts=[dict(type="T", contract="I", contract_source=True, member_source=True, implementation="T.C", arguments=[])], documents=[dict(project_path="p", source_path="x.g.cs", role="Production", text="", is_source_generated=False)])
    assert got == [("N", "type-candidate"), ("T.A", "method-candidate")]


def test_dead_code_with_indirect_uses(spark):
    rows = [decl("T"), decl("T.Go", "method", "T"), decl("T.Stop", "method", "T"), decl("S"), decl("U"), decl("U.Maybe", "method", "U"), decl("U.Not", "method", "U"), decl("D")]
    symbols = [dict(symbol=s, symbol_kind="type" if "." not in s else "method", name=s.split(".")[-1], type=s.split(".")[0] if "." in s else None, assembly="a", project="p", is_source=True) for s in ("T", "T.Go", "T.Stop", "S", "U", "U.Maybe", "D")]
    call = dict(project="p", assembly="a", target_source=False, type_arguments=[], argument_types=[], has_name_parameter=True)
    calls = [call | dict(target_type="System.Type", target_name="GetMethod", typeof_type="T", name="Go"), call | dict(target_type="System.Type", target_name="GetMethod", typeof_type="U", name=None), call | dict(target_type=protection.SERVICES + protection.SERVICE_CLASSES[1], target_name="AddHostedService", type_arguments=["S"])]
    got = run_dead_code(spark, declarations=rows, symbols=symbols, invocations=calls)
    # T is used through Go; U may be used through Maybe, so its other method is looked at alone.
    assert got == [("D", "type-candidate"), ("T.Stop", "method-candidate"), ("U.Not", "method-candidate")]


def test_open_provider_excludes_what_its_project_refers_to(spark):
    rows = [decl("T", project="p"), decl("L", project="lib"), decl("O", project="other")]
    own = [attribute("T.Test", [klass("Xunit.MemberDataAttribute", "xunit.core")], text="D", named_types={"MemberType": None})]
    projects = [dict(project_path="p", project_name="p", metadata_refs=[], project_refs=["lib"]), dict(project_path="lib", project_name="lib", metadata_refs=[], project_refs=[]), dict(project_path="other", project_name="other", metadata_refs=[], project_refs=["p"])]
    assert run_dead_code(spark, declarations=rows, attributes=own, projects=projects) == [("O", "type-candidate")]


def test_ancestors_of_a_long_chain_take_few_rounds(spark):
    n = 300
    parents = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    out = graphs.ancestors(parents, max_rounds=10)
    assert out.count() == n * (n + 1) // 2
    assert out.where("node = 299 and ancestor = 0").first()["depth"] == 299


def test_registration_marks_of_lines_that_share_a_symbol(spark, tmp_path):
    """A property that implements a contract, and a method that implements none, have one symbol: it isn't used."""
    spark.createDataFrame([(1, 5, 2, 9.0, 0.01, 0.04, "R", "O"), (1, 5, 2, 9.0, 0.01, 0.04, "A", "F"), (1, 6, 2, 9.0, 0.01, 0.04, "A", "O")], "l_partkey long, l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "BUILDING")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "one", 3)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert marks(QUERIES["registration_marks"](spark, str(tmp_path))) == {"1": "P", "1:6:2": "P"}


def test_bindings_meet_only_the_members_they_name(spark, monkeypatch):
    """200 types derive from one with 50 members: what is kept are the 200 members that are named, not all 10,000 inherited ones."""
    kept = []
    monkeypatch.setattr(protection, "cut", lambda df: kept.append(df.localCheckpoint()) or kept[-1])
    _, _, up, contracts = hierarchy(spark)
    symbols = table(spark, "symbols", [dict(symbol=f"A.{i}", symbol_kind="property", name=f"M{i}", type="A", is_static=True, accessibility="Public", value_core="enumerable", value_wraps=0) for i in range(50)])
    bases = spark.createDataFrame([(f"T{i}", "A", 1) for i in range(200)], "node string, ancestor string, depth long")
    bindings = spark.createDataFrame([("p", "xunit", f"T{i}", "M7", False, False, False) for i in range(200)], "project string, framework string, source_type string, name string, allows_task boolean, allows_async boolean, is_open boolean")
    assert marks(protection.bound_data(bindings, symbols, bases, up, contracts)) == {"A.7": "P"}
    assert [k.count() for k in kept] == [200, 200]
