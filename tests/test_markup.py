"""Markup uses as marks: XAML trees, Razor components, scripts; and how dead code reads them."""

import pytest

from factloom.operators import markup, protection, references
from factloom.sources import facts

from .fact_rows import table
from .harness import dealt
from .test_protection import decl, marks, run_dead_code

XAML = """<Window xmlns="http://x" xmlns:x="http://y" xmlns:v="clr-namespace:App.Views;assembly=App" xmlns:g="clr-namespace:" x:Class="App.Main">
  <Window.DataContext><v:Model/></Window.DataContext>
  <v:Panel xmlns:v="clr-namespace:App.Other" Opened="Go" Title="{Binding Path=User.Name}"/>
  <v:Panel Opened="Missing" Closed="No" Text="{x:Static v:Texts.Title}{x:Static q:Texts.Title}"/><g:Top/>
  <TextBlock Text="{Binding Gone.More}"/>
</Window>"""


def test_xaml_is_parsed_with_the_nearest_namespaces():
    got = markup.xaml_uses("a.xaml", XAML)
    assert [u[1:] for u in got if u[1] in ("class", "type")] == [("class", "App.Main", "Main", None)] + [("type", t, None, None) for t in ("App.Views.Model", "App.Other.Panel", "App.Views.Panel", "Top")]
    assert [u[2:] for u in got if u[1] == "static"] == [("App.Views.Texts", "Texts", "Title"), (None, "Texts", "Title")]
    assert [u[2:4] for u in got if u[1] == "binding"] == [("App.Views.Model", "User.Name"), ("App.Views.Model", "Gone.More")]
    assert ("a.xaml", "event", "App.Other.Panel", "Opened", "Go") in got


@pytest.mark.parametrize("bad", ["", "<a>", "<a><b></a></b>", "<a b=c/>", "<p:a/>"])
def test_xaml_that_cannot_be_parsed_fails_the_run(spark, bad):
    with pytest.raises(ValueError, match="bad.xaml"):
        markup.xaml_uses("bad.xaml", bad)
    files = spark.createDataFrame([("bad.xaml", bad, "p")], "file_path string, text string, project string")
    if not bad:
        with pytest.raises(Exception, match="bad.xaml"):
            markup.xaml_marks(files, symbols(spark), areas(spark)).collect()


def areas(spark):
    return spark.createDataFrame([("p", "p"), ("p", "q"), ("q", "q")], "origin string, project string")


def sym(symbol, kind, owner=None, project="p", **more):
    return dict(symbol=symbol, symbol_kind=kind, name=symbol.split(".")[-1].split("#")[0], type=owner, project=project, assembly=project, is_source=True) | more


def symbols(spark, more=()):
    rows = [sym(t, "type", full_name=t) for t in ("App.Main", "App.Views.Model", "App.Other.Panel", "App.Views.Panel", "App.User")] + [sym("App.Views.Texts", "type", project="q", full_name="App.Views.Texts")]
    rows += [sym("App.Main.Go", "method", "App.Main"), sym("Elsewhere.Missing", "method", "App.User"), sym("App.Other.Panel.Opened", "event", "App.Other.Panel"), sym("App.Views.Panel.Opened", "event", "App.Views.Panel")]
    rows += [sym("App.Views.Model.User", "property", "App.Views.Model", value_type="App.User"), sym("App.User.Name", "property", "App.User"), sym("App.User.Gone", "field", "App.User"), sym("App.Views.Texts.Title", "field", "App.Views.Texts", project="q"), sym("Texts", "type", full_name="Texts")]
    return table(spark, "symbols", rows + list(more))


def test_xaml_marks(spark):
    files = spark.createDataFrame([("a.xaml", XAML, "p")], "file_path string, text string, project string")
    assert marks(markup.xaml_marks(files, symbols(spark), areas(spark))) == {
        "App.Main": "P", "App.Views.Model": "P", "App.Other.Panel": "P", "App.Views.Panel": "P", "App.Main.Go": "P", "Elsewhere.Missing": "U",
        "App.Views.Texts.Title": "P", "Texts": "U", "App.Views.Model.User": "P", "App.User.Name": "P", "App.User.Gone": "U",
    }
    # Two methods of a handler's name, and a class that no project has.
    two = symbols(spark, [sym("App.Main.Go#2", "method", "App.Main")])
    got = marks(markup.xaml_marks(files, two, areas(spark)))
    assert got["App.Main.Go"] == got["App.Main.Go#2"] == "U"
    other = spark.createDataFrame([("b.xaml", XAML.replace("App.Main", "Lost.Main"), "p")], "file_path string, text string, project string")
    assert marks(markup.xaml_marks(other, symbols(spark), areas(spark)))["App.Main"] == "U"


def test_xaml_marks_deal_only_symbols_that_files_may_mean(spark, monkeypatch):
    files = spark.createDataFrame([("a.xaml", XAML, "p")], "file_path string, text string, project string")
    known = symbols(spark)
    other = spark.range(20_000).selectExpr("concat('S', id) as symbol", "if(id % 2 = 0, 'method', 'event') as symbol_kind", "concat('N', id) as name", "concat('T', id % 500) as type", "'p' as project", "true as is_source")
    many = known.unionByName(known).unionByName(other, allowMissingColumns=True)
    found = lambda s: marks(protection.combined([markup.xaml_marks(files, s, areas(spark))], s))
    expected = found(known)
    assert expected["App.Main.Go"] == "P" and expected["Elsewhere.Missing"] == "U"
    got = []
    assert dealt(spark, lambda: got.append(found(many))) < 5_000
    assert got == [expected]
    monkeypatch.setattr(references, "FEW_KEYS", 0)
    assert found(many) == expected


def test_razor_marks(spark):
    more = [sym(t, "type") for t in ("Home", "Card", "Row")] + [sym("q.Row", "type", project="q")]
    more += [sym("Home.Save", "method", "Home"), sym("Home.Twice", "method", "Home"), sym("Home.Twice#2", "method", "Home"), sym("Card.Title", "property", "Card"), sym("Card.Open", "method", "Card"), sym("Row.Any", "method", "Row"), sym("Far.Away", "method", "App.User")]
    text = '@page "/home"\n<button @onclick="Save" @onblur="Twice" @onkeyup="Away"/> <X.Card Title="a" @bind-Size="b" @onclick="Run(1)"></X.Card><Row/>'
    files = spark.createDataFrame([("x/Home.razor", text, "p")], "file_path string, text string, project string")
    got = marks(markup.razor_marks(files, symbols(spark, more)))
    assert got == {"Home": "P", "Home.Save": "PU", "Home.Twice": "U", "Home.Twice#2": "U", "Far.Away": "U", "Card": "P", "Card.Title": "P", "Card.Open": "U", "Row": "U", "q.Row": "U", "Row.Any": "U"}


def test_script_marks(spark):
    more = [sym("S.Tick", "method", "App.Main"), sym("S.Other", "method", "App.Main"), sym("S.Plain", "method", "App.Main"), dict(sym("R.Shared", "method", "App.User"), assembly="r", project="r1"), dict(sym("R2.Shared", "method", "App.User"), assembly="r", project="r2")]
    own = [(markup.INVOKABLE, "Microsoft.JSInterop", False, "1")]
    attributes = table(spark, "attributes", [dict(id=s, owner=s, owner_kind="method", classes=own, text=t) for s, t in (("S.Tick", None), ("S.Other", "named"))])
    text = "DotNet.invokeMethodAsync('p', 'Tick'); DotNet.invokeMethod(\"p\", 'named'); DotNet.invokeMethod('p','Plain'); DotNet.invokeMethod('r','Shared'); DotNet.invokeMethod('none','Tick')"
    files = spark.createDataFrame([("a.js", text, "p")], "file_path string, text string, project string")
    assert marks(markup.script_marks(files, symbols(spark, more), attributes)) == {"S.Tick": "P", "S.Other": "P", "S.Plain": "U", "R.Shared": "U", "R2.Shared": "U"}


def test_dead_code_reads_markup(spark):
    rows = [decl("App.Main", project="x/p.csproj"), decl("App.Main.Go", "method", "App.Main", project="x/p.csproj"), decl("App.Main.Not", "method", "App.Main", project="x/p.csproj"), decl("Unused", project="x/p.csproj")]
    own = [sym("App.Main", "type", full_name="App.Main", project="x/p.csproj"), sym("App.Main.Go", "method", "App.Main", project="x/p.csproj"), sym("V.Panel", "type", full_name="V.Panel", project="x/p.csproj"), sym("V.Panel.Opened", "event", "V.Panel", project="x/p.csproj")]
    text = '<Window xmlns:x="y" xmlns:v="clr-namespace:V" x:Class="App.Main"><v:Panel Opened="Go"/></Window>'
    projects = [dict(project_path="x/p.csproj", project_name="p", metadata_refs=[], project_refs=[])]
    given = dict(declarations=rows, symbols=own, projects=projects)
    assert run_dead_code(spark, **given, markup=[dict(file_path="x/views/Main.xaml", text=text)]) == [("App.Main.Not", "method-candidate"), ("Unused", "type-candidate")]
    with pytest.raises(ValueError, match="y/Main.xaml"):
        run_dead_code(spark, **given, markup=[dict(file_path="y/Main.xaml", text=text)])
    assert set(facts.SCHEMAS) >= {"markup", "symbols"}
