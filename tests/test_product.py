"""Options, configuration, analyses over fact rows, and the report."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.analyses import registry, run_all
from factloom.options import Descriptor, InvalidOptions, Option
from factloom.runtime import cut
from factloom.sources import config, facts, report


def test_test_options_inherit_the_effective_value():
    d = Descriptor("a", 1, ("q?",), (Option("p", 90), Option("n", 3)), ("p",))
    general = d.resolve({"p": 80})
    assert d.resolve_tests(general) == {"n": 3, "p": 80}
    assert d.resolve_tests(general, {"p": 70})["p"] == 70
    with pytest.raises(InvalidOptions):
        d.resolve_tests(general, {"n": 1})


@pytest.mark.parametrize("bad", ["", "A", "a_", "-a", "a-", "con", "com1", "x" * 253])
def test_unsafe_ids(bad):
    with pytest.raises(InvalidOptions):
        Descriptor(bad, 1, ("q?",))


@pytest.mark.parametrize("value", [49, 100, 90.5, "90", True])
def test_percentile_range(value):
    with pytest.raises(InvalidOptions):
        registry().configure([{"id": "method-control-flow-outliers", "options": {"percentile": value}}])


def test_invalid_values_are_rejected_in_disabled_analyses():
    with pytest.raises(InvalidOptions):
        registry().configure([{"id": "dead-code-candidates", "enabled": False, "options": {"apiSurface": "x"}}])


def test_config_is_strict():
    r = registry()
    good = config.default("a.sln", r)
    assert len(config.parse(good, r)["analyses"]) == 10
    for bad in (good.replace('"schemaVersion": 1', '"schemaVersion": 2'), '{"schemaVersion": 1, "schemaVersion": 1}', good + "// x", json.dumps(json.loads(good) | {"more": 1}), good.replace('"a.sln"', '"../a.sln"')):
        with pytest.raises(InvalidOptions):
            config.parse(bad, r)


def test_unlisted_analyses_are_disabled():
    assert [on for _, on, _ in registry().configure([{"id": "non-ascii-identifiers"}])].count(True) == 1


def test_solution_choice(tmp_path):
    for n in ("b.sln", "a.sln", "a.slnx"):
        (tmp_path / n).touch()
    assert config.discover_solution(tmp_path).name == "a.slnx"
    (tmp_path / f"{tmp_path.name}.sln").touch()
    assert config.discover_solution(tmp_path).stem == tmp_path.name


def test_all_analyses_run_on_empty_facts(spark):
    found = run_all(facts.empty(spark))
    assert len(found) == 10
    assert all(df.count() == 0 for df in found.values())


def test_analyses_and_report(spark, tmp_path):
    tables = facts.empty(spark)
    decl = facts.SCHEMAS["declarations"]
    rows = [("p", "a.cs", "T", "type", "Größe", None, "Internal", [], 3), ("p", "a.cs", "M", "method", "Run", "T", "Internal", [], 5), ("p", "b.cs", "U", "type", "Used", None, "Internal", [], 1)]
    tables["declarations"] = spark.createDataFrame(rows, decl)
    tables["references"] = spark.createDataFrame([("U", "Direct", "p", "a.cs", 9, False), ("M", "Direct", "p", "a.cs", 9, True)], facts.SCHEMAS["references"])
    found = {k: cut(v) for k, v in run_all(tables, [{"id": "dead-code-candidates"}, {"id": "non-ascii-identifiers"}]).items()}
    assert [(r["subject_id"], r["discriminator"]) for r in found["dead-code-candidates"].collect()] == [("T", "type-candidate")]
    assert [r["subject_id"] for r in found["non-ascii-identifiers"].collect()] == ["T"]
    out = report.publish(found, tmp_path)
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*.md")) == ["index.md", "maps/audit/index.md", "maps/projects.md", "mixed/index.md", "production/dead-code-candidates.md", "production/index.md", "production/non-ascii-identifiers.md", "tests/index.md"]
    assert "`T`, `L3`, type-candidate" in (out / "production" / "dead-code-candidates.md").read_text()
    again = report.publish(found, tmp_path)
    assert again != out and all((again / p.relative_to(out)).read_text() == p.read_text() for p in out.rglob("*.md"))
    # Both findings are about T, so each names the other.
    assert "  - Related: `../production/non-ascii-identifiers.md`: finding-" in (out / "production" / "dead-code-candidates.md").read_text()
    assert "No findings in this area." in (out / "mixed" / "index.md").read_text() and "| [production](production/index.md) | 2 |" in (out / "index.md").read_text()
    assert (out / "maps" / "audit" / "index.md").read_text().count("→ `../../production/") == 2


def test_report_maps_and_evidence(spark):
    from factloom.sources import pages

    def lines(df):
        return {p: [r["text"] for r in df.where(F.col("page") == p).orderBy("at").collect()] for p in {r["page"] for r in df.collect()}}

    projects = spark.createDataFrame([("x/A.csproj", ["x/B.csproj"]), ("x/B.csproj", [])], "project_path string, references array<string>")
    documents = spark.createDataFrame([("x/A.csproj", "src/a/One.cs", "Production", 10), ("x/A.csproj", "src/Two.cs", "Production", 5), ("x/B.csproj", "t/T.cs", "Tests", 7)], "project_path string, source_path string, role string, bytes long")
    types = spark.createDataFrame([("A.One", "x/A.csproj"), ("B.T", "x/B.csproj")], "type_id string, project_path string")
    declared = spark.createDataFrame([("A.One", "src/a/One.cs"), ("A.One", "src/Two.cs")], "type_id string, source_path string")
    got = lines(pages.project_maps(projects, documents, types, declared, spark.createDataFrame([("B.T", "A.One")] * 2, "a string, b string")))
    key = {p.split("/")[1][:3] + p.split("/")[1][3:4]: p.split("/")[1] for p in got if p.count("/") == 2}
    a, b = (next(k for k in key.values() if k.startswith(f"p-{x}-")) for x in "AB")
    assert "role: production. Files: 2; types: 1. References: `x/B.csproj`." in got["maps/projects.md"][1] and "role: tests" in got["maps/projects.md"][2]
    assert [t for t in got[f"maps/{a}/structure.md"] if t.startswith("- `")] == ["- `.`: 2 files, 15 bytes", "- `src`: 2 files, 15 bytes", "- `src/a`: 1 files, 10 bytes"]
    assert got[f"maps/{a}/structure.md"][-1].endswith("`A.One`: `src/Two.cs`, `src/a/One.cs`")
    assert got[f"maps/{b}/dependencies-outgoing.md"][1:] == ["- `B.T` → `A.One` in `x/A.csproj`"] and got[f"maps/{a}/dependencies-incoming.md"][1:] == ["- `A.One` ← `B.T` in `x/B.csproj`"]
    schema = "analysis_id string, project_path string, source_path string, subject_id string, discriminator string, start_line int, metrics map<string,double>"
    found = pages.placed(spark.createDataFrame([("an", "p", "t.cs", "s`x", "d", 3, {"b": 2.5, "a": 1.0})], schema), documents.select(F.lit("p").alias("project_path"), F.lit("t.cs").alias("source_path"), "role"))
    own = found.first()["id"]
    evidence = spark.createDataFrame([(own, "t.cs", 3, "N.T.M", ""), (own, "t.cs", 9, "N.T.M", "why *so*"), (own, "u.cs", 4, "N.T.K", None), (own, "u.cs", 4, "N.T.K", None)], "id string, source_path string, line int, label string, detail string")
    page = lines(pages.finding_pages(found, evidence))["mixed/an.md"]
    assert page[3:] == [f"- ``s`x``, `L3`, d: a 1, b 2.5 ({own})", "  - Evidence:", "    - `L9` `T.M` — why \\*so\\*", "    - `u.cs:4` `T.K`"]


def test_aborted_reports_leave_nothing(spark, tmp_path):
    from factloom.sources import pages

    bad = F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit("x"))
    rows = pages._rows(spark.range(20).repartition(4), F.concat(F.lit("p"), F.col("id"), F.lit(".md")), bad, 0)
    (tmp_path / "aside").mkdir()
    with pytest.raises(Exception):
        pages.write(rows, tmp_path / "aside", tmp_path / "report")
    assert list(tmp_path.iterdir()) == []
    (tmp_path / "aside").mkdir()
    pages.write(rows.where("page <> 'p7.md'"), tmp_path / "aside", tmp_path / "report")
    assert [p.name for p in tmp_path.iterdir()] == ["report"] and len(list((tmp_path / "report").iterdir())) == 19


def test_text_tree(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "A.cs").write_text("class A {}\n")
    (tmp_path / "B.g.cs").write_text("")
    got = {r["source_path"]: r["generated"] for r in facts.read_text_tree(spark, str(tmp_path)).collect()}
    assert got == {"x/A.cs": False, "B.g.cs": True}


def test_markup_tree(spark, tmp_path):
    root = tmp_path / "temp" / "project"  # only folders below the root are left out
    for f, text in (("a.razor", "<p/>"), ("sub/b.js", ""), ("obj/c.js", "x"), ("node_modules/d/e.js", ""), ("f.cs", "")):
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_text(text)
    got = {r["file_path"]: r["text"] for r in facts.markup(spark, str(root)).collect()}
    assert got == {"a.razor": "<p/>", "sub/b.js": ""}
    with pytest.raises(ValueError):
        facts.markup(spark, str(root), most_files=1)


def test_markdown_pieces():
    assert report.code_span("a`b") == "``a`b``"
    assert report.number(2.0) == "2" and report.number(0.125) in ("0.12", "0.13")
    assert report.escape("a*b\nc") == "a\\*b c"


def test_command_line(spark, tmp_path, capsys):
    from factloom import cli

    assert cli.main([str(tmp_path / "none")]) == 2
    assert cli.main([str(tmp_path)]) == 2
    decl = [("p", "a.cs", "T", "type", "Größe", None, "Internal", [], 3)]
    spark.createDataFrame(decl, facts.SCHEMAS["declarations"]).write.parquet(f"{tmp_path}/declarations.parquet")
    with pytest.raises(cli.Failed, match="statements"):  # tables that enabled analyses read aren't there
        cli.review(str(tmp_path), None, str(tmp_path / "out"), spark)
    for name, schema in facts.SCHEMAS.items():
        if name != "declarations":
            spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    config_file = tmp_path / "review.json"
    text = json.loads(config.default("facts", registry()))
    for a in text["analyses"]:
        a["enabled"] = a["id"] in ("non-ascii-identifiers", "type-dependency-hub-candidates", "type-dependency-cycle-candidates")
    config_file.write_text(json.dumps(text))
    # The finding's source isn't there: nothing is published.
    with pytest.raises(cli.Failed, match="1 unknown-source") as failed:
        cli.review(str(tmp_path), str(config_file), str(tmp_path / "out"), spark)
    assert failed.value.code == 3 and not (tmp_path / "out").exists()
    document = ("p", "a.cs", "Production", "one line", False)
    spark.createDataFrame([document], facts.SCHEMAS["documents"]).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(cli.Failed, match="1 line-out-of-range"):
        cli.review(str(tmp_path), str(config_file), str(tmp_path / "out"), spark)
    spark.createDataFrame([(*document[:3], "1\n2\n3", False)], facts.SCHEMAS["documents"]).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = cli.review(str(tmp_path), str(config_file), str(tmp_path / "out"), spark)
    assert out["findings"]["non-ascii-identifiers"] == 1 and (tmp_path / "out").exists()


def test_interrupts_publish_nothing_and_end_what_runs(spark, tmp_path, monkeypatch):
    from factloom import cli

    for name, schema in facts.SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    ended = []

    def stop(self, facts_, options):
        raise KeyboardInterrupt

    monkeypatch.setattr(type(spark), "interruptTag", lambda self, tag: ended.append(tag) or [])
    monkeypatch.setattr("factloom.options.Analysis.run", stop, raising=False)
    monkeypatch.setattr(cli, "registry", lambda: _stopping(registry(), stop))
    with pytest.raises(KeyboardInterrupt):
        cli.review(str(tmp_path), None, str(tmp_path / "out"), spark)
    assert len(ended) == 1 and ended[0] not in spark.getTags() and not (tmp_path / "out").exists()


def _stopping(r, stop):
    for a in r:
        object.__setattr__(a, "run", lambda tables, options: stop(a, tables, options))
    return r


def test_shared_artifacts_are_built_once_and_dropped(spark):
    from factloom.runtime import Artifacts

    built, artifacts = [], Artifacts()

    def build():
        built.append(1)
        return spark.range(3)

    def fail():
        raise ValueError

    with pytest.raises(ValueError):
        artifacts.get("a", fail)
    assert artifacts.get("a", build).count() == artifacts.get("a", build).count() == 3 and len(built) == 1
    path = artifacts.get("a", build)._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    artifacts.close()
    assert not __import__("os").path.exists(path.removeprefix("file:"))
    assert artifacts.get("a", build).count() == 3 and len(built) == 2


def test_checked_findings(spark):
    from pyspark.sql import Observation

    from factloom.operators.findings import KEY, checked

    schema = ", ".join(f"{k} string" for k in KEY) + ", start_line int, metrics map<string,double>"
    good = ("a", "p", "a.cs", "s", "d", 2, {"x": 1.0})
    bad = [good, good, ("a", "p", "b.cs", "s", "d", 1, {}), ("a", "p", "a.cs", "t", "d", 4, None), ("a", "p", "a.cs", "u", "d", 0, {"x": float("nan")})]
    documents = spark.createDataFrame([("p", "a.cs", 3)], "project_path string, source_path string, lines long")
    for rows, wanted in ((bad, {"findings": 5, "duplicate-key": 2, "unknown-source": 1, "line-out-of-range": 2, "metric-not-finite": 1}), ([good], {"findings": 1, "duplicate-key": 0, "unknown-source": 0, "line-out-of-range": 0, "metric-not-finite": 0})):
        seen = Observation()
        assert checked(spark.createDataFrame(rows, schema), documents, seen).count() == len(rows)
        assert seen.get == wanted


def test_markup_uses(spark):
    from factloom.sources import markup

    rows = [("a.xaml", '<Window x:Class="N.Main"><Button Click="Go" Text="{Binding Path=Item.Name}"/></Window>'), ("b.razor", '@page "/x"\n<Card @onclick="Save">@Total</Card>'), ("c.js", "DotNet.invokeMethodAsync('Asm', 'Tick')")]
    got = {(r["kind"], r["name"]) for r in markup.uses(spark.createDataFrame(rows, "file_path string, text string")).collect()}
    assert got >= {("class", "Main"), ("handler", "Go"), ("binding", "Name"), ("event", "Save"), ("component", "Card"), ("member", "Total"), ("script", "Tick")}
    assert ("member", "page") not in got
