"""Boundary cases of the review operators as small rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import classify, findings, fragments, graphs, identifiers, percentiles, references, similarity, sizes, subjects
from factloom.plans.catalog import QUERIES

from .harness import dealt


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_nearest_rank_keeps_the_double_artefact(spark):
    df = spark.range(1, 451).select(F.lit("p").alias("g"), F.col("id").alias("v"))
    assert got(percentiles.cutoffs(df, ["g"], "v", F.lit(54), []), "population", "cutoff") == [(450, 244)]


def test_outliers_keep_ties_at_the_cutoff(spark):
    rows = [("p", i, 8 if i > 8 else 1, 1, 2) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "g string, id long, d long, n long, c long")
    out = percentiles.outliers(df, ["g"], "d", "n", "c", ["id"], F.lit(90))
    assert got(out, "id", "first_cutoff", "population", "first_rank") == [(9, 8, 10, 1), (10, 8, 10, 1)]


@pytest.mark.parametrize("rows,wanted", [
    ([("m", 90, 0, 0, 0)], []),
    ([("m", 90, 0, 0, 4)], ["m"]),
    ([("m", 300, 0, 0, 0)], ["m"]),
    ([("m", 79, 9, 2, 4)], []),
])
def test_member_selection(spark, rows, wanted):
    df = spark.createDataFrame([("p", *r) for r in rows], "g string, id string, lines long, decisions long, constructs long, nesting long")
    assert [r["id"] for r in sizes.select_members(df, ["g"], ["id"], F.lit(90)).collect()] == wanted


def test_line_count_and_first_line(spark):
    df = spark.createDataFrame([("a\r\nb\rc\n",), ("",), ("\n  x ",)], "t string")
    rows = df.select(sizes.line_count(F.col("t")).alias("n"), sizes.first_line(F.col("t")).alias("f")).collect()
    assert [(r["n"], r["f"]) for r in rows] == [(4, "a"), (1, None), (2, "x")]


@pytest.mark.parametrize("name,wanted", [("Acme.tests", True), ("tests", True), ("AcmeTests", True), ("latest", False), ("Contest", False), ("AcmeSpec", True), ("Acmespec", False), (None, False)])
def test_test_suffix(spark, name, wanted):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(classify.has_test_suffix(F.col("n")).alias("x")).first()["x"] == wanted


def test_generated_marker_must_be_among_the_first_five_lines(spark):
    df = spark.createDataFrame([("a.cs", "\n" * 4 + "// <AUTO-generated>"), ("a.cs", "\n" * 5 + "// <auto-generated>"), ("x/OBJ/a.cs", ""), ("A.Designer.cs", "")], "p string, t string")
    assert [r["g"] for r in df.select(classify.is_generated(F.col("p"), F.col("t")).alias("g")).collect()] == [True, False, True, True]


def test_identifiers(spark):
    df = spark.createDataFrame([("größe",), ("@plain",), ("x_1",), ("naïve",)], "n string")
    assert [r["c"] for r in df.select(identifiers.offending(F.col("n")).alias("c")).collect()] == ["ö", None, None, "ï"]


def test_similarity_levels_and_clusters(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, base), (2, base[:]), (3, [*base[:-1], "z"]), (4, [f"q{i}" for i in range(29)]), (5, [f"q{i}" for i in range(29)])]
    sets = similarity.gram_sets(spark.createDataFrame(rows, "id long, tk array<string>"), "id", "tk")
    exact = similarity.similar_pairs(sets, 0.95)
    assert got(exact, "a", "b") == [(1, 2), (1, 3), (2, 3)]
    out = got(similarity.clusters(exact), "cluster_id", "member")
    assert out == [(1, 1), (1, 2), (1, 3)]
    assert min(r["score"] for r in exact.collect()) == 55 / 57


def test_fragments_need_two_owners_and_are_maximal(spark):
    rows = [(o, 0, i, f"s{i}", 20, True) for o in ("a", "b") for i in range(4)] + [("c", 0, i, f"t{i}", 20, True) for i in range(4)]
    df = spark.createDataFrame(rows, "owner string, list_id int, ordinal long, form string, tokens long, eligible boolean")
    runs = fragments.groups(fragments.windows(df, ["owner"], 3, 60), ["owner"])
    assert len(runs.collect()) == 6
    assert got(fragments.maximal(runs, ["owner"]), "owner", "first", "last") == [("a", 0, 3), ("b", 0, 3)]


def test_maximal_equals_the_definition(spark):
    import random

    for seed in range(6):
        rnd = random.Random(seed)
        lists = {o: [rnd.choice("ab" if seed % 2 else "abc") for _ in range(rnd.randint(3, 9))] for o in range(6)}
        lists[1] = lists[0] + lists[0][:4]
        rows = [(o, 0, i, x, 30, True) for o, xs in lists.items() for i, x in enumerate(xs)]
        df = spark.createDataFrame(rows, "owner long, list_id int, ordinal long, form string, tokens long, eligible boolean")
        out = got(fragments.maximal(fragments.groups(fragments.windows(df, ["owner"], 3, 60), ["owner"]), ["owner"]), "owner", "first", "last")
        runs = {}
        for o, xs in lists.items():
            for i in range(len(xs)):
                for j in range(i + 2, len(xs)):
                    runs.setdefault("".join(xs[i : j + 1]), []).append((o, i, j))
        runs = {k: v for k, v in runs.items() if len({o for o, _, _ in v}) > 1}
        within = lambda x, ys: any(o == x[0] and i <= x[1] and x[2] <= j for o, i, j in ys)
        kept = [k for k, v in runs.items() if not any(len(m) > len(k) and all(within(x, w) for x in v) for m, w in runs.items())]
        assert out == sorted(x for k in kept for x in runs[k])


def test_an_ineligible_statement_ends_a_run(spark):
    df = spark.createDataFrame([("a", 0, i, f"s{i}", 30, i != 2) for i in range(5)], "owner string, list_id int, ordinal long, form string, tokens long, eligible boolean")
    assert fragments.windows(df, ["owner"], 3, 60).count() == 0


def test_numbering_by_first_occurrence(spark):
    df = spark.createDataFrame([(["x", "y", "x", "z"],)], "s array<string>")
    assert df.select(fragments.numbered_symbols(F.col("s"), "L").alias("n")).first()["n"] == ["L0", "L1", "L0", "L2"]


def test_normalized_numbers_the_whole_row(spark):
    many = [f"w{i * i % 97}" for i in range(300)]
    rows = [(1, many), (2, [*many[:299], "other"]), (2, ["x", "y", "x"]), (3, None), (4, []), (5, [""])]
    out = fragments.normalized(spark.createDataFrame(rows, "id int, s array<string>"), ["id"], F.col("s"), "L")

    def form(s):
        return ",".join(f"L{list(dict.fromkeys(s)).index(x)}" for x in s) if s else None

    assert sorted(map(tuple, out.collect()), key=str) == sorted(((i, form(s)) for i, s in rows), key=str)


def test_identifier_findings_reach_all_words(spark, tmp_path):
    text = "plain " * 50
    rows = [(2, f"{text}é-x", "s"), (1, f"{text}\n aé bé aé", "s"), (3, "naïve", "t"), (4, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["identifier_findings"](spark, str(tmp_path))
    assert got(out, "doc_id", "word", "character", "discriminator") == [(1, "aé", "é", "identifier"), (1, "bé", "é", "identifier:1"), (2, "é-x", "é", "identifier:2"), (3, "naïve", "ï", "identifier")]


def test_names_of_all_words_are_protected_or_uncertain(spark, tmp_path):
    rows = [(1, "once own both " * 30), (2, "own " * 50 + "both"), (3, "none\nlast"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    html = "".join(f'<a href="/{n}">' for n in ("once", "both", "last", "absent"))
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = QUERIES["protect_uncertain"](spark, str(tmp_path))
    assert got(out, "symbol", "state") == [(1, "protected"), (2, "uncertain"), (3, "protected")]


def test_names_that_nothing_uses_are_not_dealt(spark):
    uses = spark.createDataFrame([("n7",), ("n8",), ("same",), ("absent",), (None,)], "name string")
    declared = spark.range(20_000).selectExpr("concat('n', id) as name", "id as symbol")
    more = [("same", 7), ("same", 9), ("same", 9), ("n8", 8), ("n8", None), (None, 3), ("", 4)]
    declared = declared.unionByName(spark.createDataFrame(more, "name string, symbol long"))
    assert dealt(spark, lambda: references.match_names(uses, declared).collect()) < 2_000
    assert sorted(map(tuple, references.match_names(uses, declared).collect()), key=str) == [(7, "protected"), (8, "uncertain"), (9, "uncertain"), (None, "uncertain")]
    assert references.match_names(uses.where("false"), declared).count() == 0


def test_a_filter_keeps_all_that_is_among_the_keys(spark):
    rows = spark.range(50_000).selectExpr("id as a", "cast(id % 7 as string) as b")
    keys = rows.where("a % 10 = 0").selectExpr("cast(a as int) as a", "b")
    left = {r["a"] for r in references.among(rows, keys, ["a", "b"]).collect()}
    assert left >= set(range(0, 50_000, 10)) and len(left) < 6_000


EDGES = [("A", "B"), ("B", "A"), ("B", "C"), ("C", "A"), ("D", "E"), ("E", "D"), ("X", "Y"), ("Y", "Z")]


def test_strong_components_and_cycle(spark):
    edges = spark.createDataFrame(EDGES, "a string, b string")
    comps = graphs.strong_components(edges)
    assert dict(got(comps, "node", "component")) == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D", "X": "X", "Y": "Y", "Z": "Z"}
    files = spark.createDataFrame([(n, f"{n}.cs", "p") for n in "ABCDE"] + [("A", "A2.cs", "p")], "node string, file string, project string")
    assert got(graphs.qualified_components(comps, edges, files), "component", "nodes", "files", "internal_edges") == [("A", 3, 4, 4)]
    assert ("A", ["A", "B", "A"]) in got(graphs.example_cycles(comps, edges), "component", "path")


def test_forwarding_paths(spark):
    rows = [("ZRoot", "Middle"), ("Other", "Middle"), ("Middle", "End"), ("End", None), ("L", "M"), ("M", "N"), ("N", "M")]
    df = spark.createDataFrame(rows, "node string, target string")
    assert got(graphs.forwarding_paths(df), "root", "path") == [("Other", ["Other", "Middle", "End"]), ("ZRoot", ["ZRoot", "Middle", "End"])]
    with pytest.raises(ValueError):
        graphs.forwarding_paths(spark.createDataFrame([("a", "gone")], "node string, target string"))


def test_reach_prefers_direct(spark):
    nodes = spark.createDataFrame([("T", True, False), ("E", False, True), ("D", False, True), ("I", False, True), ("U", False, True)], "node string, is_root boolean, is_production boolean")
    edges = spark.createDataFrame([("T", "E"), ("T", "D"), ("E", "I"), ("E", "D")], "a string, b string")
    assert got(graphs.reach(edges, nodes), "node", "kind") == [("D", "Direct"), ("E", "Direct"), ("I", "Indirect"), ("U", "NoPath")]


def test_uncertainty(spark):
    nodes = spark.createDataFrame([(x,) for x in "TABCD"], "node string")
    edges = spark.createDataFrame([("T", "A"), ("A", "B"), ("C", "D")], "a string, b string")
    roots = nodes.where("node = 'T'")
    mark = lambda rows: dict(got(graphs.uncertain(edges, nodes, spark.createDataFrame(rows, "source string, node string, is_global boolean"), roots), "node", "uncertain"))
    assert mark([("A", "A", False), ("C", None, True)]) == {"T": False, "A": True, "B": True, "C": False, "D": False}
    assert all(mark([("B", None, True)]).values())
    # The source is met, what it affects isn't; and the other way round.
    assert mark([("B", "C", False)]) == {"T": False, "A": False, "B": False, "C": True, "D": True}
    assert not any(mark([("C", "A", False)]).values())


def test_empty_graphs(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert graphs.strong_components(none).count() == 0
    assert graphs.components(none).count() == 0


def test_parents_that_form_a_cycle_are_an_error(spark):
    with pytest.raises(ValueError):
        graphs.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"))


def test_name_matches(spark):
    uses = spark.createDataFrame([("one", "tag"), ("two", "tag"), ("none", "tag")], "name string, kind string")
    declared = spark.createDataFrame([("one", 1), ("two", 2), ("two", 3)], "name string, symbol long")
    assert got(references.match_names(uses, declared), "symbol", "state") == [(1, "protected"), (2, "uncertain"), (3, "uncertain")]


def test_member_matches(spark):
    members = spark.createDataFrame([("X", "Go", 1, True), ("X", "Two", 2, True), ("X", "Two", 3, True), ("Y", "Save", 4, True), ("Y", "Save", 5, False), ("Z", "Any", 6, True), ("Z", "Prop", 7, False)], "owner string, name string, symbol long, is_method boolean")
    use = lambda *rows: got(references.match_members(spark.createDataFrame(rows, "owner string, name string"), members), "symbol", "state")
    assert use(("X", "Go"), ("X", "Two")) == [(1, "protected"), (2, "uncertain"), (3, "uncertain")]
    assert use(("X", "Save")) == [(4, "uncertain")] and use((None, "Go"), ("X", "Go")) == [(1, "protected")]
    assert use(("Z", None)) == [(6, "uncertain")] and use(("X", "Nowhere")) == []


def test_project_keys_and_type_ids(spark):
    paths = ["src/..A b+c.csproj", "src/" + "x" * 40 + ".csproj", "src/+.csproj"]
    keys = [r["k"] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(findings.project_key(F.col("p")).alias("k")).collect()]
    digest = lambda t, n: hashlib.sha256(t.encode()).hexdigest()[:n]
    assert keys == [f"p-{slug}-{digest(p, 8)}" for slug, p in zip(["A-b-c", "x" * 32, "project"], paths, strict=True)]
    row = spark.range(1).select(findings.type_id(F.lit(keys[0]), F.lit("T:N.C")).alias("t")).first()
    assert row["t"] == "t-" + digest(f"{keys[0]}:T:N.C", 16)


def test_longest_prefix(spark):
    owners = spark.createDataFrame([("", "root"), ("a/b", "ab"), ("a", "a")], "dir string, owner string")
    paths = spark.createDataFrame([("a/b/c.x",), ("a/c.x",), ("z.x",), ("ab/c.x",)], "path string")
    assert got(references.owner_by_longest_prefix(paths, owners), "path", "owner") == [("a/b/c.x", "ab"), ("a/c.x", "a"), ("ab/c.x", "root"), ("z.x", "root")]


def test_finding_ids_tell_parts_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string")
    ids = [r["i"] for r in df.select(findings.finding_id(F.col("x"), F.col("y")).alias("i")).collect()]
    assert ids[0] != ids[1] and all(len(i) == 32 for i in ids)


def test_components_with_a_centre_of_many_edges(spark, monkeypatch):
    """A star of 3,000, a chain and a ring: the centre's rows don't meet by the centre."""
    monkeypatch.setattr(graphs, "CENTRE_EDGES", 50)
    monkeypatch.setattr(graphs, "CENTRES", 20)
    pairs = [(1500, i) for i in range(3000) if i != 1500] + [(10_000 + i, 10_001 + i) for i in range(64)] + [(20_000 + i, 20_000 + (i + 1) % 40) for i in range(40)]
    out = {r["node"]: r["root"] for r in graphs.components(spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect()}
    assert out == {i: 0 for i in range(3000)} | {10_000 + i: 10_000 for i in range(65)} | {20_000 + i: 20_000 for i in range(40)}


def statements(spark, lists, tokens=25):
    """Owner to statements, each a list of parts: text, or (category, symbol, type)."""
    rows = [(o, 0, i, tokens, True, False, False, [(None, x, None, None) if isinstance(x, str) else (x[0], None, x[1], x[2]) for x in s]) for o, body in lists.items() for i, s in enumerate(body)]
    return spark.createDataFrame(rows, f"owner string, list_id int, ordinal long, tokens long, eligible boolean, nested_executable boolean, binding_barrier boolean, parts {fragments.PARTS}")


def body(a, b, of="int", call="Use"):
    return [["var", ("L", a, of), "=1"], ["var", ("L", b, of), "=", ("L", a, of)], [call, ("L", a, of), ("L", b, of), ("P", "p", "string")]]


@pytest.mark.parametrize("other,wanted", [
    (body("x", "y"), 2),  # renamed
    (body("x", "y", "long"), 0),  # another type
    ([*body("x", "y")[:2], ["Use", ("L", "y", "int"), ("L", "x", "int"), ("P", "p", "string")]], 0),  # the other way round
    (body("x", "x"), 0),  # one symbol for two
    (body("x", "y", call="Take"), 0),  # another text
    ([[("L", "before", "int")], *body("x", "y")], 2),  # more around it
])
def test_renamed_fragments(spark, other, wanted):
    df = fragments.barred(statements(spark, {"a": body("m", "n"), "b": other}))
    runs = fragments.groups(fragments.windows(fragments.shared_only(df, ["owner"]), ["owner"], 3, 60), ["owner"])
    assert runs.count() == wanted


def test_fragments_stop_at_barriers(spark):
    for barrier in ("nested_executable", "binding_barrier"):
        df = statements(spark, {"a": body("m", "n") * 2, "b": body("x", "y") * 2}).withColumn(barrier, F.col("ordinal") == 3)
        assert {r["last"] - r["first"] for r in fragments.windows(fragments.barred(df), ["owner"], 3, 60).collect()} == {2}
    untyped = statements(spark, {"a": body("m", "n", None), "b": body("x", "y", None)})
    assert fragments.windows(fragments.barred(untyped), ["owner"], 3, 60).count() == 0


def test_fragments_of_many_equal_statements(spark):
    """Two lists of 300 equal statements: one group stays, all shorter ones lie within it."""
    df = statements(spark, {o: [["same"]] * 300 for o in "ab"})
    runs = fragments.groups(fragments.windows(fragments.shared_only(fragments.barred(df), ["owner"]), ["owner"], 3, 60), ["owner"])
    assert runs.count() == 2 * sum(range(1, 299))
    assert got(fragments.maximal(runs, ["owner"]), "owner", "first", "last") == [("a", 0, 299), ("b", 0, 299)]


def test_type_keys(spark):
    leaf = lambda name, null="0": (name + null, False, null, [("Named", name, None)])
    nodes = [
        leaf("int"), leaf("int", "1"), leaf("text"), ("list", False, "0", [("Named", "List", None), ("Argument", None, "int0")]), ("list?", False, "0", [("Named", "List", None), ("Argument", None, "int1")]),
        ("nested", False, "0", [("Named", "Map", None), ("Argument", None, "list"), ("Argument", None, "text0")]), ("bad", True, "0", []), ("of bad", False, "0", [("Argument", None, "bad")]), ("twin", False, "0", [("Named", "List", None), ("Argument", None, "int0")]),
    ]
    schema = "type string, is_error boolean, annotation string, parts array<struct<tag:string,value:string,child:string>>"
    keys = {r["type"]: r["key"] for r in fragments.type_keys(spark.createDataFrame(nodes, schema)).collect()}
    assert keys["bad"] is None and keys["of bad"] is None and keys["list"] == keys["twin"]
    assert len(set(keys.values())) == 7
    with pytest.raises(ValueError):
        fragments.type_keys(spark.createDataFrame([("a", False, "0", [("t", None, "b")]), ("b", False, "0", [("t", None, "a")])], schema))


def test_forwarding_paths_of_any_length_take_few_rounds(spark):
    chain = [(i, i + 1 if i < 600 else None) for i in range(601)]
    more = [(1000, 5), (2000, 2001), (2001, 2002), (2002, 2001), (3000, 2000), (4000, None), (5000, 4000)]
    df = spark.createDataFrame([*chain, *more], "node long, target long")
    out = {r["root"]: r["path"] for r in graphs.forwarding_paths(df, max_rounds=12).collect()}
    assert out == {0: list(range(601)), 1000: [1000, *range(5, 601)]}
    assert {r["root"] for r in graphs.forwarding_paths(df, least_edges=1, max_rounds=12).collect()} == {0, 1000, 5000}


def test_one_declaration_of_equal_places(spark):
    """Two parts at one place are one declaration, with a body or not; a missing key is a key, and missing places come last."""
    rows = [("A", "F", 21, True), ("A", "F", 21, False), ("A", "F", 21, True), ("B", "O", 7, False), ("B", "O", 7, False), ("B", None, 1, False), (None, "F", 3, None), (None, "F", None, False)]
    parts = spark.createDataFrame(rows, "symbol string, source_path string, offset long, has_body boolean")
    assert sorted(map(tuple, subjects.one_declaration(parts, ["symbol"]).select("symbol", "source_path", "offset").collect()), key=repr) == [("A", "F", 21), ("B", "O", 7), (None, "F", 3)]


def test_shared_windows_read_statements_once(spark):
    """The runs of windows(shared_only), with every statement read a single time, however often groups are looked at."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = fragments.barred(statements(spark, {"a": body("m", "n") + body("x", "y"), "b": body("q", "r"), "c": body("m", "n")[:2]}))
    wanted = got(fragments.windows(fragments.shared_only(df, ["owner"]), ["owner"], 3, 60), "owner", "first", "last", "tokens", "group")
    counted = df.mapInArrow(seen, df.schema)
    runs = fragments.groups(fragments.shared_windows(counted, ["owner"], 3, 60), ["owner"])
    assert wanted and got(runs, "owner", "first", "last", "tokens", "group") == [r for r in wanted if r[4] in {x["group"] for x in runs.collect()}]
    assert read.value == df.count()


def test_similar_pairs_keep_sets_once(spark, monkeypatch):
    """Sets of grams are kept once; all pairs are found, in classes of one and of several."""
    kept = []
    monkeypatch.setattr(similarity, "cut", lambda df: kept.append(df) or df.localCheckpoint())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sets = {i: sorted({(i // 3) * 1000 + j for j in range(40)} - {(i // 3) * 1000 + 39 * (i % 3 == 2)}) for i in range(12)}
        df = spark.createDataFrame([(i, s, len(s)) for i, s in sets.items()], "id long, grams array<long>, size int")
        wanted = [(a, b, len(set(sets[a]) & set(sets[b]))) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 0.65 * len(set(sets[a]) | set(sets[b]))]
        assert got(similarity.similar_pairs(df, 0.65), "a", "b", "shared") == wanted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("grams" in k.columns for k in kept) == 1


def test_similar_pairs_deal_first_grams_only(spark):
    """A part of each set's grams is dealt, and pairs are those of brute force: sets of many sizes, copies and common grams among them."""
    rng = random.Random(7)
    gram = lambda: rng.getrandbits(64) - (1 << 63)
    common, sets = [gram() for _ in range(20)], {}
    for i in range(80):
        base = {gram() for _ in range(rng.choice([20, 100, 600, 1500]))} | set(rng.sample(common, 10))
        for k, lost in enumerate((0, 0, 0.02, 0.1, 0.25, 0.5)[: rng.randint(1, 6)]):
            sets[10 * i + k] = sorted(set(rng.sample(sorted(base), int(len(base) * (1 - lost)))) | {gram() for _ in range(int(len(base) * lost / 4))})
    df = spark.createDataFrame([(i, s, len(s)) for i, s in sets.items()], "id long, grams array<long>, size int").localCheckpoint()
    known, grams = {i: set(s) for i, s in sets.items()}, sum(len(s) for s in sets.values())
    for threshold in (0.65, 0.95):
        wanted = [(a, b, n) for a in sets for b in sets if a < b and (n := len(known[a] & known[b])) >= max(3, threshold * len(known[a] | known[b]))]
        out = []
        rows = dealt(spark, lambda: out.extend(got(similarity.similar_pairs(df, threshold), "a", "b", "shared")))  # noqa: B023
        assert len(wanted) > 50 and out == wanted
        assert rows < (0.5 if threshold == 0.65 else 0.2) * grams


def test_odd_cells_tell_no_more_than_sets_differ():
    rng = random.Random(3)
    for m, n in ((5, 40), (64, 64), (300, 500)):
        a, b = {rng.getrandbits(63) for _ in range(m)}, {rng.getrandbits(63) for _ in range(n)}
        b |= set(sorted(a)[: m // 2])

        def odd(s, width):
            out = bytearray(width // 8)
            for x in s:
                out[(x % width) // 8] ^= 128 >> x % 8
            return bytes(out)

        assert 0 < similarity._unlike(odd(a, 256), odd(b, 1024)) <= len(a ^ b)
        assert similarity._unlike(odd(a, 128), odd(a, 512)) == 0


def test_fragment_runs_are_dealt_a_few_times(spark):
    """Groups and the largest of them deal a run a few times, whatever comes of it; runs of an owner that isn't known stay."""
    rng = random.Random(5)
    page = [f"s{i}" for i in range(30)]
    rows = [(o, 0, i, x, 30, True) for o in range(40) for i, x in enumerate([f"own{o}", *page[rng.randint(0, 3) :], "end"])]
    rows += [(None, 0, i, x, 30, True) for i, x in enumerate(page[5:12])]
    df = spark.createDataFrame(rows, "owner long, list_id int, ordinal long, form string, tokens long, eligible boolean").localCheckpoint()
    found, runs = [], fragments.shared_windows(df, ["owner"], 3, 60)
    made = runs.count()
    rows = dealt(spark, lambda: found.extend(fragments.maximal(fragments.groups(runs, ["owner"], once=True), ["owner"]).collect()))
    twice = fragments.groups(runs.unionAll(runs), ["owner"])
    assert sorted(map(str, twice.collect())) == sorted(map(str, fragments.groups(runs, ["owner"], once=True).collect()))
    # What an unknown owner has lies in no run: its groups stay, in all places.
    assert {(r["first"], r["last"]) for r in found if r["owner"] is None} == {(i, j) for i in range(7) for j in range(i + 2, 7)}
    assert rows < 7 * made


def test_pairs_meet_where_a_group_is_sent_once(spark, monkeypatch):
    """A group of sets that are alike sends each to one place, or to blocks of it where pairs are many, not once for each pair."""
    sent = []
    monkeypatch.setattr(similarity, "cut", lambda df: sent.append(df) or df.localCheckpoint())
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 40)], "ca long, cb long")
    sets = spark.createDataFrame([(i, [*range(i, i + 60)]) for i in range(40)], "c long, grams array<long>")
    wanted = [(a, b, 60 - b + a, (60 - b + a) / (60 + b - a)) for a in range(40) for b in range(a + 1, 40)]
    for tile, most in ((4096, 40), (100, 40 * 2 * 3)):
        monkeypatch.setattr(similarity, "TILE", tile)
        assert got(similarity._verified(pairs, sets), "ca", "cb", "shared", "score") == wanted
        assert 40 <= sent[-1].count() <= most and sent[-1].columns == ["to", "c"]
