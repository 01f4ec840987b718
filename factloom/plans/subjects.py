"""Named queries of the operators in operators.subjects over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import subjects
from ..runtime import table
from .signals import query

_TREE = "p AS (SELECT p_partkey AS node, CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey // 10 END AS parent, p_size, p_brand FROM part)"
_ABOVE = "c AS (SELECT node, node AS ancestor, 0 AS depth FROM p UNION ALL SELECT c.node, p.parent, c.depth + 1 FROM c JOIN p ON p.node = c.ancestor WHERE p.parent IS NOT NULL)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    parent = F.when(F.col("p_partkey") != 0, F.expr("p_partkey div 10"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), parent.alias("parent"), "p_size", "p_brand")


@query(f"WITH RECURSIVE {_TREE}, {_ABOVE} SELECT DISTINCT node FROM c WHERE ancestor IN (SELECT node FROM p WHERE p_size % 25 = 3)")
def generated_symbols(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    names = F.when(F.col("p_size") % 25 == 3, F.array(F.lit(subjects.GENERATED[0]))).otherwise(F.array(F.col("p_brand")))
    return subjects.generated_symbols(tree.withColumn("attributes", names), tree)


@query(f"WITH RECURSIVE {_TREE}, {_ABOVE} SELECT DISTINCT ancestor AS node FROM c WHERE node IN (SELECT node FROM p WHERE p_size = 7)")
def entry_chains(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    return subjects.entry_chain(tree.where("p_size = 7"), tree)


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_linenumber <= 5 AND l_returnflag <> 'R' AND l_linestatus = 'O' AND l_quantity <> 7 AND l_discount <> 0.05 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def candidate_methods(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_orderkey").alias("node"),
        F.when(F.col("l_linenumber") <= 5, "ordinary").otherwise("accessor").alias("method_kind"), (F.col("l_returnflag") == "R").alias("is_implicit"),
        F.when(F.col("l_linestatus") == "O", "class").otherwise("interface").alias("container_kind"), (F.col("l_quantity") == 7).alias("is_override"), (F.col("l_discount") == 0.05).alias("implements_interface"),
    )
    generated = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("node"))
    return subjects.candidate_methods(rows, generated).select("l_orderkey", "l_linenumber")


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_linestatus = 'O' AND l_quantity >= 3 AND l_tax <> 0.08 AND l_linenumber <> 6 AND l_partkey % 97 <> 0 AND l_suppkey % 10 <> l_partkey % 10 AND l_returnflag = 'N' AND l_discount < 0.09""")
def transparent_forwarders(spark: SparkSession, d: str) -> DataFrame:
    no = F.lit(False)
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(
        "l_orderkey", "l_linenumber", (F.col("l_linestatus") != "O").alias("is_async"), no.alias("is_abstract"), no.alias("is_extern"), (F.col("l_quantity") >= 3).alias("is_single_invocation"),
        F.when(F.col("l_tax") == 0.08, "operator").otherwise("ordinary").alias("target_kind"), (F.col("l_linenumber") == 6).alias("target_is_extension"), (F.col("l_partkey") % 97 == 0).alias("target_is_generated"), F.lit("a/B.CS").alias("target_path"),
        (F.col("l_suppkey") % 10).alias("type"), (F.col("l_partkey") % 10).alias("target_type"), F.lit("A").alias("assembly"), F.lit("A").alias("target_assembly"), F.lit("p").alias("project"), F.lit("p").alias("target_project"),
        (F.col("l_returnflag") == "N").alias("has_allowed_receiver"), (F.col("l_discount") < 0.09).alias("has_identity_return"), F.lit(True).alias("forwards_all_arguments"),
    )
    return subjects.transparent_forwarders(rows).select("l_orderkey", "l_linenumber")


@query(f"""
WITH RECURSIVE {_TREE}, {_ABOVE},
x AS (SELECT node FROM c WHERE ancestor IN (SELECT node FROM p WHERE p_size = 11) UNION SELECT node FROM c WHERE depth > 0 AND ancestor IN (SELECT node FROM p WHERE p_size = 12)),
a AS (SELECT node FROM p WHERE p_size IN (20, 21, 24) UNION SELECT node FROM p WHERE p_size = 30 AND parent IN (SELECT node FROM p WHERE p_size % 2 = 0))
SELECT node FROM p WHERE p_brand <> 'Brand#11' AND node IN (SELECT node FROM a) AND node NOT IN (SELECT node FROM x)""")
def active_test_roots(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    is_ = lambda *sizes: F.col("p_size").isin(*sizes)
    one = lambda name: F.array(F.lit(name))
    none = F.create_map().cast("map<string,string>")
    named = lambda *pairs: F.create_map(*map(F.lit, pairs))
    rows = [
        (is_(11), one(subjects.EXCLUDED[0]), none), (is_(12), one(subjects.NUNIT_FIXTURE), named("Explicit", "true")), (is_(20), F.array(F.lit("My.Fact"), F.lit(subjects.XUNIT[0])), none),
        (is_(21), one(subjects.XUNIT[1]), named("Skip", "no", "SkipWhen", "Slow")), (is_(22), one(subjects.XUNIT[0]), named("Skip", "no")), (is_(23), one(subjects.XUNIT[0]), named("Explicit", "true")), (is_(24), one(subjects.NUNIT[1]), none),
        (is_(30), one(subjects.MSTEST[0]), none), (F.col("p_size") % 2 == 0, one(subjects.MSTEST_CLASS), none),
    ]
    attributes = None
    for on, names, arguments in rows:
        some = tree.where(on).select("node", names.alias("names"), arguments.alias("arguments"))
        attributes = some if attributes is None else attributes.unionByName(some)
    return subjects.active_test_roots(tree.withColumn("is_test_project", F.col("p_brand") != "Brand#11"), attributes, tree)


@query("SELECT l_orderkey, l_linenumber, s_suppkey AS project FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def resolved_owners(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("assembly"))
    owners = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), F.col("s_suppkey").alias("assembly"))
    return subjects.resolved_owners(rows, owners).select("l_orderkey", "l_linenumber", "project")


@query("""
WITH o AS (SELECT o_custkey, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL HAVING count(*) = 1)
SELECT c_custkey, o_orderdate, o_orderkey FROM customer JOIN o ON o_custkey = c_custkey""")
def same_identity(spark: SparkSession, d: str) -> DataFrame:
    declared = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey")
    symbols = table(spark, d, "customer").select("c_custkey").join(declared.select("c_custkey", "o_orderdate").distinct(), "c_custkey")
    return subjects.same_identity(symbols, declared, ["c_custkey", "o_orderdate"])


@query("""
SELECT n_name AS name, r_name AS namespace, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS files
FROM nation JOIN region ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def type_map(spark: SparkSession, d: str) -> DataFrame:
    declared = table(spark, d, "customer").select(F.col("c_nationkey").alias("type"), F.col("c_mktsegment").alias("source_path"))
    types = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("type"), F.col("n_name").alias("name"), F.col("r_name").alias("namespace"))
    types = types.join(declared.select("type"), "type", "left_semi")
    return subjects.type_map(types, declared).select("name", "namespace", F.array_join("files", ",").alias("files"))


@query("""
WITH e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT x.n_name AS from_id, y.n_name AS to_id FROM e JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b""")
def mapped_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    joined = lines.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("a")), "c_custkey")
    joined = joined.join(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b")), "s_suppkey")
    return subjects.mapped_edges(joined, table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("id")))


@query("""
SELECT l_partkey, l_linestatus AS source_path, l_orderkey AS "offset" FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_linestatus, l_orderkey * 10 + l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def one_declaration(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select("l_partkey", F.col("l_linestatus").alias("source_path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offset"), (F.col("l_returnflag") == "R").alias("has_body"))
    return subjects.one_declaration(parts, ["l_partkey"]).select("l_partkey", "source_path", F.expr("offset div 10").alias("offset"))


@query("""
SELECT p_brand AS project, p_type || '.cs' AS path, min(p_partkey) AS id FROM part WHERE p_size % 5 <> 0 GROUP BY ALL""")
def first_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("project"), F.concat("p_type", F.lit(".cs")).alias("path"), F.lit("").alias("name"), F.col("p_partkey").alias("id"), (F.col("p_size") % 5 == 0).alias("generated"))
    return subjects.first_documents(rows).select("project", "path", "id")


@query("""
SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey DESC, s_name, s_suppkey) AS rank FROM supplier""")
def cluster_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("score"), F.col("s_name").alias("project_path"), F.lit("").alias("source_path"), F.lit(1).alias("line"), F.col("s_suppkey").alias("identity"))
    return subjects.cluster_order(rows).select("s_suppkey", "rank")


@query("""
WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey // 2 AS b FROM supplier WHERE s_suppkey // 2 <> s_suppkey AND s_suppkey // 2 IN (SELECT s_suppkey FROM supplier)),
r AS (SELECT s_suppkey AS origin, s_suppkey AS project FROM supplier UNION SELECT origin, b FROM r JOIN e ON a = project)
SELECT * FROM r""")
def reference_areas(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), F.array(F.expr("s_suppkey div 2"), F.col("s_suppkey")).alias("references"))
    return subjects.reference_areas(projects, subjects.project_references(projects))


@query("SELECT c_nationkey, bool_and(c_acctbal < 9000) AS all_uncertain FROM customer GROUP BY c_nationkey")
def all_uncertain(spark: SparkSession, d: str) -> DataFrame:
    return subjects.all_uncertain(table(spark, d, "customer").select("c_nationkey", (F.col("c_acctbal") < 9000).alias("uncertain")), ["c_nationkey"])


@query("SELECT DISTINCT o_orderpriority AS project, o_orderstatus AS reason FROM orders WHERE o_totalprice > 100000")
def scope_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return subjects.scope_exclusions(table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_orderpriority").alias("project"), F.col("o_orderstatus").alias("reason")))
