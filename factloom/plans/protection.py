"""Named queries of the protection rules over the driver tables, with their SQL: parts are types, lines
are their members, customers are calls and bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs, protection
from ..runtime import table
from .signals import query

_SYMBOL = "l_partkey || ':' || l_orderkey || ':' || l_linenumber"
_MEMBERS = f"m AS (SELECT DISTINCT {_SYMBOL} AS symbol, l_partkey::VARCHAR AS type, CASE WHEN l_returnflag = 'R' THEN 'property' ELSE 'method' END AS kind, 'm' || l_quantity::INT AS name, * FROM lineitem)"


def _members(spark: SparkSession, d: str, **more: Column) -> DataFrame:
    rows = table(spark, d, "lineitem")
    symbol = F.concat_ws(":", "l_partkey", "l_orderkey", "l_linenumber")
    facets = {"name": F.concat(F.lit("m"), F.col("l_quantity").cast("int")), "assembly": F.lit("x"), "is_source": F.lit(True), "is_static": F.col("l_tax") == 0, "accessibility": F.when(F.col("l_quantity") < 40, "Public").otherwise("Private"), "first_parameter": F.lit(None).cast("string"), "overrides": F.lit(None).cast("string"), "overrides_source": F.lit(False), "value_core": F.when(F.col("l_linenumber") < 3, "enumerable").when(F.col("l_linenumber") == 3, "async_enumerable").otherwise("other"), "value_wraps": F.when(F.col("l_linestatus") == "F", 1).otherwise(0)}
    return rows.select(symbol.alias("symbol"), F.when(F.col("l_returnflag") == "R", "property").otherwise("method").alias("symbol_kind"), F.col("l_partkey").cast("string").alias("type"), F.lit("p").alias("project"), *[v.alias(k) for k, v in (facets | more).items()])


def _types(spark: SparkSession, d: str, members: DataFrame) -> DataFrame:
    own = {"symbol": F.col("p_partkey").cast("string"), "symbol_kind": F.lit("type"), "project": F.lit("p"), "name": F.col("p_name"), "assembly": F.concat(F.lit("a"), F.col("p_size") % 25), "is_source": F.lit(True)}
    return table(spark, d, "part").select(*[(own[f.name] if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in members.schema])


def _out(marks: DataFrame) -> DataFrame:
    return marks.select("symbol", "is_protected", "is_uncertain")


@query(f"""
WITH {_MEMBERS},
c AS (SELECT c_custkey::VARCHAR AS type, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'method' ELSE 'property' END AS kind,
  c_mktsegment IN ('AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD') AS takes, CASE WHEN c_mktsegment <> 'FURNITURE' THEN 'm' || c_nationkey END AS name FROM customer WHERE c_acctbal >= 0),
f AS (SELECT symbol, m.type, NOT takes OR c.name IS NOT NULL AS p FROM m JOIN c ON c.type = m.type AND c.kind = m.kind AND (NOT takes OR c.name IS NULL OR c.name = m.name)),
a AS (SELECT p_partkey::VARCHAR AS symbol FROM part WHERE p_size % 25 IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 3000)),
u AS (SELECT symbol, p AS is_protected, NOT p AS is_uncertain FROM f UNION ALL SELECT symbol, false, true FROM a UNION ALL SELECT type, true, false FROM f WHERE p)
SELECT symbol, bool_or(is_protected) AS is_protected, bool_or(is_uncertain) AS is_uncertain FROM u GROUP BY symbol""")
def reflection_marks(spark: SparkSession, d: str) -> DataFrame:
    """A member by constant name, all members of a kind, all of a kind uncertain, and the types of listed assemblies."""
    members = _members(spark, d)
    symbols = members.unionByName(_types(spark, d, members)).distinct()
    seg = F.col("c_mktsegment")
    target = F.when(seg.isin("AUTOMOBILE", "FURNITURE"), "GetMethod").when(seg == "BUILDING", "GetMethods").when(seg == "HOUSEHOLD", "GetProperty").otherwise("GetProperties")
    calls = table(spark, d, "customer").select(F.lit("a").alias("assembly"), F.lit("System.Type").alias("target_type"), target.alias("target_name"), (F.col("c_acctbal") < 0).alias("target_source"), F.col("c_custkey").cast("string").alias("typeof_type"), seg.isin("AUTOMOBILE", "FURNITURE", "HOUSEHOLD").alias("has_name_parameter"), F.when(seg != "FURNITURE", F.concat(F.lit("m"), "c_nationkey")).alias("name"))
    none = F.lit(None).cast("string")
    lists = table(spark, d, "supplier").where("s_acctbal < 3000").select(F.concat(F.lit("a"), "s_nationkey").alias("assembly"), F.lit(protection.ASSEMBLY_TYPES[0][0]).alias("target_type"), F.lit(protection.ASSEMBLY_TYPES[0][1]).alias("target_name"), F.lit(False).alias("target_source"), none.alias("typeof_type"), F.lit(False).alias("has_name_parameter"), none.alias("name"))
    return _out(protection.combined([protection.reflected(calls.unionByName(lists), symbols)], symbols))


@query(f"""
WITH {_MEMBERS},
t AS (SELECT c_custkey::VARCHAR AS type, c_mktsegment = 'MACHINERY' AS piped FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION SELECT (c_custkey + k)::VARCHAR, false FROM customer, (SELECT unnest([0, 1]) AS k) WHERE c_mktsegment = 'FURNITURE'),
h AS (SELECT DISTINCT symbol, m.type FROM m JOIN t ON t.type = m.type WHERE kind = 'method' AND (l_discount = 0.05 AND l_tax <= 0.04 OR l_linestatus = 'O' AND l_tax >= 0.02 OR piped AND l_quantity <= 2 AND l_tax <> 0 AND l_returnflag = 'A'))
SELECT DISTINCT symbol, true AS is_protected, false AS is_uncertain FROM (SELECT type AS symbol FROM t UNION ALL SELECT symbol FROM h)""")
def registration_marks(spark: SparkSession, d: str) -> DataFrame:
    """Registered types, their overrides and implementations of contracts without source, and middleware."""
    quantity = F.col("l_quantity").cast("int")
    members = _members(spark, d, name=F.when(quantity == 1, "Invoke").when(quantity == 2, "InvokeAsync").otherwise("m"), first_parameter=F.when(F.col("l_returnflag") == "A", protection.MIDDLEWARE_CONTEXT), overrides=F.when(F.col("l_discount") == 0.05, "base"), overrides_source=F.col("l_tax") > 0.04)
    lines = table(spark, d, "lineitem").where("l_linestatus = 'O'")
    contracts = lines.select(F.col("l_partkey").cast("string").alias("type"), (F.col("l_tax") < 0.02).alias("member_source"), F.concat_ws(":", "l_partkey", "l_orderkey", "l_linenumber").alias("implementation"), F.when(F.col("l_returnflag") == "R", "property").otherwise("method").alias("implementation_kind"))
    own, none, seg = F.array(F.col("c_custkey").cast("string")), F.array().cast("array<string>"), F.col("c_mktsegment")
    services = F.lit(protection.SERVICES + protection.SERVICE_CLASSES[0])
    calls = table(spark, d, "customer").select(F.when(seg == "MACHINERY", protection.MIDDLEWARE[0][0]).otherwise(services).alias("target_type"), F.when(seg == "MACHINERY", "UseMiddleware").when(seg == "BUILDING", "AddScoped").when(seg == "FURNITURE", "AddSingleton").otherwise("Configure").alias("target_name"), F.lit(False).alias("target_source"), F.when(seg == "FURNITURE", none).otherwise(own).alias("type_arguments"), F.when(seg == "FURNITURE", F.array_append(own, (F.col("c_custkey") + 1).cast("string"))).otherwise(none).alias("argument_types"))
    symbols = members.unionByName(_types(spark, d, members)).distinct()
    return _out(protection.combined([protection.registered(calls, symbols, contracts)], symbols))


@query(f"""
WITH RECURSIVE {_MEMBERS},
b AS (SELECT DISTINCT c_custkey AS source, CASE c_mktsegment WHEN 'BUILDING' THEN 'nunit' WHEN 'MACHINERY' THEN 'mstest' ELSE 'xunit' END AS framework, CASE WHEN c_nationkey <> 3 THEN 'm' || 2 * c_nationkey END AS wanted, c_acctbal > 5000 AS task, c_acctbal > 8000 AS later FROM customer),
a AS (SELECT p_partkey AS node, p_partkey AS ancestor FROM part UNION ALL SELECT node, ancestor // 10 FROM a WHERE ancestor > 0),
o AS (SELECT p_partkey AS node, p_partkey AS ancestor FROM part UNION ALL SELECT node, ancestor // 25 FROM o WHERE ancestor > 0),
i AS (SELECT DISTINCT node, symbol, name, kind, type, l_tax = 0 AS static, l_quantity < 40 AS open, CASE WHEN l_linenumber < 3 THEN 1 WHEN l_linenumber = 3 THEN 2 END AS core, l_linestatus = 'F' AS wrapped FROM a JOIN m ON m.l_partkey = a.ancestor),
n AS (SELECT b.*, (SELECT count(DISTINCT symbol) FROM i WHERE i.node = b.source AND i.name = b.wanted) AS n FROM b),
w AS (SELECT DISTINCT ancestor FROM o JOIN n ON n.source = o.node AND n.n = 0),
u AS (SELECT i.symbol, i.type, true AS p, n > 1 AS u FROM n JOIN i ON i.node = n.source AND i.name = n.wanted
  UNION ALL SELECT i.symbol, i.type, false, true FROM n JOIN i ON i.node = n.source WHERE n <> 1 AND static AND (open OR framework = 'nunit') AND (core = 1 OR core = 2 AND later) AND (NOT wrapped OR task)
  UNION ALL SELECT ancestor::VARCHAR, NULL, true, false FROM w
  UNION ALL SELECT symbol, type, true, false FROM m WHERE l_partkey IN (SELECT source FROM n WHERE n = 0) AND l_discount = 0)
SELECT symbol, bool_or(p) AS is_protected, bool_or(u) AS is_uncertain FROM (SELECT symbol, p, u FROM u UNION ALL SELECT type, true, false FROM u WHERE p AND type IS NOT NULL) GROUP BY symbol""")
def provider_marks(spark: SparkSession, d: str) -> DataFrame:
    """Data by name along the bases: none, one or several members of the name give different marks."""
    members = _members(spark, d)
    types = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    chain = lambda by: graphs.ancestors(types.select(F.col("k").cast("string").alias("node"), F.when(F.col("k") > 0, F.expr(f"k div {by}").cast("string")).alias("parent")))
    seg = F.col("c_mktsegment")
    bindings = table(spark, d, "customer").select(F.lit("p").alias("project"), F.when(seg == "BUILDING", "nunit").when(seg == "MACHINERY", "mstest").otherwise("xunit").alias("framework"), F.col("c_custkey").cast("string").alias("source_type"), F.when(F.col("c_nationkey") != 3, F.concat(F.lit("m"), 2 * F.col("c_nationkey"))).alias("name"), (F.col("c_acctbal") > 5000).alias("allows_task"), (F.col("c_acctbal") > 8000).alias("allows_async"), F.lit(False).alias("is_open"))
    contracts = table(spark, d, "lineitem").where("l_discount = 0").select(F.col("l_partkey").cast("string").alias("type"), F.concat_ws(":", "l_partkey", "l_orderkey", "l_linenumber").alias("implementation"))
    symbols = members.unionByName(_types(spark, d, members)).distinct()
    return _out(protection.combined([protection.bound_data(bindings, symbols, chain(10), chain(25), contracts)], symbols))
