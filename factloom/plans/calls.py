"""Named queries of the call graph over the driver tables, with their SQL: parts are methods and types,
lines are operations inside them, and the order's customer is the number of what is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls
from ..runtime import table
from .signals import query

_KINDS = ("invocation", "object_creation", "property", "event_add", "event_remove", "method_reference", "binary", "conversion", "unresolved")
_OPERATIONS = """
o AS (SELECT l_partkey AS symbol, l_orderkey * 10 + l_linenumber AS start, o_custkey AS target, CASE WHEN l_tax <> 0 THEN o_custkey END AS setter, l_quantity::INT % 9 AS k,
  CASE l_linenumber WHEN 1 THEN 'assigned' WHEN 2 THEN 'out' WHEN 3 THEN 'ref' WHEN 4 THEN 'compound' END AS place, l_returnflag = 'R' AS quiet, l_discount FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT p_partkey AS symbol, CASE WHEN p_size % 10 = 3 THEN p_partkey - p_partkey % 10 ELSE p_partkey END AS definition, CASE WHEN p_size % 2 = 0 THEN p_name || p_brand || p_size END AS identity,
  p_brand <> 'Brand#1' AND (p_type = 'ECONOMY' OR p_size = 1) AS may, p_size <> 50 AND p_size % 7 <> 1 AS node FROM part),
x AS (SELECT symbol, target, 'Invocation' AS kind, start FROM o WHERE k = 0 UNION ALL SELECT symbol, target, 'ObjectCreation', start FROM o WHERE k = 1
  UNION ALL SELECT symbol, target, 'PropertyGet', start FROM o WHERE k = 2 AND (place IS NULL OR place IN ('ref', 'compound')) UNION ALL SELECT symbol, setter, 'PropertySet', start FROM o WHERE k = 2 AND place IS NOT NULL AND setter IS NOT NULL
  UNION ALL SELECT symbol, target, 'EventAdd', start FROM o WHERE k = 3 UNION ALL SELECT symbol, target, 'EventRemove', start FROM o WHERE k = 4 UNION ALL SELECT symbol, target, 'UserOperator', start FROM o WHERE k = 6 UNION ALL SELECT symbol, target, 'UserConversion', start FROM o WHERE k = 7),
i AS (SELECT identity, min(symbol) AS symbol FROM m WHERE node AND identity IS NOT NULL GROUP BY identity HAVING count(*) = 1),
r AS (SELECT m.symbol AS target, m.definition, CASE WHEN d.node THEN m.definition ELSE i.symbol END AS node, m.may FROM m LEFT JOIN m d ON d.symbol = m.definition LEFT JOIN i ON i.identity = m.identity),
c AS (SELECT x.* FROM x JOIN m ON m.symbol = x.symbol AND m.node)"""


def _place(*names: str) -> Column:
    return F.coalesce(*[F.when(F.col("l_linenumber") == i + 1, name) for i, name in enumerate(names)])


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_quantity").cast("int") % 9 + 1))
    place = _place("assigned", "out", "ref", "compound")
    target = F.col("o_custkey")
    candidates = F.when(F.col("l_discount") < 0.05, F.array(target, target + 1)).otherwise(F.array().cast("array<bigint>"))
    operations = lines.select(F.col("l_partkey").alias("symbol"), kind.alias("kind"), target.alias("target"), target.alias("getter"), F.when(F.col("l_tax") != 0, target).alias("setter"), place.alias("place"), (F.col("l_returnflag") == "R").alias("is_nameof"), (F.col("l_returnflag") != "R").alias("is_call_syntax"), candidates.alias("candidates"), F.lit("a").alias("source_path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("start"))
    no = F.lit(False)
    methods = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.when(F.col("p_size") % 10 == 3, F.col("p_partkey") - F.col("p_partkey") % 10).otherwise(F.col("p_partkey")).alias("definition"), F.when(F.col("p_size") % 2 == 0, F.concat("p_name", "p_brand", F.col("p_size").cast("string"))).alias("identity"), (F.col("p_brand") == "Brand#1").alias("is_sealed"), (F.col("p_type") == "ECONOMY").alias("is_virtual"), no.alias("is_abstract"), no.alias("is_override"), F.when(F.col("p_size") == 1, "interface").otherwise("class").alias("container_kind"))
    nodes = table(spark, d, "part").where("p_size <> 50 and p_size % 7 <> 1").select(F.col("p_partkey").alias("symbol"))
    return calls.call_graph(operations, methods, nodes)


@query(f"WITH {_OPERATIONS} SELECT DISTINCT c.symbol AS a, r.node AS b, c.kind, start FROM c JOIN r ON r.target = c.target WHERE r.node IS NOT NULL")
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0].select("a", "b", "kind", "start")


@query(f"""
WITH {_OPERATIONS},
u AS (SELECT symbol, target, 'MethodGroup' AS kind, false AS is_global, start FROM o WHERE k = 5 AND NOT quiet UNION ALL SELECT symbol, NULL, 'UnresolvedBinding', true, start FROM o WHERE k = 8 AND NOT quiet AND l_discount >= 0.05
  UNION ALL SELECT symbol, target + n, 'UnresolvedBinding', false, start FROM o, (SELECT unnest([0, 1]) AS n) WHERE k = 8 AND NOT quiet AND l_discount < 0.05
  UNION ALL SELECT c.symbol, c.target, 'VirtualOrInterfaceDispatch', true, start FROM c JOIN r ON r.target = c.target WHERE r.may AND c.kind <> 'UserOperator')
SELECT DISTINCT u.symbol AS source, coalesce(r.node, r.definition, u.target) AS node, kind, is_global, start FROM u JOIN m ON m.symbol = u.symbol AND m.node LEFT JOIN r ON r.target = u.target""")
def call_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1].select("source", "node", "kind", "is_global", "start")


@query("""
WITH RECURSIVE t AS (SELECT p_partkey AS type, p_partkey AS base, 0 AS depth FROM part UNION ALL SELECT type, base // 10, depth + 1 FROM t WHERE base > 0),
i AS (SELECT l_partkey AS type, l_linenumber AS slot, min(l_orderkey) AS method FROM lineitem WHERE l_discount >= 0.08 GROUP BY ALL),
c AS (SELECT DISTINCT o_custkey AS receiver, substr(o_orderpriority, 1, 1)::BIGINT AS slot FROM orders WHERE o_orderstatus = 'F'),
n AS (SELECT receiver, c.slot, arg_min(method, depth) AS method FROM c JOIN t ON t.type = receiver JOIN i ON i.type = t.base AND i.slot = c.slot GROUP BY ALL)
SELECT receiver, c.slot, method FROM c JOIN t ON t.base = receiver JOIN i ON i.type = t.type AND i.slot = c.slot UNION SELECT * FROM n""")
def virtual_targets(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "part").select(F.col("p_partkey").alias("type"), F.when(F.col("p_partkey") > 0, F.expr("p_partkey div 10")).alias("base"))
    made = table(spark, d, "lineitem").where("l_discount >= 0.08").groupBy(F.col("l_partkey").alias("type"), F.col("l_linenumber").cast("long").alias("slot")).agg(F.min("l_orderkey").alias("method"))
    sent = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("receiver"), F.substring("o_orderpriority", 1, 1).cast("long").alias("slot"))
    return calls.dispatch_targets(sent, made, types)


@query("""
WITH RECURSIVE t AS (SELECT p_partkey AS type, p_partkey AS base FROM part UNION ALL SELECT type, base // 10 FROM t WHERE base > 0),
s AS (SELECT base AS type, count(*) AS size FROM t GROUP BY base),
o AS (SELECT p_partkey AS type, 1 + coalesce(sum(size) OVER (PARTITION BY CASE WHEN p_partkey > 0 THEN p_partkey // 10 END ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step FROM part JOIN s ON type = p_partkey)
SELECT t.type, sum(step)::BIGINT AS low, (sum(step) + any_value(size))::BIGINT AS high FROM t JOIN o ON o.type = t.base JOIN s ON s.type = t.type GROUP BY t.type""")
def type_intervals(spark: SparkSession, d: str) -> DataFrame:
    return calls.type_intervals(table(spark, d, "part").select(F.col("p_partkey").alias("type"), F.when(F.col("p_partkey") > 0, F.expr("p_partkey div 10")).alias("base")))


@query("""
SELECT CASE WHEN l_linenumber IN (1, 2) THEN false ELSE true END AS reads, l_linenumber <= 4 AS writes, count(*) AS n FROM lineitem GROUP BY ALL""")
def property_access(spark: SparkSession, d: str) -> DataFrame:
    read, write = calls.property_access(_place("assigned", "out", "ref", "increment"))
    return table(spark, d, "lineitem").groupBy(read.alias("reads"), write.alias("writes")).agg(F.count(F.lit(1)).alias("n"))
