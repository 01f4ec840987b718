"""Named query of markup uses over the driver tables, with its SQL: each customer is a XAML file, parts are
types, lines are their events and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markup, protection
from ..runtime import table
from .signals import query


@query("""
WITH m AS (SELECT DISTINCT l_partkey || ':' || l_orderkey || ':' || l_linenumber AS symbol, l_partkey AS type, l_linenumber = 7 AS event, CASE WHEN l_linenumber = 7 THEN 'E' || l_quantity::INT % 3 ELSE 'M' || l_quantity::INT END AS name FROM lineitem),
c AS (SELECT c_custkey, 'M' || c_nationkey AS handler, CASE WHEN c_nationkey % 5 = c_custkey % 5 THEN a.p_partkey END AS element, CASE WHEN c_nationkey % 5 = c_custkey % 5 THEN b.p_partkey END AS behind, b.p_partkey AS meant
  FROM customer LEFT JOIN part a ON a.p_partkey = c_custkey LEFT JOIN part b ON b.p_partkey = c_custkey + 5),
h AS (SELECT DISTINCT behind, handler FROM c WHERE element IN (SELECT type FROM m WHERE event AND name = 'E1') AND behind IS NOT NULL),
n AS (SELECT behind, handler, count(symbol) AS n FROM h LEFT JOIN m ON m.type = behind AND m.name = handler AND NOT event GROUP BY ALL),
u AS (SELECT element::VARCHAR AS symbol, NULL AS type, true AS p, false AS u FROM c WHERE element IS NOT NULL UNION ALL SELECT behind::VARCHAR, NULL, true, false FROM c WHERE behind IS NOT NULL
  UNION ALL SELECT meant::VARCHAR, NULL, false, true FROM c WHERE behind IS NULL AND meant IS NOT NULL
  UNION ALL SELECT symbol, type::VARCHAR, n = 1, n > 1 FROM n JOIN m ON m.type = behind AND m.name = handler AND NOT event
  UNION ALL SELECT symbol, NULL, false, true FROM m WHERE NOT event AND name IN (SELECT handler FROM n WHERE n = 0))
SELECT symbol, bool_or(p) AS is_protected, bool_or(u) AS is_uncertain FROM (SELECT symbol, p, u FROM u UNION ALL SELECT type, true, false FROM u WHERE p AND type IS NOT NULL) GROUP BY symbol""")
def xaml_marks(spark: SparkSession, d: str) -> DataFrame:
    """Code behind, element types and event handlers of XAML files; a handler's name has no, one or several methods."""
    space = F.concat(F.lit('" xmlns:v="clr-namespace:N'), F.col("c_nationkey") % 5)
    text = F.concat(F.lit('<Window xmlns="w" xmlns:x="x'), space, F.lit('" x:Class="N'), F.col("c_nationkey") % 5, F.lit(".T"), F.col("c_custkey") + 5, F.lit('"><Grid><v:T'), "c_custkey", F.lit(' E1="M'), "c_nationkey", F.lit('"/></Grid></Window>'))
    files = table(spark, d, "customer").select(F.concat(F.lit("p/"), "c_custkey", F.lit(".xaml")).alias("file_path"), text.alias("text"), F.lit("p").alias("project"))
    none, event = F.lit(None).cast("string"), F.col("l_linenumber") == 7
    quantity = F.col("l_quantity").cast("int")
    members = table(spark, d, "lineitem").select(F.concat_ws(":", "l_partkey", "l_orderkey", "l_linenumber").alias("symbol"), F.when(event, "event").otherwise("method").alias("symbol_kind"), F.when(event, F.concat(F.lit("E"), quantity % 3)).otherwise(F.concat(F.lit("M"), quantity)).alias("name"), F.col("l_partkey").cast("string").alias("type"), none.alias("full_name"))
    types = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.lit("type").alias("symbol_kind"), F.concat(F.lit("T"), "p_partkey").alias("name"), none.alias("type"), F.concat(F.lit("N"), F.col("p_partkey") % 5, F.lit(".T"), "p_partkey").alias("full_name"))
    symbols = members.unionByName(types).select("*", F.lit("p").alias("project"), F.lit(True).alias("is_source"), none.alias("value_type"))
    areas = files.select(F.col("project").alias("origin"), "project").distinct()
    marks = protection.combined([markup.xaml_marks(files, symbols, areas)], symbols)
    return marks.select("symbol", "is_protected", "is_uncertain")
