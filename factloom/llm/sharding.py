"""Reproducible shuffle into shards: Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .permute import feistel

#: Buckets for row numbers; the table of their sizes has this many rows whatever the input has.
BUCKETS = 4096


def row_numbers(df: DataFrame, keys: list[Column], n_buckets: int = BUCKETS) -> DataFrame:
    """Adds row_number (from 0, gapless) and n_rows, reproducibly for the same rows.

    Rows are dealt to buckets by a hash of keys and numbered within them in the order of keys;
    the buckets' sizes, n_buckets rows at most, give each bucket's first number. No row meets all
    others in one task. Rows equal in keys may swap numbers, which the keys can't tell.
    """
    own = [c for c in df.columns]
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"))
    named = named.withColumn("bucket", F.pmod(F.xxhash64(*[F.col(f"key.k{i}") for i in range(len(keys))]), F.lit(n_buckets)).cast("int"))
    sizes = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("bucket")
    sizes = sizes.select("bucket", (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"))
    numbered = named.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy("key")))
    joined = numbered.join(F.broadcast(sizes), "bucket")
    return joined.select(*[F.col("row")[c].alias(c) for c in own], (F.col("before") + F.col("rn") - 1).alias("row_number"), "n_rows")


def shard(df: DataFrame, n_shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of df.

    Row r of n goes to position p = feistel(r), which is shard p mod n_shards and slot
    p div n_shards: counts of shards differ by one at most, slots are gapless from 0, and anyone
    who knows (n, seed) can compute where a row number lies. Null text counts as empty (size 16,
    crc 0); a null id is a value like others; repeated rows each get a place of their own; an
    empty table gives no rows. All DataFrame functions.
    """
    docs = common.ensure_text(df, id_col, text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    lean = docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = row_numbers(lean, [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    placed = placed.withColumn("place", feistel(F.col("row_number"), F.col("n_rows"), F.lit(seed).cast("long")))
    return placed.select("doc_id", "size", "text_crc32", F.pmod(F.col("place"), F.lit(n_shards)).cast("int").alias("shard"), F.expr(f"place div {n_shards}").cast("long").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(common.table(spark, sf_dir, "documents"), 40, seed=9)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
