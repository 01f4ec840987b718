"""Mixing sources to target weights: fixed-length blocks, drawn source counts per shard, keyed index permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .permute import feistel

#: Words of a block; slots of an output shard; buckets for running totals within a source.
BLOCK, SHARD_SLOTS, BUCKETS, CHUNK = 64, 4096, 256, 1 << 16
#: Nothing is taken more often than this.
MOST = 3
ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Adds target and weight to one row per source (nosrc, src, source_size).

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. Targets share the total by
    weight, stopping at MOST times the source's size; the excess is shared again by weight until
    none is above, which is target = min(MOST * size, level * weight) for one level.
    """
    order = Window.orderBy("nosrc", "src")
    by_ratio = Window.orderBy("ratio", "nosrc", "src")
    t = sizes.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double"))
    t = t.withColumn("cap", MOST * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("total", F.sum(F.col("source_size").cast("double")).over(order.rowsBetween(*ALL)))
    t = t.withColumn("caps", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("total") - F.col("caps")) / F.col("rest"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nosrc", "src", "level"))).over(order.rowsBetween(*ALL))["level"]
    t = t.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))))
    return t.select("nosrc", "src", "source_size", "weight", "target")


def place(df: DataFrame, keys: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with size, source_size, target and start: words of the source before them; sources).

    df has src, size and any others. Starts come from totals of (source, bucket), BUCKETS rows a
    source, so no task holds a whole source.
    """
    named = df.withColumn("nosrc", F.col("src").isNull()).withColumn("src", F.coalesce("src", F.lit("")))
    named = named.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    per = named.groupBy("nosrc", "src", "bucket").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("nosrc", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    per = per.select("nosrc", "src", "bucket", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(w.rowsBetween(*ALL)).alias("source_size"))
    sources = source_targets(per.select("nosrc", "src", "source_size").distinct())
    offsets = per.join(sources.select("nosrc", "src", "target"), ["nosrc", "src"])
    own = Window.partitionBy("nosrc", "src", "bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = named.withColumn("upto", F.sum("size").over(own)).join(offsets, ["nosrc", "src", "bucket"])
    return rows.withColumn("start", F.col("before") + F.col("upto") - F.col("size")).drop("before", "upto", "bucket"), sources


def slots(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """One row per slot of the mix: shard, slot, nosrc, src, index (of the source's block).

    A source gets round(target / its mean block) slots, MOST times its blocks at most. The slots
    of all sources, in order, go through one keyed permutation, and each run of SHARD_SLOTS places
    is a shard: a shard's source counts are then multinomial draws given the totals, so every
    source meets its target exactly instead of within a draw's error. Within its source, slot i
    of pass i div n takes block permutation(i mod n) of that pass.
    """
    s = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    s = s.withColumn("n_slots", F.least(F.lit(MOST) * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).cast("long"))
    order = Window.orderBy("nosrc", "src")
    s = s.withColumn("first", F.sum("n_slots").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_slots"))
    s = s.withColumn("n_all", F.sum("n_slots").over(order.rowsBetween(*ALL))).where("n_slots > 0")
    chunks = s.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_slots - 1) div {CHUNK}"))))
    chunks = chunks.repartition(common.shuffle_parts(sources.sparkSession), "nosrc", "src", "chunk")
    i = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n_slots"), (F.col("chunk") + 1) * CHUNK) - 1))
    rows = chunks.withColumn("i", i)
    key = F.xxhash64(F.lit(seed), F.col("nosrc"), F.col("src"), F.expr("i div blocks"))
    rows = rows.withColumn("index", feistel(F.pmod("i", "blocks"), F.col("blocks"), key))
    rows = rows.withColumn("place", feistel(F.col("first") + F.col("i"), F.col("n_all"), F.lit(seed).cast("long")))
    return rows.select(F.expr(f"place div {SHARD_SLOTS}").alias("shard"), F.pmod("place", F.lit(SHARD_SLOTS)).alias("slot"), "nosrc", "src", "index", F.expr("i div blocks").alias("pass"))


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """rows exploded to the blocks they reach: index, lo (first word within the row) and n words."""
    reach = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    out = rows.withColumn("index", F.explode_outer(reach))
    lo = F.greatest(F.lit(0).cast("long"), F.col("index") * block - F.col("start"))
    hi = F.least(F.col("size"), (F.col("index") + 1) * block - F.col("start"))
    return out.withColumn("lo", lo).withColumn("n", F.coalesce(hi - lo, F.lit(0).cast("long")))


def mix(df: DataFrame, block: int = BLOCK, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, places of every row of df.

    Each source's words, document after document, form blocks of `block` words (the last may be
    shorter); slots name the blocks to take, MOST times at most. A document's places are its parts
    of blocks in the mix: (shard, slot, at, lo, n) for its n words from word lo (from 0), which
    begin at word `at` of the block in that slot of that shard; sorted by these. All rows' places
    together are the whole mix, and taken is the sum of a row's n. Null text has size 0
    and nothing is taken from it; a null source is a source of its own, the last; rows repeated or
    with null ids are rows like others; an empty table gives no rows. All DataFrame functions.
    """
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("src"), F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"))
    rows, sources = place(docs, [F.col("doc_id"), F.col("size")])
    drawn = slots(sources, block, seed).groupBy("nosrc", "src", "index").agg(F.collect_list(F.struct("shard", "slot")).alias("drawn"))
    found = pieces(rows.withColumn("row", F.when(F.col("size") == 0, F.monotonically_increasing_id())), block).join(drawn.hint("merge"), ["nosrc", "src", "index"], "left")
    at = F.greatest(F.lit(0).cast("long"), F.col("start") - F.col("index") * block)
    parts = F.transform("drawn", lambda s: F.struct(s["shard"].alias("shard"), s["slot"].alias("slot"), at.alias("at"), F.col("lo").alias("lo"), F.col("n").alias("n")))
    out = found.groupBy("nosrc", "src", "start", "row", "doc_id", "size", "source_size", "target").agg(F.sort_array(F.flatten(F.collect_list(parts))).alias("places"))
    taken = F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + p["n"])
    return out.select("doc_id", "size", F.col("source_size").cast("long"), "target", taken.alias("taken"), "places")


def mixed_texts(df: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix itself, with the columns of df (doc_id, text, lang, source, n_chars among them).

    A document comes once for each pass that takes any of its blocks, with the words of the blocks
    taken in that pass and the white space before them; what no slot names is left out. A null
    text has no words and is left out; a null source is a source of its own, the last; rows
    repeated, or without ids, are rows like others; an empty table gives no rows; columns of any
    name stay as they are, n_chars is counted again.
    """
    names = df.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"),
        F.col("doc_id").alias("doc_id"),
        F.col("source").isNull().alias("nosrc"),
        F.coalesce("source", F.lit("")).alias("src"),
        F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("size"),
        F.xxhash64("text").alias("mark"),
    ).where("size > 0")
    lean = docs.select("doc_id", F.when(~F.col("nosrc"), F.col("src")).alias("src"), "size", "mark")
    rows, sources = place(lean, [F.col("doc_id"), F.col("size"), F.col("mark")])
    times = slots(sources, block, seed).groupBy("nosrc", "src", "index").agg(F.count(F.lit(1)).cast("int").alias("times"))
    found = pieces(rows, block).join(times.hint("merge"), ["nosrc", "src", "index"])
    taken = found.groupBy("doc_id", "size", "mark", "nosrc", "src", "start").agg(F.max("times").alias("most"), F.sort_array(F.collect_list(F.struct("lo", "n", "times"))).alias("parts"))
    key = ["doc_id", "size", "mark", "nosrc", "src"]
    # Rows that are equal in these are equal in text: which of them gets which place makes no difference.
    taken = taken.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("start")))
    docs = docs.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id"))
    for c in [*key[1:], "rn"]:
        same = same & (F.col(f"d.{c}") == F.col(f"t.{c}"))
    both = docs.alias("d").join(taken.alias("t"), same)
    both = both.select("d.own", "t.parts", F.explode(F.sequence(F.lit(1), F.col("t.most"))).alias("copy"))
    # The words are an argument of the outer transform, so that they are found once, not for each part.
    bits = F.array(F.regexp_extract_all(F.col("own.text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)))
    chosen = F.transform(bits, lambda b: F.array_join(F.flatten(F.transform(F.filter("parts", lambda p: p["times"] >= F.col("copy")), lambda p: F.slice(b, (p["lo"] + 1).cast("int"), p["n"].cast("int")))), ""))
    both = both.select("own", F.get(chosen, F.lit(0)).alias("mixed"))
    new = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return both.select(*[new.get(c, F.col("own")[c]).alias(c) for c in names])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"), seed=10)
