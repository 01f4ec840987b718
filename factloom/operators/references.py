"""Unreferenced declarations with protected and uncertain sets; name matches; owners of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Bits of a filter: 2**19 rows of 64 bits are broadcast at most.
FILTER_BITS = 1 << 25
#: Keys that are broadcast whole, at most.
FEW_KEYS = 10_000


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows without most of those whose columns on aren't among keys; the exact join follows.

    A bit stands for all keys of a hash, so more keys only let more rows through.
    """
    bit = F.xxhash64(*[F.col(c).cast("string") for c in on]).bitwiseAND(F.lit(FILTER_BITS - 1))
    at = keys.select(F.shiftright(bit, 6).alias("_at"), (bit % 64).cast("int").alias("_bit"))
    bits = at.groupBy("_at").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    marked = rows.withColumn("_at", F.shiftright(bit, 6)).join(F.broadcast(bits), "_at")
    return marked.where(F.getbit("_bits", (bit % 64).cast("int")) == 1).select(*rows.columns)


def marked(rows: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """rows with a column that is true wherever their columns on are among keys, and by chance for some others; see among."""
    bit = F.xxhash64(*[F.col(c).cast("string") for c in on]).bitwiseAND(F.lit(FILTER_BITS - 1))
    at = keys.select(F.shiftright(bit, 6).alias("_at"), (bit % 64).cast("int").alias("_bit"))
    bits = at.groupBy("_at").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    found = rows.withColumn("_at", F.shiftright(bit, 6)).join(F.broadcast(bits), "_at", "left")
    return found.select(*rows.columns, F.coalesce(F.getbit("_bits", (bit % 64).cast("int")) == 1, F.lit(False)).alias(name))


def meeting(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose columns on are among keys; a key that very many rows have is no group of a task where keys are few."""
    keys = cut(keys.select(*on).distinct())
    if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        return rows.join(F.broadcast(keys), on, "left_semi")
    # No semi join: Spark would move it before the filter, which would then see dealt rows.
    return among(rows, keys, on).join(keys, on).select(*rows.columns)


def unreferenced(candidates: DataFrame, references: DataFrame, protected: DataFrame, uncertain: DataFrame) -> DataFrame:
    """candidates (symbol, ...) that no reference (symbol, is_self) but their own names, and that
    are neither protected nor uncertain (symbol)."""
    used = references.where(~F.col("is_self")).select("symbol")
    return candidates.join(used, "symbol", "left_anti").join(protected.select("symbol"), "symbol", "left_anti").join(uncertain.select("symbol"), "symbol", "left_anti")


def without_reported_parents(members: DataFrame, reported: DataFrame, parent: list[str]) -> DataFrame:
    """members whose parent isn't reported itself."""
    return members.join(reported.select(*parent).distinct(), parent, "left_anti")


def fan_out(references: DataFrame, containing: DataFrame) -> DataFrame:
    """Each reference (symbol, kind, place) for its symbol, and for the type that contains it (symbol, type)."""
    by_type = references.join(containing, "symbol").select(F.col("type").alias("symbol"), F.lit("ContainingType").alias("kind"), "place")
    return references.select("symbol", "kind", "place").unionByName(by_type)


def with_parents(symbols: DataFrame, containing: DataFrame) -> DataFrame:
    """symbols (symbol) and the types that contain them."""
    return symbols.select("symbol").unionByName(symbols.join(containing, "symbol").select(F.col("type").alias("symbol"))).distinct()


def match_names(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """(symbol, state) from uses (name) of declared names (name, symbol).

    One match is protected, several make each of them uncertain; a use without a match says
    nothing. A symbol that any use protects is protected, uses that leave it uncertain aside.
    Declarations that no use can mean are left out before they are dealt, and a symbol's state
    needs no join: the one symbol of a name is known from its group, all others are uncertain.
    """
    wanted = cut(uses.select("name").distinct())
    d = among(declared.select("name", "symbol"), wanted, ["name"]).distinct().join(wanted, "name", "left_semi")
    one = d.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("symbol")).where("n = 1").select("symbol", F.lit(True).alias("one"))
    every = one.unionByName(d.select("symbol").distinct().select("symbol", F.lit(False).alias("one")))
    return every.groupBy("symbol").agg(F.when(F.bool_or("one"), "protected").otherwise("uncertain").alias("state"))


def match_members(uses: DataFrame, members: DataFrame) -> DataFrame:
    """(symbol, state) from uses (owner, name) of members (owner, name, symbol, is_method) of types.

    One member of that name in the owner is protected, several are uncertain. Where the owner has
    none, or the use names no single owner (null), every method of that name anywhere is
    uncertain; a use without a name (an expression) makes all methods of its owner uncertain. A
    symbol that any use protects is protected.
    """
    m, u = members.distinct(), uses.select("owner", "name").distinct()
    named = u.where("owner is not null and name is not null")
    n = m.groupBy("owner", "name").agg(F.count(F.lit(1)).alias("n"))
    found = named.join(n, ["owner", "name"])
    own = m.join(found, ["owner", "name"]).select("symbol", F.when(F.col("n") == 1, "protected").otherwise("uncertain").alias("state"))
    astray = named.join(n, ["owner", "name"], "left_anti").select("name").unionByName(u.where("owner is null and name is not null").select("name")).distinct()
    far = m.where("is_method").join(astray, "name", "left_semi").select("symbol", F.lit("uncertain").alias("state"))
    whole = m.where("is_method").join(u.where("owner is not null and name is null").select("owner").distinct(), "owner", "left_semi").select("symbol", F.lit("uncertain").alias("state"))
    return own.unionByName(far).unionByName(whole).groupBy("symbol").agg(F.min("state").alias("state"))


def owner_by_longest_prefix(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, owner) by the longest directory of the path that an owner (dir, owner) has.

    A path is exploded to its directories, so the match is an equality join and no theta join.
    """
    parts = F.split("path", "/", -1)
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    rows = paths.select("path", F.posexplode(dirs).alias("depth", "dir")).join(owners, "dir")
    return rows.groupBy("path").agg(F.max_by("owner", "depth").alias("owner"), F.max_by("dir", "depth").alias("dir"))


def unique_on(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs once: an identity that several rows share is none.

    Counts meet before rows do, so a key that very many rows share is no group of a task. Rows
    without a key (null) are no identity.
    """
    once = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return df.join(once, key, "left_semi")


def with_attributes(declarations: DataFrame, wanted: list[str]) -> DataFrame:
    """declarations that carry one of the attributes wanted, by full name."""
    return declarations.where(F.arrays_overlap("attributes", F.array(*map(F.lit, wanted))))


def active_test(attributes_col: str, test: list[str], skip: list[str]) -> Column:
    """Whether a declaration is an active test: an attribute of test and none of skip."""
    own = F.col(attributes_col)
    return F.arrays_overlap(own, F.array(*map(F.lit, test))) & ~F.arrays_overlap(own, F.array(*map(F.lit, skip)))
