"""Repeated fragments: runs of sibling statements that are equal, or equal but for the names of locals and
parameters, grouped across owners, contained ones suppressed.

A statement is an array of parts (category, text, symbol, type_key): text that is kept as it is
(category null), or a placeholder for a local (L) or a parameter (P) of a type. In a run a
placeholder stands for the distance to where its symbol came before, 0 if it didn't within the
run: runs that differ by names only are the same, and so are the runs inside them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import cut, drop, ship
from .references import among

PARTS = "array<struct<category:string,text:string,symbol:string,type_key:string>>"
#: Runs that a task holds before it hands them on.
HELD = 20_000


def encode(parts: Column) -> Column:
    """An unambiguous join of strings: each as its length, a colon and itself."""
    return F.array_join(F.transform(parts, lambda p: F.concat(F.length(p).cast("string"), F.lit(":"), p)), "")


def numbered_symbols(symbols: Column, mark: str) -> Column:
    """Each symbol as mark and the index of its first occurrence among distinct symbols, from 0."""
    distinct = F.array_distinct(symbols)
    return F.transform(symbols, lambda s: F.concat(F.lit(mark), (F.array_position(distinct, s) - 1).cast("string")))


def normalized(df: DataFrame, columns: list[str], symbols: Column, mark: str) -> DataFrame:
    """columns and form: all symbols of each row as numbered_symbols numbers them, joined by commas; null without any.

    Symbols are rows here, numbered by sorting: numbered_symbols searches the distinct ones for
    each symbol, which takes time with the square of their number.
    """
    rows = df.select(*columns, symbols.alias("_symbols"), F.monotonically_increasing_id().alias("_row"))
    # Equal symbols lie side by side when they are sent, which the compression of shuffle files likes.
    placed = F.when(F.size("_symbols") > 0, F.sort_array(F.arrays_zip(F.col("_symbols").alias("symbol"), F.sequence(F.lit(0), F.size("_symbols") - 1).alias("at"))))
    rows = rows.select(*columns, "_row", F.explode_outer(placed).alias("_s")).select(*columns, "_row", F.col("_s.at").alias("_at"), F.col("_s.symbol").alias("_symbol")).repartition("_row")
    rows = rows.withColumn("_first", F.min("_at").over(Window.partitionBy("_row", "_symbol")))
    rows = rows.withColumn("_number", F.dense_rank().over(Window.partitionBy("_row").orderBy("_first")) - 1)
    numbered = F.array_sort(F.collect_list(F.struct("_at", "_number")))
    form = F.array_join(F.transform(numbered, lambda x: F.concat(F.lit(mark), x["_number"].cast("string"))), ",")
    return rows.groupBy("_row", *columns).agg(F.when(F.count("_at") > 0, form).alias("form")).select(*columns, "form")


def type_keys(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """(type, key): a name for each type that tells apart whatever differs in it, at any depth.

    nodes has type, is_error, annotation (whether null is allowed) and parts, an array of (tag, value,
    child): a plain value, or another type that is nested there. A type that is unknown, or holds
    one that is, has no key (null).
    """
    keyed = lambda parts: F.array_join(F.transform(parts, lambda p: encode(F.array(p["tag"], p["value"]))), "")
    rows = nodes.select("type", "is_error", F.coalesce("annotation", F.lit("0")).alias("annotation"), F.coalesce("parts", F.array().cast("array<struct<tag:string,value:string,child:string>>")).alias("parts")).dropDuplicates(["type"])
    plain = F.forall("parts", lambda p: p["child"].isNull())
    key = F.when(~F.col("is_error"), F.concat(encode(F.array(F.lit("A"), F.col("annotation"))), keyed(F.col("parts"))))
    done, open_ = cut(rows.where(plain).select("type", key.alias("key"))), cut(rows.where(~plain))
    for _ in range(max_depth):
        if open_.isEmpty():
            return done
        children = open_.select("type", F.posexplode("parts").alias("at", "p")).join(done.select(F.col("type").alias("child"), "key", F.lit(True).alias("there")), F.col("p.child") == F.col("child"), "left")
        known = children.groupBy("type").agg(
            F.bool_and(F.col("p.child").isNull() | F.coalesce("there", F.lit(False))).alias("whole"), F.bool_or(F.col("there") & F.col("key").isNull()).alias("bad"),
            F.array_sort(F.collect_list(F.struct("at", F.col("p.tag").alias("tag"), F.coalesce("key", "p.value").alias("value")))).alias("given"),
        ).where("whole")
        made = open_.join(known, "type").withColumn("is_error", F.col("is_error") | F.coalesce("bad", F.lit(False))).select("type", "is_error", "annotation", F.col("given").alias("parts"))
        made = cut(made.select("type", key.alias("key")))
        if made.isEmpty():
            raise ValueError("types nest in a circle, or one of them is missing")
        done, open_ = cut(done.unionByName(made)), cut(open_.join(made, "type", "left_anti"))
    raise ValueError("types nest too deeply")


def barred(statements: DataFrame) -> DataFrame:
    """statements, eligible only without a nested function, without an unresolved, ambiguous or dynamic
    binding, and without a placeholder whose type is unknown."""
    typed = F.forall(F.coalesce("parts", F.array().cast(PARTS)), lambda p: p["category"].isNull() | p["type_key"].isNotNull())
    no = F.lit(False)
    return statements.withColumn("eligible", F.coalesce("eligible", no) & ~F.coalesce("nested_executable", no) & ~F.coalesce("binding_barrier", no) & typed)


def _lists(statements: DataFrame, key: list[str]) -> DataFrame:
    """One row for each list of statements, in order; a form alone counts as one part.

    A part goes to tasks as what a digest takes of it: kept text, or what follows a placeholder's distance.
    """
    none = F.lit(None).cast("string")
    text = F.col("form") if "form" in statements.columns else none
    form = F.array(F.struct(none.alias("category"), text.alias("text"), none.alias("symbol"), none.alias("type_key")))
    parts = F.coalesce("parts", form) if "parts" in statements.columns else form
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    taken = F.transform(parts, lambda p: F.struct(p["category"].alias("category"), F.when(p["category"].isNull(), sized(p["text"])).otherwise(F.concat(F.lit(":"), sized(p["type_key"]))).alias("form"), F.when(p["category"].isNotNull(), p["symbol"]).alias("symbol")))
    rows = statements.select(*key, F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.col("tokens").cast("long").alias("tokens"), "eligible", taken.alias("parts")).alias("s"))
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list("s")).alias("s"))


class _List:
    """A list's statements: what is kept of each lies between its placeholders, each with where it is and where its symbol came before."""

    def __init__(self, ends: list[int], category: list, form: list, symbol: list, open_: list[bool]):
        self.ends, self.kept, self.holes, last = ends, [], [], {}
        for j, (lo, hi) in enumerate(zip(ends, ends[1:])):
            kept, holes, at = [], [], lo
            for k in [k for k in range(lo, hi) if category[k] is not None]:
                if open_[j]:
                    kept.append("".join(form[at:k]) + category[k])
                    holes.append((k, last.get(symbol[k], -1), form[k]))
                last[symbol[k]], at = k, k + 1
            self.kept.append(kept + ["".join(form[at:hi])] if open_[j] else [])
            self.holes.append(holes)
        # The form of each statement as it was made last, and the furthest start for which it still holds.
        self.made, self.holds = [b""] * len(open_), [-1] * len(open_)

    def form(self, j: int, start: int) -> bytes:
        """Statement j in a run from start (a part); starts never go down. It changes only when a start passes one of the places it goes back to."""
        if start > self.holds[j]:
            kept, holes = self.kept[j], self.holes[j]
            self.made[j] = "".join([*[f"{t}{k - b if b >= start else 0}{tail}" for t, (k, b, tail) in zip(kept, holes)], kept[-1]]).encode()
            self.holds[j] = min([b for _, b, _ in holes if b >= start], default=self.ends[-1])
        return self.made[j]


def _digests(ordinal: list[int], tokens: list[int], open_: list[bool], parts: _List, least: int, least_tokens: int, most: int | None) -> Iterator[tuple[int, int, int, bytes]]:
    """(first, last, tokens, digest) of the runs of a list: a start's digest goes on from statement to statement."""
    n = len(ordinal)
    for i in range(n):
        digest, total = hashlib.sha256(), 0
        for j in range(i, n if most is None else min(n, i + most)):
            if not open_[j] or ordinal[j] - ordinal[i] != j - i:
                break
            digest.update(parts.form(j, parts.ends[i]))
            total += tokens[j]
            if j - i + 1 >= least and total >= least_tokens:
                yield ordinal[i], ordinal[j], total, digest.digest()


def _batches(batches: Iterator[pa.RecordBatch], key: list[str], least: int, least_tokens: int, most: int | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, rows, at = b.select(key), [], []

        def out() -> pa.RecordBatch:
            own = keys.take(pa.array(at, pa.int32()))  # noqa: B023
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]  # noqa: B023
            return pa.RecordBatch.from_arrays([*own.columns, *columns], names=[*key, "first", "last", "tokens", "digest"])

        lists = b["s"]
        s, offsets = lists.values, lists.offsets.to_pylist()
        ordinals, tokens, eligible, parts = (s.field(c) for c in ("ordinal", "tokens", "eligible", "parts"))
        category, form, symbol = (parts.values.field(c) for c in ("category", "form", "symbol"))
        starts = b["starts"].to_pylist() if "starts" in b.schema.names else None
        for i, (lo, hi) in enumerate(zip(offsets, offsets[1:])):
            own = lambda c, lo=lo, n=hi - lo: c.slice(lo, n).to_pylist()
            ordinal, open_ = own(ordinals), [bool(x) for x in own(eligible)]
            if starts is not None:
                inside = {f + k for f in starts[i] for k in range(least)}
                open_ = [x and o in inside for x, o in zip(open_, ordinal)]
            if sum(open_) < least:
                continue
            ends = parts.offsets.slice(lo, hi - lo + 1).to_pylist()
            of = lambda c, lo=ends[0], n=ends[-1] - ends[0]: c.slice(lo, n).to_pylist()
            whole = _List([e - ends[0] for e in ends], of(category), of(form), of(symbol), open_)
            for run in _digests(ordinal, own(tokens), open_, whole, least, least_tokens, most):
                rows.append(run)
                at.append(i)
                if len(rows) >= HELD:
                    yield out()
                    rows.clear(), at.clear()
        if rows:
            yield out()


def _runs(lists: DataFrame, key: list[str], least: int, least_tokens: int, most: int | None) -> DataFrame:
    schema = StructType([lists.schema[k] for k in key]).add("first", "long").add("last", "long").add("tokens", "long").add("digest", "binary")
    return lists.mapInArrow(partial(_batches, key=key, least=least, least_tokens=least_tokens, most=most), schema)


def _named(runs: DataFrame, key: list[str]) -> DataFrame:
    """runs with group, the digest in hex; digests themselves are half as long and what is dealt."""
    return runs.select(*key, "first", "last", "tokens", F.lower(F.hex("digest")).alias("group"))


def windows(statements: DataFrame, owner: list[str], least: int, least_tokens: int, most: int | None = None) -> DataFrame:
    """Every run of eligible neighbours with least statements and least_tokens tokens or more.

    statements has owner columns, list_id, ordinal, tokens, eligible, and form or parts. Lists fall
    apart at ineligible statements; a run is (owner..., list_id, first, last, tokens, group), group
    being a digest of its parts. Runs are handed on as they are made: memory goes with the list.
    """
    key = [*owner, "list_id"]
    ship(statements.sparkSession)
    return _named(_runs(_lists(statements, key), key, least, least_tokens, most), key)


def shared_only(statements: DataFrame, owner: list[str], least: int = 3) -> DataFrame:
    """statements, eligible only inside a run of least statements that two owners or more have.

    A longer run that two owners have consists of such runs, so no group is lost, and longer ones
    are made where there may be some instead of everywhere.
    """
    key = [*owner, "list_id"]
    small = cut(windows(statements, owner, least, 0, least))
    who = F.struct(*owner)
    many = small.groupBy("group").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo <> hi")
    inside = small.join(many.select("group"), "group", "left_semi").select(*key, F.explode(F.sequence("first", "last")).alias("ordinal")).distinct()
    marked = statements.withColumn("ordinal", F.col("ordinal").cast("long")).join(inside.withColumn("_shared", F.lit(True)), [*key, "ordinal"], "left")
    return marked.withColumn("eligible", F.col("eligible") & F.coalesce("_shared", F.lit(False))).select(*statements.columns)


def shared_windows(statements: DataFrame, owner: list[str], least: int, least_tokens: int) -> DataFrame:
    """windows of the statements that lie inside a run of least statements that two owners or more have.

    A longer run that two owners have consists of such runs, so no group is lost, and longer ones
    are made where there may be some instead of everywhere. Lists, short runs and the runs given are
    kept as checkpoints: each is made once.
    """
    key = [*owner, "list_id"]
    ship(statements.sparkSession)
    lists = cut(_lists(statements, key))
    # Eight bytes of a digest will do here: runs that only these make equal are told apart by the whole digest later.
    short = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("short")
    small = cut(_runs(lists, key, least, 0, least).select(*key, "first", short))
    who = F.struct(*owner)
    many = small.groupBy("short").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo <> hi")
    starts = cut(small.join(many.select("short"), "short", "left_semi").groupBy(*key).agg(F.collect_set("first").alias("starts")))
    l, r = among(lists, starts, key).alias("l"), starts.alias("r")
    same = reduce(Column.__and__, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key])
    runs = cut(_runs(l.join(r, same).select("l.*", "r.starts"), key, least, least_tokens, None))
    drop(small), drop(lists), drop(starts)
    return _named(runs, key)


def groups(runs: DataFrame, owner: list[str], once: bool = False) -> DataFrame:
    """runs whose group two owners or more have, with owners and occurrences; group is a digest in hex.

    once tells that no run is there twice, as with those of shared_windows of two statements or more.
    """
    digest = F.unhex("group").alias("digest")
    names = [c for c in runs.columns if c != "group"]
    marked = (runs if once else runs.dropDuplicates([*owner, "list_id", "first", "last"])).select(*names, digest)
    owned = marked.groupBy("digest", *owner).agg(F.count(F.lit(1)).alias("n"))
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in owner])
    shared = owned.groupBy("digest").agg(F.count(F.when(known, 1)).alias("owners"), F.sum("n").alias("occurrences")).where("owners > 1")
    return marked.join(shared, "digest").select(F.lower(F.hex("digest")).alias("group"), *names, "owners", "occurrences")


def maximal(grouped: DataFrame, owner: list[str]) -> DataFrame:
    """Groups not contained in a larger one: suppressed is a group each of whose occurrences lies
    within an occurrence of one and the same group with more statements.

    Most are found by their neighbours: if each occurrence, longer by the statement before or the
    one after, is of one and the same group, all lie within that group. Only a group that comes
    twice or more in one list can lie in a larger one otherwise; occurrences of such groups alone
    are compared with the runs around them. Neighbours are met in windows, in which a run is dealt
    once, and known by 64-bit hashes; what is kept is looked up by a bitmap before it is dealt.
    """
    key = [*owner, "list_id"]
    names = [c for c in grouped.columns if c != "group"]
    dealt = grouped.select(*names, F.unhex("group").alias("digest")).repartition(*key)
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in key])
    up, on = Window.partitionBy(*key, "last").orderBy("first"), Window.partitionBy(*key, "first").orderBy("last")
    before = F.when(whole & (F.lag("first").over(up) == F.col("first") - 1), F.xxhash64(F.lag("digest").over(up)))
    after = F.when(whole & (F.lead("last").over(on) == F.col("last") + 1), F.xxhash64(F.lead("digest").over(on)))
    g = cut(dealt.withColumns({"_before": before}).withColumns({"_after": after}))
    sides = [f(c).alias(f"{n}{c}") for c in ("_before", "_after") for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    merged = [f(f"{n}{c}").alias(f"{n}{c}") for c in ("_before", "_after") for n, f in (("lo", F.min), ("hi", F.max), ("n", F.sum))]
    facts = g.groupBy("digest", *key).agg(F.first("occurrences").alias("occurrences"), F.count(F.lit(1)).alias("n"), *sides)
    facts = facts.groupBy("digest").agg(F.first("occurrences").alias("occurrences"), (F.max("n") > 1).alias("twice"), *merged)
    one = lambda c: F.coalesce((F.col(f"lo{c}") == F.col(f"hi{c}")) & (F.col(f"n{c}") == F.col("occurrences")), F.lit(False))
    facts = cut(facts.select("digest", "twice", (one("_before") | one("_after")).alias("gone")))
    # A group longer by a statement may follow some occurrences and precede others, in a list of equal statements.
    twice = facts.where("not gone and twice").select("digest")
    longer = among(g, twice, ["digest"]).select("digest", "occurrences", F.explode(F.array_distinct(F.array_compact(F.array("_before", "_after")))).alias("longer"))
    covered = longer.groupBy("digest", "longer", "occurrences").agg(F.count(F.lit(1)).alias("n")).where("n = occurrences").select("digest")
    open_ = cut(twice.join(covered, "digest", "left_anti"))
    sized = g.select(*key, "digest", "first", "last", "occurrences", (F.col("last") - F.col("first") + 1).alias("length"))
    small = cut(among(sized, open_, ["digest"]).join(open_, "digest").select(*key, F.col("digest").alias("inner"), F.col("first").alias("f"), F.col("last").alias("l"), F.col("length").alias("n"), F.col("occurrences").alias("needed")))
    inside = small.join(among(sized, small, key).drop("occurrences"), key).where("f >= first and l <= last and n < length")
    covered = covered.unionByName(inside.groupBy("inner", "digest", "needed").agg(F.count_distinct(*[F.col(c) for c in key], F.col("f"), F.col("l")).alias("covered")).where("covered = needed").select(F.col("inner").alias("digest")))
    kept = cut(facts.where("not gone").select("digest").join(covered, "digest", "left_anti"))
    out = among(g, kept, ["digest"]).join(kept, "digest")
    return out.select(F.lower(F.hex("digest")).alias("group"), *names).select(*grouped.columns)
