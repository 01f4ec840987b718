"""Prefix trie of conversations: shared beginnings as nodes, totals of subtrees by leaf peeling.

A node is a distinct sequence of first turns. It is known by 128 bits: the exclusive or of hashes
of (place, role, text) of its turns, so that a prefix is a running aggregate. Beginnings that the
same conversations share form one link of the trie; links are peeled from the leaves: a link holds
the number of its children that are still open, a finished one sends its totals to its parent, and
chains of links with one open child shorten by half each round, so that rounds grow with the
logarithm of the trie's depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 200
_NODE = ["depth", "d1", "d2"]


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, block, depth, key, size) of turns (conv_id, turn, role, text): depth from 1 within a conversation.

    Order: by turn, null first, and by key among equal turns; key is the MD5 of role and text, null
    ones counting as empty; equal rows are turns of their own. Rows without conv_id are no
    conversation. size is the code points of the text. A block is a part of the rows sorted by
    conversation and turn, so a conversation of any length is numbered in pieces.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    lean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"), F.length(text).cast("long").alias("size"))
    placed = lean.where("conv_id is not null").repartitionByRange("conv_id", "turn", "key").withColumn("block", F.spark_partition_id())
    placed = common.cut(placed)
    before = placed.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("conv_id", "block", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "key"))
    return placed.withColumn("at", at).join(before, ["conv_id", "block"]).select("conv_id", "block", (F.col("before") + F.col("at")).alias("depth"), "key", "size")


def rebuilt(sequences: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(sequences, ids): conversation c begins with the first h turns of c - c % every, h = crc32(c) % heads.

    Its own turns after the first h follow. All turns are taken if there are fewer, none if that
    conversation doesn't exist; ids (conv_id) holds the conversations that are left without turns too.
    """
    conv = F.col("conv_id")
    h = (F.crc32(conv.cast("string").cast("binary")) % heads).alias("h")
    first = sequences.where((conv % every == 0) & (F.col("depth") < heads)).select(conv.alias("base"), "depth", "key", "size")
    lengths = first.groupBy("base").agg(F.max("depth").alias("most"))
    blocks = sequences.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    ids = blocks.select("conv_id").distinct().select("conv_id", (conv - conv % every).alias("base"), h)
    ids = common.cut(ids.join(lengths, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("most", F.lit(0))).alias("taken")))
    shift = blocks.join(ids.select("conv_id", "h", "taken"), "conv_id")
    own = sequences.join(shift, ["conv_id", "block"]).where("depth > h").select("conv_id", "block", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "key", "size")
    head = ids.where("taken > 0").join(first, "base").where("depth <= taken").select("conv_id", F.lit(-1).alias("block"), "depth", "key", "size")
    return own.unionByName(head), ids.select("conv_id")


def _xor(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.bitwiseXOR(b)


def prefixes(sequences: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, ends): the node of every conversation at every depth from 1, and at its end.

    steps has conv_id, the node (depth, d1, d2), its parent's p1 and p2, the turn's size and the
    sum of sizes so far; ends has conv_id and the node, the root's for one without turns.
    """
    z = sequences.withColumn("z1", F.xxhash64(F.lit(1), "depth", "key")).withColumn("z2", F.xxhash64(F.lit(2), "depth", "key"))
    own = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    blocks = z.groupBy("conv_id", "block").agg(F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"), F.sum("size").alias("sum"), F.max("depth").alias("last"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = blocks.select("conv_id", "block", *[F.coalesce(f(c).over(before), zero).alias(n) for f, c, n in ((F.bit_xor, "x1", "c1"), (F.bit_xor, "x2", "c2"), (F.sum, "sum", "c3"))])
    run = z.select("conv_id", "block", "depth", "size", "z1", "z2", F.bit_xor("z1").over(own).alias("r1"), F.bit_xor("z2").over(own).alias("r2"), F.sum("size").over(own).alias("r3"))
    steps = run.join(carried, ["conv_id", "block"]).select("conv_id", "depth", _xor("r1", "c1").alias("d1"), _xor("r2", "c2").alias("d2"), "z1", "z2", "size", (F.col("r3") + F.col("c3")).alias("total"))
    steps = steps.select("conv_id", *_NODE, _xor("d1", "z1").alias("p1"), _xor("d2", "z2").alias("p2"), "size", "total")
    ends = blocks.groupBy("conv_id").agg(F.max("last").alias("depth"), F.bit_xor("x1").alias("d1"), F.bit_xor("x2").alias("d2"))
    ends = ids.join(ends, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in _NODE])
    return steps, ends


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one node, in order: a row for each, its ids comma-joined."""
    for b in batches:
        if not b.num_rows:
            continue
        node = np.stack([b.column(c).to_numpy() for c in _NODE])
        ids = b.column("conv_id").to_numpy()
        at = np.concatenate([[0], np.flatnonzero((node[:, 1:] != node[:, :-1]).any(axis=0)) + 1, [len(ids)]])
        joined = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*[pa.array(v[at[:-1]]) for v in node], pa.array(ids[at[:-1]]), pa.array(joined, pa.string())], [*_NODE, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node; its parts come one after another."""
    now, digest = None, None
    for b in batches:
        out = []
        for *node, ids in zip(*[b.column(c).to_pylist() for c in (*_NODE, "ids")], strict=True):
            if node != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*_NODE, "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, digest.hexdigest())], [*_NODE, "ends_sha256"])


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(depth, d1, d2, ends_sha256) of ends (conv_id, depth, d1, d2).

    Ids are sorted in parts that may split a node's; each part's ids become a few rows of text,
    and only these meet in one task, which reads them one at a time.
    """
    parts = ends.select(*_NODE, "conv_id").repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    lists = parts.mapInArrow(_listed, "depth long, d1 long, d2 long, first long, ids string")
    return lists.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_hashed, "depth long, d1 long, d2 long, ends_sha256 string")


def peel(links: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(c, n, leaves, saved): totals over each link's subtree. links has its id (c, n), its parent's
    (pc, pn; null at the root), its own leaves and saved, the number of its children and the
    exclusive or of their ids (xc, xn), which is the last open child's once the others are taken away.
    """
    one = F.col("open") == 1
    kept = ["c", "n", "pc", "pn", "open", "xc", "xn", "leaves", "saved", "next_c", "next_n", "sum_leaves", "sum_saved", "done"]
    state = links.withColumnRenamed("children", "open").withColumn("done", F.col("open") == 0)
    state = state.withColumns({"next_c": F.when(one, F.col("xc")), "next_n": F.when(one, F.col("xn")), "sum_leaves": F.col("leaves"), "sum_saved": F.col("saved")})
    state = common.cut(state.select(*kept))
    finished = []
    for _ in range(max_rounds):
        new, rest = state.where("done").select("c", "n", "pc", "pn", "leaves", "saved"), state.where("not done")
        finished.append(new.select("c", "n", "leaves", "saved"))
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, finished)
        # A chain's link goes on where the one it points at points to.
        far = rest.where("next_c is not null").select(F.col("c").alias("next_c"), F.col("n").alias("next_n"), F.col("next_c").alias("far_c"), F.col("next_n").alias("far_n"), F.col("sum_leaves").alias("far_leaves"), F.col("sum_saved").alias("far_saved"))
        a = rest.drop("done").join(far, ["next_c", "next_n"], "left")
        a = a.withColumns({"next_c": F.coalesce("far_c", "next_c"), "next_n": F.coalesce("far_n", "next_n"), **{f"sum_{v}": F.col(f"sum_{v}") + F.coalesce(f"far_{v}", F.lit(0)) for v in ("leaves", "saved")}})
        ended = new.select(F.col("c").alias("next_c"), F.col("n").alias("next_n"), F.col("leaves").alias("end_leaves"), F.col("saved").alias("end_saved"))
        told = new.where("pc is not null").groupBy(F.col("pc").alias("c"), F.col("pn").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.bit_xor("c").alias("got_c"), F.bit_xor("n").alias("got_n"), F.sum("leaves").alias("got_leaves"), F.sum("saved").alias("got_saved"))
        a = a.join(ended, ["next_c", "next_n"], "left").join(told, ["c", "n"], "left")
        zero = F.lit(0)
        a = a.withColumns({"open": F.col("open") - F.coalesce("k", zero), "xc": _xor("xc", F.coalesce("got_c", zero)), "xn": _xor("xn", F.coalesce("got_n", zero)), **{v: F.col(v) + F.coalesce(f"got_{v}", zero) for v in ("leaves", "saved")}})
        by_chain = F.col("end_leaves").isNotNull()
        a = a.withColumn("done", by_chain | (F.col("open") == 0))
        a = a.withColumns({v: F.when(by_chain, F.col(f"sum_{v}") + F.col(f"end_{v}")).otherwise(F.col(v)) for v in ("leaves", "saved")})
        fresh = F.col("next_c").isNull() & one
        a = a.withColumns({"sum_leaves": F.when(fresh, F.col("leaves")).otherwise(F.col("sum_leaves")), "sum_saved": F.when(fresh, F.col("saved")).otherwise(F.col("sum_saved")), "next_n": F.when(fresh, F.col("xn")).otherwise(F.col("next_n")), "next_c": F.when(fresh, F.col("xc")).otherwise(F.col("next_c"))})
        state = common.cut(a.select(*kept))
    raise RuntimeError(f"the trie wasn't peeled in {max_rounds} rounds")


def trie(sequences: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    sequences is what numbered or rebuilt gives, ids (conv_id) all conversations, those without
    turns included. A member's turns begin with the node's; saved_tokens are the code points that
    copies of a turn at the same place repeat, summed over the subtree; ends_sha256 is of the
    ids of members that end at the node. An empty table has no nodes, not even a root.
    """
    common.bound_batches(sequences.sparkSession)
    steps, ends = prefixes(sequences, ids)
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    root = ids.select("conv_id", *[zero.alias(c) for c in _NODE], none.alias("p1"), none.alias("p2"), zero.alias("size"), zero.alias("total"))
    nodes = steps.unionByName(root).groupBy(*_NODE).agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("p1", "p2", "size", "total")])
    nodes = common.cut(nodes)
    # Nodes with the same members lie on one path and have the same least member and number.
    links = nodes.groupBy("c", "n").agg(F.min(F.struct("depth", "p1", "p2", (F.col("total") - F.col("size")).alias("before"))).alias("top"), F.max(F.struct("depth", "total")).alias("end"))
    links = links.select("c", "n", (F.col("top.depth") - 1).alias("up"), F.col("top.p1").alias("p1"), F.col("top.p2").alias("p2"), F.col("end.depth").alias("last"), F.col("end.total").alias("until"), ((F.col("n") - 1) * (F.col("end.total") - F.col("top.before"))).alias("own"))
    above = nodes.select(F.col("depth").alias("up"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("c").alias("pc"), F.col("n").alias("pn"))
    links = common.cut(links.join(above, ["up", "p1", "p2"], "left").select("c", "n", "up", "last", "until", "own", "pc", "pn"))
    children = links.where("pc is not null").groupBy(F.col("pc").alias("c"), F.col("pn").alias("n")).agg(F.count(F.lit(1)).alias("children"), F.bit_xor("c").alias("xc"), F.bit_xor("n").alias("xn"))
    links = common.cut(links.join(children, ["c", "n"], "left").withColumns({c: F.coalesce(c, zero) for c in ("children", "xc", "xn")}))
    totals = peel(links.select("c", "n", "pc", "pn", "children", "xc", "xn", F.when(F.col("children") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("leaves"), F.col("own").alias("saved")))
    links = links.select("c", "n", "up", "last", "until", "pc", "children", "own").join(totals, ["c", "n"])
    rows = nodes.join(links.select("c", "n", "up", "last", "until", "pc", "children", "leaves", (F.col("saved") - F.col("own")).alias("below")), ["c", "n"]).join(hashed_ends(ends), _NODE, "left")
    own = (F.col("n") - 1) * (F.col("until") - F.col("total") + F.col("size"))
    return rows.select(
        F.col("c").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("up") + 1, F.col("pc")).otherwise(F.col("c")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("depth") == F.col("last"), F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") + own).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(numbered(common.table(spark, sf_dir, "conversations"))))
