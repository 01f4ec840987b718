"""The call graph of executable functions: typed edges, what stays uncertain, and what a virtual call may reach.

Fact columns that the operators read:

operations  symbol (the function it stands in), kind (invocation, object_creation, property, event_add,
            event_remove, method_reference, unary, binary, compound, increment, conversion, unresolved),
            target (the method; the operator or conversion method), getter, setter (of a property),
            place (what stands around a property: assigned, compound, increment, out, ref, else null),
            is_nameof, is_call_syntax, candidates (array, of an unresolved one), source_path, start
methods     symbol, definition (what it was reduced, split or constructed from), identity (assembly,
            declaration and places as text, null if unknown), is_sealed, is_virtual, is_abstract,
            is_override, container_kind
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .graphs import ancestors
from .references import unique_on

# Kinds of operations and of the edges they make, in the order in which edges are listed.
EDGES = ("Invocation", "ObjectCreation", "PropertyGet", "PropertySet", "EventAdd", "EventRemove", "UserOperator", "UserConversion")
UNCERTAINTIES = ("MethodGroup", "UnresolvedBinding", "VirtualOrInterfaceDispatch")
OPERATORS = ("unary", "binary", "compound", "increment")


def property_access(place: Column) -> tuple[Column, Column]:
    """(read, write) of a property by what stands around it: an assignment's target or an out argument is
    written, a compound or increment's target or a ref argument both, anything else read."""
    p = F.coalesce(place, F.lit(""))
    return ~p.isin("assigned", "out"), p.isin("assigned", "out", "compound", "increment", "ref")


def called(operations: DataFrame) -> DataFrame:
    """(source, target, kind, source_path, start) of everything that an operation calls; calls without a method are left out."""
    read, write = property_access(F.col("place"))
    pair = lambda on, target, kind: F.when(on, F.struct(F.col(target).alias("target"), F.lit(kind).alias("edge")))
    k = F.col("kind")
    made = F.array(
        pair(k == "invocation", "target", EDGES[0]), pair(k == "object_creation", "target", EDGES[1]), pair((k == "property") & read, "getter", EDGES[2]), pair((k == "property") & write, "setter", EDGES[3]),
        pair(k == "event_add", "target", EDGES[4]), pair(k == "event_remove", "target", EDGES[5]), pair(k.isin(*OPERATORS), "target", EDGES[6]), pair(k == "conversion", "target", EDGES[7]),
    )
    rows = operations.select(F.col("symbol").alias("source"), F.explode(F.array_compact(made)).alias("c"), "source_path", "start")
    return rows.select("source", F.col("c.target").alias("target"), F.col("c.edge").alias("kind"), "source_path", "start").where("target is not null")


def resolved(targets: DataFrame, methods: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, definition, node) of each target once: node is the function (symbol, in nodes) that it stands for, else null.

    That is its definition if it is a node, or else the one node with the same identity in another
    compilation; an identity that several nodes have is none.
    """
    t = targets.select("target").distinct().join(methods.select(F.col("symbol").alias("target"), "definition", "identity").dropDuplicates(["target"]), "target", "left")
    t = t.select("target", F.coalesce("definition", "target").alias("definition"), "identity")
    own = nodes.select(F.col("symbol").alias("definition"), F.col("symbol").alias("direct")).distinct()
    known = methods.join(nodes.select("symbol").distinct(), "symbol", "left_semi").where("identity is not null").select("identity", F.col("symbol").alias("elsewhere")).distinct()
    t = t.join(own, "definition", "left").join(unique_on(known, ["identity"]), "identity", "left")
    return t.select("target", "definition", F.coalesce("direct", "elsewhere").alias("node"))


def call_graph(operations: DataFrame, methods: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, uncertainty) between functions (symbol, in nodes), each row once.

    edges: a, b, kind (EDGES), source_path, start; a call of what is no function makes none.
    uncertainty: source, node, kind (UNCERTAINTIES), is_global, source_path, start. A method used as a
    value affects it; an unresolved call affects its candidates, or everything if it has none; a
    call that may be dispatched elsewhere, operators aside, affects the method and everything.
    """
    o = operations.join(nodes.select("symbol").distinct(), "symbol", "left_semi")
    calls = called(o)
    groups = o.where("kind = 'method_reference' and target is not null and not coalesce(is_nameof, false)").select(F.col("symbol").alias("source"), "target", F.lit(UNCERTAINTIES[0]).alias("kind"), F.lit(False).alias("is_global"), "source_path", "start")
    open_ = o.where("kind = 'unresolved' and coalesce(is_call_syntax, false)").select(F.col("symbol").alias("source"), F.explode_outer("candidates").alias("target"), "source_path", "start")
    open_ = open_.select("source", "target", F.lit(UNCERTAINTIES[1]).alias("kind"), F.col("target").isNull().alias("is_global"), "source_path", "start")
    may = methods.where("not coalesce(is_sealed, false) and (coalesce(is_virtual, false) or coalesce(is_abstract, false) or coalesce(is_override, false) or coalesce(container_kind, '') = 'interface')").select(F.col("symbol").alias("target")).distinct()
    sent = calls.where(F.col("kind") != EDGES[6]).join(may, "target", "left_semi").select("source", "target", F.lit(UNCERTAINTIES[2]).alias("kind"), F.lit(True).alias("is_global"), "source_path", "start")
    doubt = groups.unionByName(open_).unionByName(sent)
    known = resolved(calls.select("target").unionByName(doubt.where("target is not null").select("target")), methods, nodes)
    edges = calls.join(known.where("node is not null"), "target").select(F.col("source").alias("a"), F.col("node").alias("b"), "kind", "source_path", "start").distinct()
    doubt = doubt.join(known, "target", "left").select("source", F.coalesce("node", "definition").alias("node"), "kind", "is_global", "source_path", "start").distinct()
    return edges, doubt


def type_intervals(base_types: DataFrame) -> DataFrame:
    """(type, low, high) of a forest (type, base): x derives from y, or is y, if low(y) <= low(x) < high(y).

    Numbers are in preorder, siblings in the order of their names: a type's number is the sum, over
    it and its bases, of one and the sizes of the siblings before. Roots count as siblings.
    """
    up = ancestors(base_types.select(F.col("type").alias("node"), F.col("base").alias("parent")))
    size = up.groupBy(F.col("ancestor").alias("type")).agg(F.count(F.lit(1)).alias("size"))
    t = base_types.select("type", "base").join(size, "type")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("base").orderBy("type").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = t.select(F.col("type").alias("ancestor"), (before + 1).alias("step"))
    low = up.join(own, "ancestor").groupBy(F.col("node").alias("type")).agg(F.sum("step").alias("low"))
    return low.join(size, "type").select("type", "low", (F.col("low") + F.col("size")).alias("high"))


def dispatch_targets(calls: DataFrame, implementations: DataFrame, base_types: DataFrame) -> DataFrame:
    """(receiver, slot, method), each once, of virtual calls (receiver, slot): all that they may run.

    implementations is (type, slot, method), at most one a slot and type: what any type that derives
    from the receiver declares for the slot, and what the receiver itself has, declared by it or its nearest base.
    Implementations are handed up to each base, so what meets in the join are the rows of one receiver and slot.
    """
    c = cut(calls.select("receiver", "slot").distinct())
    up = cut(ancestors(base_types.select(F.col("type").alias("node"), F.col("base").alias("parent"))))
    heard = up.join(c.select(F.col("receiver").alias("ancestor")).distinct(), "ancestor", "left_semi").select(F.col("node").alias("type"), F.col("ancestor").alias("receiver"))
    below = implementations.join(heard, "type").join(c, ["receiver", "slot"], "left_semi").select("receiver", "slot", "method")
    near = c.join(up.select(F.col("node").alias("receiver"), F.col("ancestor").alias("type"), "depth"), "receiver").join(implementations, ["type", "slot"])
    own = near.groupBy("receiver", "slot").agg(F.min_by("method", "depth").alias("method"))
    return reduce(DataFrame.unionByName, [below, own]).distinct()
