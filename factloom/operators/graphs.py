"""Graph operators over edge tables: components, strong components, paths, reachability, hubs, chains.

Every loop works on frontiers or labels as DataFrames and keeps each round in the checkpoint
folder; a loop that doesn't settle within its bound raises rather than truncates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, drop

MAX_ROUNDS = 1000
#: Nodes whose least neighbour is broadcast, at most, and the edges that each of them has at least.
CENTRES, CENTRE_EDGES = 1000, 10_000


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges (a, b), directions aside; root is the component's least node.

    Large-star and small-star rounds (Kiveris et al., 2014): the number of rounds grows with the
    logarithm of the longest path, and rows never exceed the edges.
    """
    e = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct()
    e = cut(e)
    for _ in range(max_rounds):
        # Done when every edge points at a least node: no node is above two others, or above and below.
        sides = e.select(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        open_ = sides.groupBy("n").agg(F.max("below").alias("below"), F.sum("above").alias("above")).where("above > 1 or (above = 1 and below = 1)")
        if open_.limit(1).count() == 0:
            break
        n = e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "u", "v", both.where("v > u"), 2 * n).select(F.least("m", "u").alias("u"), "v").where("u <> v").distinct()
        small = _with_least(large, "v", "u", large, n)
        new = small.select(F.col("m").alias("u"), "v").unionByName(small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
        new = cut(new)
        drop(e)
        e = new
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    own = e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return e.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root").unionByName(own)


def _with_least(edges: DataFrame, node: str, other: str, rows: DataFrame, n: int) -> DataFrame:
    """rows with m, the least other of their node in edges, of which there are n.

    A node of very many edges would bring all its rows to one task. At most CENTRES nodes can
    have n / CENTRES edges each; their m is broadcast, and only the rows of the rest are dealt.
    """
    least = edges.groupBy(node).agg(F.min(other).alias("m"), F.count(F.lit(1)).alias("_n"))
    many = max(CENTRE_EDGES, n // CENTRES)
    if n <= many:  # no node can have so many
        return rows.join(least.drop("_n"), node).select(*rows.columns, "m")
    hot = F.broadcast(least.where(F.col("_n") > many).select(node, F.col("m").alias("_hot")))
    marked = rows.join(hot, node, "left")
    rest = marked.where("_hot is null").drop("_hot").join(least.where(F.col("_n") <= many).select(node, "m"), node)
    columns = [*rows.columns, "m"]
    return marked.where("_hot is not null").withColumnRenamed("_hot", "m").select(*columns).unionByName(rest.select(*columns))


def _settle(labels: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """Least label that reaches each node along edges (a, b), starting from labels (node, label)."""
    for _ in range(max_rounds):
        told = edges.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "label")
        new = labels.unionByName(told).groupBy("node").agg(F.min("label").alias("label"))
        new = cut(new)
        changed = new.alias("n").join(labels.alias("o"), "node").where("n.label <> o.label").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"labels didn't settle in {max_rounds} rounds")


def strong_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is its least node.

    Nodes without predecessors or successors are trimmed as components of their own. Then every
    node takes the least node that reaches it as colour; a colour's own node, with what reaches it
    inside the colour, is a component (colouring, Orzan 2004), and the rest goes on.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    nodes = cut(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct())
    done = None
    for _ in range(max_rounds):
        # trim
        inner = nodes.join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_semi").join(edges.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
        inner = cut(inner)
        lone = nodes.join(inner, "node", "left_anti").select("node", F.col("node").alias("component"))
        done = lone if done is None else done.unionByName(lone)
        trimmed = lone.limit(1).count() > 0
        nodes = inner
        edges = cut(edges.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").join(nodes.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b"))
        if trimmed:
            continue
        if nodes.limit(1).count() == 0:
            return done
        colours = _settle(nodes.select("node", F.col("node").alias("label")), edges, max_rounds)
        inside = edges.join(colours.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(colours.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la = lb")
        back = cut(inside.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Backwards from each colour's own node.
        reached = cut(colours.where("node = label"))
        frontier = reached
        for _ in range(max_rounds):
            step = back.join(frontier.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "label").distinct()
            frontier = cut(step.join(reached, "node", "left_anti"))
            if frontier.limit(1).count() == 0:
                break
            reached = cut(reached.unionByName(frontier))
        else:
            raise RuntimeError("backward search didn't end")
        done = cut(done.unionByName(reached.select("node", F.col("label").alias("component"))))
        nodes = cut(nodes.join(reached, "node", "left_anti"))
        edges = cut(edges.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").join(nodes.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b"))
    raise RuntimeError("strong components not found")


def qualified_components(comps: DataFrame, edges: DataFrame, files: DataFrame, least_nodes: int = 3, least_files: int = 3) -> DataFrame:
    """(component, nodes, files, projects, internal_edges) of components with enough nodes and files.

    files is (node, file, project), several rows for a node with several declarations.
    """
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    spread = comps.join(files, "node").groupBy("component").agg(F.count_distinct("file").alias("files"), F.count_distinct("project").alias("projects"))
    a, b = comps.select(F.col("node").alias("a"), F.col("component").alias("ca")), comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    inner = edges.select("a", "b").distinct().join(a, "a").join(b, "b").where("ca = cb and a <> b").groupBy(F.col("ca").alias("component")).agg(F.count(F.lit(1)).alias("internal_edges"))
    out = sizes.join(spread, "component").join(inner, "component")
    return out.where((F.col("nodes") >= least_nodes) & (F.col("files") >= least_files))


def example_cycles(comps: DataFrame, edges: DataFrame, max_length: int = MAX_ROUNDS) -> DataFrame:
    """(component, path): the least node, its least successor inside, and the shortest way back.

    Ties go to the path with the smaller nodes in order. The search runs over all components at
    once, level by level; each component's search ends when it is back.
    """
    a, b = comps.select(F.col("node").alias("a"), F.col("component").alias("ca")), comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    inner = cut(edges.select("a", "b").where("a <> b").distinct().join(a, "a").join(b, "b").where("ca = cb").select(F.col("ca").alias("component"), "a", "b"))
    start = inner.where("a = component").groupBy("component").agg(F.min("b").alias("node"))
    frontier = cut(start.select("component", "node", F.array("component", "node").alias("path")))
    seen = frontier.select("component", "node")
    found = None
    for _ in range(max_length):
        step = inner.withColumnRenamed("a", "node").join(frontier, ["component", "node"]).select("component", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        step = cut(step.groupBy("component", "node").agg(F.min("path").alias("path")))
        back = step.where("node = component").select("component", "path")
        found = back if found is None else found.unionByName(back)
        frontier = step.join(back, "component", "left_anti").join(seen, ["component", "node"], "left_anti")
        frontier = cut(frontier.where("node <> component"))
        if frontier.limit(1).count() == 0:
            return found
        seen = cut(seen.unionByName(frontier.select("component", "node")))
    raise RuntimeError("cycle search didn't end")


def witnesses(facts: DataFrame, edge: list[str], order: list[str]) -> DataFrame:
    """One row per edge: the least of its facts in the order given."""
    rn = F.row_number().over(Window.partitionBy(*edge).orderBy(*order))
    return facts.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def hubs(edges: DataFrame, test_edges: DataFrame, least_in: int, least_out: int) -> DataFrame:
    """(node, fan_in, fan_out, test_consumers) of nodes with enough distinct predecessors and successors."""
    e = edges.select("a", "b").where("a <> b").distinct()
    fan_in = e.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    fan_out = e.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    tests = test_edges.select("a", "b").where("a <> b").distinct().groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("test_consumers"))
    out = fan_in.where(F.col("fan_in") >= least_in).join(fan_out.where(F.col("fan_out") >= least_out), "node").join(tests, "node", "left")
    return out.withColumn("test_consumers", F.coalesce("test_consumers", F.lit(0)))


def forwarding_paths(forwarders: DataFrame, least_edges: int = 2, max_rounds: int = 60) -> DataFrame:
    """(root, path) from every root of a functional graph (node, target) to the node without target.

    A root has a target and no predecessor; a path that runs into a cycle is discarded. A target
    that is no node is an error. Paths of fewer than least_edges edges are left out. Each round
    doubles how far every node is known to lead, and how much of each root's path is known.
    """
    f = cut(forwarders.select("node", "target"))
    missing = f.where("target is not null").join(f.select(F.col("node").alias("target")), "target", "left_anti")
    if missing.limit(1).count():
        raise ValueError("a forwarding target has no declaration")
    n = f.count()
    heads = f.where("target is not null").join(f.where("target is not null").select(F.col("target").alias("node")).distinct(), "node", "left_anti")
    known = cut(heads.select(F.col("node").alias("root"), "node", F.lit(0).cast("long").alias("at")))
    jump = f.where("target is not null").select("node", F.col("target").alias("far"))
    for k in range(max_rounds):
        further = cut(known.join(jump, "node").select("root", F.col("far").alias("node"), (F.col("at") + (1 << k)).alias("at")))
        known = known.unionByName(further)
        if 1 << k > n:  # longer than all nodes: what goes on now goes round
            known = known.join(further.select("root").distinct(), "root", "left_anti")
            break
        if further.limit(1).count() == 0:
            break
        jump = cut(jump.join(jump.select(F.col("node").alias("far"), F.col("far").alias("further")), "far").select("node", F.col("further").alias("far")))
    else:
        raise RuntimeError("paths didn't end")
    paths = known.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("path"))
    return paths.where(F.size("path") > least_edges)


def reach(edges: DataFrame, nodes: DataFrame, max_length: int = MAX_ROUNDS) -> DataFrame:
    """(node, kind, path) of every node (node, is_root, is_production): Direct, Indirect or NoPath.

    The search starts at roots and remembers whether a production node came before. A node met
    first without one is Direct, else Indirect; a node met both ways is Direct. Among shortest
    paths the one with the smaller nodes in order is kept.
    """
    role = cut(nodes.select("node", "is_root", "is_production"))
    e = edges.select("a", "b").distinct().join(role.select(F.col("node").alias("b")), "b", "left_semi")
    e = cut(e.select("a", "b"))
    frontier = cut(role.where("is_root").select("node", F.lit(False).alias("after"), F.array("node").alias("path")))
    seen = frontier
    for _ in range(max_length):
        at = frontier.join(role, "node").select(F.col("node").alias("a"), (F.col("after") | F.col("is_production")).alias("after"), "path")
        step = at.join(e, "a").select(F.col("b").alias("node"), "after", F.concat("path", F.array("b")).alias("path"))
        step = step.groupBy("node", "after").agg(F.min("path").alias("path"))
        frontier = cut(step.join(seen, ["node", "after"], "left_anti"))
        if frontier.limit(1).count() == 0:
            break
        seen = cut(seen.unionByName(frontier))
    else:
        raise RuntimeError("reachability didn't end")
    best = seen.groupBy("node").agg(F.min_by(F.struct("after", "path"), "after").alias("s"))
    out = role.join(best, "node", "left").where("is_production")
    kind = F.when(F.col("s").isNull(), "NoPath").when(F.col("s.after"), "Indirect").otherwise("Direct")
    return out.select("node", kind.alias("kind"), F.col("s.path").alias("path"))


def closure(edges: DataFrame, seeds: DataFrame, max_length: int = MAX_ROUNDS) -> DataFrame:
    """(node) reachable from seeds (node) along edges (a, b), seeds included."""
    e = cut(edges.select("a", "b").distinct())
    frontier = cut(seeds.select("node").distinct())
    seen = frontier
    for _ in range(max_length):
        step = e.join(frontier.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti"))
        if frontier.limit(1).count() == 0:
            return seen
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError("closure didn't end")


def uncertain(edges: DataFrame, nodes: DataFrame, affected: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, uncertain): the nodes that uncertainties (source, node, is_global) with a reachable
    source affect, and what these lead to; if one of them is global, every node.

    What is affected need not be reachable itself; a global uncertainty affects no node of its own.
    """
    met = closure(edges, roots)
    hit = cut(affected.join(met.select(F.col("node").alias("source")), "source", "left_semi"))
    after = closure(edges, hit.where("not is_global and node is not null").select("node"))
    everywhere = hit.agg(F.coalesce(F.max("is_global"), F.lit(False)).alias("everywhere"))
    marked = nodes.select("node").distinct().join(after.withColumn("marked", F.lit(True)), "node", "left")
    return marked.crossJoin(F.broadcast(everywhere)).select("node", (F.col("everywhere") | F.coalesce("marked", F.lit(False))).alias("uncertain"))


def ancestors(parents: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, ancestor, depth) of a forest (node, parent), each node with itself at depth 0.

    Known stretches double each round: rows that reach as far as any are continued by all rows of
    their ancestor, so a chain of 2**k nodes takes k rounds. A cycle is an error.
    """
    p = cut(parents.select("node", "parent"))
    more = p.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth"))
    above = more
    for k in range(max_rounds):
        on = above.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("depth").alias("on"))
        more = above.where(F.col("depth") == 1 << k).join(on, "ancestor")
        more = cut(more.select("node", F.col("top").alias("ancestor"), (F.col("depth") + F.col("on")).alias("depth")))
        n, cyclic = more.agg(F.count(F.lit(1)), F.max(F.col("node") == F.col("ancestor"))).first()
        if cyclic:
            raise ValueError("parents form a cycle")
        if n == 0:
            return p.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("depth")).unionByName(above)
        above = above.unionByName(more)
    raise ValueError("a chain of parents is too long")


def visible_all_the_way(chain: DataFrame, visible: DataFrame) -> DataFrame:
    """(node, protected): every ancestor of the node, itself included, is visible (node, is_visible)."""
    joined = chain.join(visible.withColumnRenamed("node", "ancestor"), "ancestor")
    return joined.groupBy("node").agg(F.bool_and("is_visible").alias("protected"))


def running_depth(step: Column, owner: list[str], order: list[str]) -> Column:
    """Nesting depth after each token: the sum of +1 and -1 steps so far in its owner."""
    return F.sum(step).over(Window.partitionBy(*owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
