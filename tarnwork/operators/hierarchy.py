"""Full hierarchies from parent-child rows.

Method: one parent per node gives a graph in which every node has one way up.
Pointer doubling finds the circles of that graph and each is opened at its
smallest node, which leaves a forest; heavy-path decomposition labels the
forest's chains by subtree size. A node reaches the top over at most log2(n)
chains, so its path is the concatenation of that many chain segments and "a is
above t" is an interval test on the chain of ``a``. Links beyond the forest
(second parents, links that close a circle) enter as portals. A portal hops to
another one if the parent end of the latter's link lies under it; circles of
the whole graph are the strongly connected parts of that small graph, and
depths are the fewest links in the whole graph, not only in the forest.

Rounds: circles, depth, subtree sizes and chains take log2(depth) doubling
rounds, also on long rings; portals take one round per extra link on a path.
Each round writes one table and observes while writing whether it is the last.

Defined results for odd input: null ends and repeated links are ignored, a
link of a node to itself only marks it as its own ancestor, an empty table
gives empty results, extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.session import Workspace

#: Nodes of a chain held in one row where paths are put together.
BLOCK = 64


@dataclass
class Hierarchy:
    """The labelled graph. ``nodes``: node, up, root, depth, size (of its
    forest subtree), chain, off. ``segments``: node, depth, chain, top (the
    node's path runs on ``chain`` from position 0 to ``top``). ``extra``: the
    links outside the forest. ``over``: portal, pdepth, to, node, w (from the
    portal down to ``node`` and over its extra link to ``to`` are ``w`` links).
    ``cyclic``: node. ``links``: all links."""

    ws: Workspace
    nodes: DataFrame
    segments: DataFrame
    extra: DataFrame
    over: DataFrame
    cyclic: DataFrame
    links: DataFrame


def _trim(ws: Workspace, arcs: DataFrame, levels: int = 2) -> tuple[DataFrame, int]:
    """Arcs that can lie on a circle: both ends have arcs in and out."""
    core, seen = ws.measured(arcs)
    n = seen["n"]
    while n:
        left = core
        for _ in range(levels):
            left = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        left, seen = ws.measured(left)
        ws.drop(core)
        core = left
        if seen["n"] == n:
            break
        n = seen["n"]
    return core, n


def _spread(ws: Workspace, arcs: DataFrame, marks: DataFrame, steps: int = 2) -> DataFrame:
    """(node, mark): the largest mark that reaches a node over arcs, its own included."""
    cur = ws.cut(marks.select("node", "mark"))
    while True:
        new = cur.select("node", "mark", F.col("mark").alias("was"))
        for _ in range(steps):
            sent = new.join(arcs, new.node == arcs.a).select(F.col("b").alias("node"), "mark", F.lit(None).cast("string").alias("was"))
            new = new.unionByName(sent).groupBy("node").agg(F.max("mark").alias("mark"), F.max("was").alias("was"))
        table, seen = ws.measured(new, moved=F.count_if(F.col("mark") > F.col("was")))
        ws.drop(cur)
        if not seen["moved"]:
            return table.select("node", "mark")
        cur = table


def strong_components(ws: Workspace, arcs: DataFrame) -> DataFrame:
    """(node, comp) of every node on a circle of two or more nodes of ``arcs`` (a, b).

    What trimming leaves is coloured forwards by the largest node that reaches
    a node, then backwards within each colour from the node that gave it.
    """
    core, n = _trim(ws, arcs.where("a <> b").distinct())
    found: DataFrame | None = None
    while n:
        nodes = core.select(F.col("a").alias("node")).union(core.select("b")).distinct()
        colour = ws.cut(_spread(ws, core, nodes.withColumn("mark", F.col("node"))).withColumnRenamed("mark", "colour"))
        ca, cb = colour.select(F.col("node").alias("a"), F.col("colour").alias("ca")), colour.select(F.col("node").alias("b"), F.col("colour").alias("cb"))
        back = ws.cut(core.join(ca, "a").join(cb, "b").where("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b")))
        marks = _spread(ws, back, colour.withColumn("mark", F.when(F.col("node") == F.col("colour"), "1").otherwise("")))
        done = ws.cut(marks.where("mark = '1'").join(colour, "node").select("node", F.col("colour").alias("comp")))
        found = done if found is None else found.unionByName(done)
        gone = done.select("node")
        rest = core.join(gone, core.a == gone.node, "left_anti").join(gone, core.b == gone.node, "left_anti")
        old = core
        core, n = _trim(ws, rest)
        ws.drop(old, colour, back)
    if found is None:
        return arcs.select(F.col("a").alias("node"), F.col("a").alias("comp")).limit(0)
    sized = found.groupBy("comp").count().where("count > 1").select("comp")
    return found.join(sized, "comp", "left_semi").select("node", "comp")


def _one_way_up(ws: Workspace, names: DataFrame, proper: DataFrame) -> DataFrame:
    """(node, up): the smallest parent of each node, none where the node opens a circle.

    ``low`` is the smallest of the nodes above; where it moves no more it is so
    over all of them, and a node that is its own ``low`` is the smallest of a circle.
    """
    first = proper.groupBy("child").agg(F.min("parent").alias("parent"))
    start = names.join(first, names.node == first.child, "left")
    state, seen = ws.measured(start.select("node", F.col("parent").alias("up"), F.col("parent").alias("anc"), F.col("parent").alias("low")))
    moved = seen["n"]
    while moved:
        hop = state.where("anc is not null").select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("low").alias("low2"))
        new = state.where("anc is not null").join(hop, "anc", "left").select("node", "up", F.col("anc2").alias("anc"), F.least("low", "low2").alias("low"), F.col("low").alias("was"))
        new = new.unionByName(state.where("anc is null").select("node", "up", "anc", "low", F.col("low").alias("was")))
        table, seen = ws.measured(new, moved=F.count_if(F.col("low") < F.col("was")))
        ws.drop(state)
        state, moved = table, seen["moved"]
    return state.select("node", F.when(F.col("low").isNull() | (F.col("low") != F.col("node")), F.col("up")).alias("up"))


def build_hierarchy(links: DataFrame, child: str = "child", parent: str = "parent", nodes: DataFrame | None = None) -> Hierarchy:
    """Label the graph of ``links``. ``nodes`` (column node) may add nodes without links."""
    ws = Workspace(links.sparkSession, "hierarchy")
    given = links.select(F.col(child).cast("string").alias("child"), F.col(parent).cast("string").alias("parent"))
    given = ws.cut(given.where("child is not null and parent is not null").distinct())
    proper = given.where("child <> parent")
    names = given.select(F.col("child").alias("node")).union(given.select("parent"))
    if nodes is not None:
        names = names.union(nodes.select(F.col("node").cast("string")).where("node is not null"))
    tree = ws.cut(_one_way_up(ws, names.distinct(), proper))
    taken = tree.where("up is not null").select(F.col("node").alias("child"), F.col("up").alias("parent"))
    extra = ws.cut(proper.join(taken, ["child", "parent"], "left_anti"))

    # pointer doubling: root, depth, and subtree sizes (rows below within 2^k links)
    state, seen = ws.measured(
        tree.select("node", "up", F.coalesce("up", "node").alias("anc"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.lit(1).cast("long").alias("size")),
        open=F.count_if(F.col("up").isNotNull()),
    )
    step = 1
    while seen["open"]:
        open_ = state.where(F.col("dist") == step)
        adds = open_.groupBy(F.col("anc").alias("node")).agg(F.sum("size").alias("more"))
        hop = state.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"))
        moved = open_.join(hop, "anc").select("node", F.col("anc2"), F.col("dist2"))
        step *= 2
        new, seen = ws.measured(
            state.join(moved, "node", "left").join(adds, "node", "left").select(
                "node", "up", F.coalesce("anc2", "anc").alias("anc"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"),
                (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
            ),
            open=F.count_if(F.col("dist") == step),
        )
        ws.drop(state)
        state = new

    # heavy child of each node, then chain heads by doubling along heavy links
    heavy = (
        state.where("up is not null").groupBy("up")
        .agg(F.max_by("node", F.struct("size", "node")).alias("node")).select("node", F.lit(True).alias("heavy"))
    )
    chains, seen = ws.measured(
        state.join(heavy, "node", "left").select(
            "node", "up", F.col("anc").alias("root"), F.col("dist").alias("depth"), "size",
            F.when(F.col("heavy"), F.col("up")).otherwise(F.col("node")).alias("chain"),
            F.when(F.col("heavy"), 1).otherwise(0).cast("long").alias("off"),
        ),
        open=F.count_if(F.col("off") == 1),
    )
    ws.drop(state, tree)
    step = 1
    while seen["open"]:
        hop = chains.select(F.col("node").alias("h"), F.col("chain").alias("chain2"), F.col("off").alias("off2"))
        open_ = chains.where(F.col("off") == step).select("node", F.col("chain").alias("h")).join(hop, "h").select("node", "chain2", "off2")
        step *= 2
        new, seen = ws.measured(
            chains.join(open_, "node", "left").select(
                "node", "up", "root", "depth", "size", F.coalesce("chain2", "chain").alias("chain"),
                (F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"),
            ),
            open=F.count_if(F.col("off") == step),
        )
        ws.drop(chains)
        chains = new

    # segments of every chain's way to its root: at most log2(n) light links
    place = chains.select(F.col("node").alias("up"), F.col("chain").alias("on"), F.col("off").alias("top"))
    heads, seen = ws.measured(chains.where("node = chain and up is not null").select(F.col("node").alias("of"), "up").join(place, "up").select("of", "on", "top"))
    front, segs = heads, heads
    nxt = heads.select(F.col("of").alias("on"), F.col("on").alias("on2"), F.col("top").alias("top2"))
    while seen["n"]:  # two links a table
        one = front.join(nxt, "on").select("of", F.col("on2").alias("on"), F.col("top2").alias("top"))
        two = one.join(nxt, "on").select("of", F.col("on2").alias("on"), F.col("top2").alias("top"))
        both, seen = ws.measured(one.withColumn("last", F.lit(False)).unionByName(two.withColumn("last", F.lit(True))))
        segs = segs.unionByName(both.drop("last"))
        front = both.where("last").drop("last")
    own = chains.select("node", "depth", "chain", F.col("off").alias("top"))
    above = chains.select("node", "depth", F.col("chain").alias("of")).join(segs, "of").select("node", "depth", F.col("on").alias("chain"), "top")
    segments = ws.cut(own.unionByName(above))

    # from a portal down the forest to the parent end of an extra link, and over it
    portals = chains.join(extra.select(F.col("child").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("portal"), "chain", "off", F.col("depth").alias("pdepth"))
    ends = extra.select(F.col("child").alias("to"), F.col("parent").alias("node")).join(segments, "node")
    over, seen = ws.measured(ends.join(portals, "chain").where("off <= top").select("portal", "pdepth", "to", "node", (F.col("depth") - F.col("pdepth") + 1).alias("w")))
    cyclic = ws.cut(_own_ancestors(ws, chains, segments, over).union(given.where("child = parent").select("child")).distinct())
    return Hierarchy(ws, chains, segments, extra, over, cyclic, given)


def _own_ancestors(ws: Workspace, chains: DataFrame, segments: DataFrame, over: DataFrame) -> DataFrame:
    """Nodes on the forest's way from a portal to an extra link that leads back to the portal."""
    comps = ws.cut(strong_components(ws, over.select(F.col("portal").alias("a"), F.col("to").alias("b"))))
    ca, cb = comps.select(F.col("node").alias("portal"), F.col("comp").alias("ca")), comps.select(F.col("node").alias("to"), F.col("comp").alias("cb"))
    closed = over.join(ca, "portal", "left").join(cb, "to", "left").where("portal = to or ca = cb")
    ways = closed.groupBy("node").agg(F.min("pdepth").alias("least"))
    spans = ways.join(segments, "node").groupBy("chain", "least").agg(F.max("top").alias("top"))
    return chains.join(spans, "chain").where("off <= top and depth >= least").select("node")


def _tops(h: Hierarchy, roots: DataFrame) -> DataFrame:
    info = h.nodes.select(F.col("node").alias("root"), "chain", "off", F.col("depth").alias("pdepth"))
    return h.ws.cut(roots.select(F.col("root").cast("string")).where("root is not null").distinct().join(info, "root"))


def _portal_ways(h: Hierarchy, tops: DataFrame, steps: DataFrame | None) -> DataFrame:
    """(root, portal, d, way): the fewest links from each root to each portal it
    reaches over extra links, with the nodes before the portal where ``steps`` are given."""
    ws = h.ws
    none = F.lit(None).cast("array<string>")
    ends = h.extra.select(F.col("child").alias("to"), F.col("parent").alias("node")).join(h.segments, "node")
    entry = ends.join(tops, "chain").where("off <= top").select(F.col("root").alias("portal"), "pdepth", "to", "node", (F.col("depth") - F.col("pdepth") + 1).alias("w"))

    def shortest(over: DataFrame) -> DataFrame:
        least = over.groupBy("portal", "to").agg(F.min(F.struct("w", "node", "pdepth")).alias("x")).select("portal", "to", "x.*")
        if steps is None:
            return least.select("portal", "to", "w", none.alias("part"))
        return least.join(steps, "node").select("portal", "to", "w", F.slice("steps", F.col("pdepth").cast("int") + 1, F.col("w").cast("int")).alias("part"))

    hops = ws.cut(shortest(h.over))
    cur, seen = ws.measured(shortest(entry).select(F.col("portal").alias("root"), F.col("to").alias("portal"), F.col("w").alias("d"), F.col("part").alias("way"), F.lit(True).alias("fresh")))
    while seen["n"]:
        sent = cur.where("fresh").join(hops, "portal").select("root", F.col("to").alias("portal"), (F.col("d") + F.col("w")).alias("d"), F.concat("way", "part").alias("way"), F.lit(None).cast("long").alias("old"))
        both = cur.select("root", "portal", "d", "way", F.col("d").alias("old")).unionByName(sent)
        new = both.groupBy("root", "portal").agg(F.min(F.struct("d", "way")).alias("x"), F.min("old").alias("old"))
        new = new.select("root", "portal", "x.d", "x.way", (F.col("old").isNull() | (F.col("x.d") < F.col("old"))).alias("fresh"))
        table, seen = ws.measured(new, fresh=F.count_if("fresh"))
        ws.drop(cur)
        cur = table
        if not seen["fresh"]:
            break
    portals = h.nodes.select(F.col("node").alias("portal"), "chain", "off", F.col("depth").alias("pdepth"))
    empty = F.array().cast("array<string>") if steps is not None else none
    return tops.select("root", "chain", "off", "pdepth", F.lit(0).cast("long").alias("d"), empty.alias("way")).unionByName(
        cur.join(portals, "portal").select("root", "chain", "off", "pdepth", "d", "way")
    )


def under_roots(h: Hierarchy, roots: DataFrame) -> DataFrame:
    """(root, node, depth): every node at or under each given root (column
    ``root``) with the fewest links between them. Roots that are no node give
    no row; repeated roots count once."""
    reach = _portal_ways(h, _tops(h, roots), None).select("root", "chain", "off", (F.col("d") - F.col("pdepth")).alias("base"))
    return reach.join(h.segments, "chain").where("off <= top").groupBy("root", "node").agg(F.min(F.col("base") + F.col("depth")).alias("depth"))


def _forest_steps(h: Hierarchy) -> DataFrame:
    """(node, steps): each node's way down the forest, chain prefixes joined from
    the top. A chain lies in rows of ``BLOCK`` nodes, of which a prefix takes what it needs."""
    blocks = h.nodes.withColumn("block", F.floor(F.col("off") / BLOCK)).groupBy("chain", "block").agg(
        F.sort_array(F.collect_list(F.struct("off", "node"))).alias("members"), F.min("depth").alias("start")
    )
    wanted = h.segments.select("node", "chain", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / BLOCK))).alias("block"))
    parts = wanted.join(blocks, ["chain", "block"]).select("node", "start", F.expr(f"slice(members, 1, cast(top - block * {BLOCK} as int) + 1).node").alias("part"))
    return parts.groupBy("node").agg(F.flatten(F.expr("transform(sort_array(collect_list(struct(start, part))), x -> x.part)")).alias("steps"))


def rooted_paths(h: Hierarchy, roots: DataFrame) -> DataFrame:
    """(root, node, depth, steps): as ``under_roots``, with the nodes of one way
    of the fewest links, from the root to the node; equal ways by the smallest."""
    steps = h.ws.cut(_forest_steps(h))
    reach = _portal_ways(h, _tops(h, roots), steps)
    found = reach.join(h.segments, "chain").where("off <= top").groupBy("root", "node").agg(F.min(F.struct((F.col("d") + F.col("depth") - F.col("pdepth")).alias("depth"), "way", "pdepth")).alias("x"))
    return found.select("root", "node", "x.depth", "x.way", "x.pdepth").join(steps, "node").select(
        "root", "node", "depth", F.concat("way", F.slice("steps", F.col("pdepth").cast("int") + 1, (F.size("steps") - F.col("pdepth")).cast("int"))).alias("steps")
    )


def descendants(h: Hierarchy) -> DataFrame:
    """(root, node, depth): every node with all nodes at or below it over all links."""
    return under_roots(h, h.nodes.select(F.col("node").alias("root")))


def forest_paths(h: Hierarchy, sep: str = " > ") -> DataFrame:
    """One row per node: its root, depth, subtree size and path in the forest,
    the path being chain prefixes joined from the top down."""
    return (
        h.nodes.join(_forest_steps(h), "node")
        .join(h.cyclic.withColumn("cyc", F.lit(True)), "node", "left")
        .select("node", "root", "depth", "size", F.array_join("steps", sep).alias("path"), F.coalesce("cyc", F.lit(False)).alias("own_ancestor"))
    )
