"""Simple cycles of directed graphs as joins: strongly connected parts, chains as single edges, then paths that meet.

All projects are worked on at once and none is a group: every step is an aggregation with
a combiner or a join on nodes. The tables of a step are in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stepwise import Steps

P = "project_id"
# Orders of nodes by hashes in which labels are found at once.
ORDERS = 2
# A round of short cuts that leaves more than this share of the edges is followed by one of labels.
SHRUNK = 0.7


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without edges from nodes that nothing leads to, or to nodes that lead nowhere. One round: the rest is left to the labels."""
    into, out = edges.select(P, F.col("dst").alias("src")).distinct(), edges.select(P, F.col("src").alias("dst")).distinct()
    return edges.join(into, [P, "src"], "left_semi").join(out, [P, "dst"], "left_semi")


def _labels(edges: DataFrame, steps: Steps) -> DataFrame:
    """`node`, `x`, `y`: of each node, for each of ORDERS, the first one from which edges lead to it, and the first one that they lead to, itself included.

    A label goes along edges and then jumps to the label of its own node. In the orders of
    hashes the labels that a way passes are few, so distances double whatever the names
    are: rounds are about the logarithm of the longest way. A step has two rounds.
    """
    ranked = lambda c: F.struct(F.xxhash64("k", c).alias("rank"), F.col(c).alias("name"))
    dealt = edges.select(P, "src", "dst", F.explode(F.array(*map(F.lit, range(ORDERS)))).alias("k"))
    way = lambda a, b, back: dealt.select(P, "k", F.lit(back).alias("back"), ranked(a).alias("from"), ranked(b).alias("node"))
    ends = steps.keep(way("src", "dst", False).unionByName(way("dst", "src", True)))
    key = [P, "k", "back"]

    def moved(state: DataFrame) -> DataFrame:
        came = ends.join(state.select(*key, F.col("node").alias("from"), "least"), [*key, "from"]).groupBy(*key, "node").agg(F.min("least").alias("came"))
        via = state.join(came, [*key, "node"], "left").select(*key, "node", F.least("least", "came").alias("via"), "before")
        jump = state.select(*key, F.col("node").alias("via"), F.col("least").alias("further"))
        return via.join(jump, [*key, "via"]).select(*key, "node", F.least("via", "further").alias("least"), "before")

    state = ends.select(*key, "node").distinct().withColumn("least", F.col("node"))
    while True:
        state = steps.keep(moved(moved(state.withColumn("before", F.col("least")))))
        if state.where("least <> before").isEmpty():
            break
        state = state.drop("before")
    of = lambda back: F.array(*[F.min(F.when((F.col("k") == k) & (F.col("back") == back), F.col("least.name"))) for k in range(ORDERS)])
    return state.groupBy(P, F.col("node.name").alias("node")).agg(of(False).alias("x"), of(True).alias("y"))


def _short_cut(edges: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Edges without nodes of one edge in and one out; `node`, `a`, `b` of chains of such, that lie on a way from a to b; `node`, `root` of rings of such.

    Pointers towards the start of a chain double, with the least node that they pass: the
    least of a ring meets itself. Rounds are about the logarithm of the longest chain or ring.
    """
    out = edges.groupBy(P, F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("dst").alias("next"))
    into = edges.groupBy(P, F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("src").alias("previous"))
    plain = steps.keep(out.join(into, [P, "node"]).where("n_out = 1 AND n_in = 1").select(P, "node", "next", "previous"))
    if plain.isEmpty():
        return edges, None, None
    own = plain.select(P, "node")
    known = lambda c: own.select(P, F.col("node").alias(c), F.lit(True).alias(f"{c}_plain"))
    ends = steps.keep(plain.join(known("previous"), [P, "previous"], "left").join(known("next"), [P, "next"], "left").select(P, "node", F.when(F.col("previous_plain").isNull(), F.col("previous")).alias("a"), F.when(F.col("next_plain").isNull(), F.col("next")).alias("b"), "previous"))
    state = ends.select(P, "node", F.when(F.col("a").isNull(), F.col("previous")).otherwise(F.col("node")).alias("up"), F.when(F.col("a").isNull(), F.col("previous")).alias("low"), F.col("a").isNotNull().alias("ended"))
    while True:
        jump = state.select(P, F.col("node").alias("up"), F.col("up").alias("further"), F.col("low").alias("low2"), F.col("ended").alias("ended2"))
        state = steps.keep(state.join(jump, [P, "up"]).select(P, "node", F.col("further").alias("up"), F.least("low", "low2").alias("low"), (F.col("ended") | F.col("ended2")).alias("ended")))
        round_ = state.where("NOT ended").select(P, "node", "low")
        if round_.join(round_.where("low = node").select(P, "low"), [P, "low"], "left_anti").isEmpty():
            break
    first = state.where("ended").select(P, "node", "up")
    sides = steps.keep(ends.join(first, [P, "node"]).groupBy(P, "up").agg(F.max("a").alias("a"), F.max("b").alias("b")))
    chains = steps.keep(first.join(sides, [P, "up"]).select(P, "node", "a", "b"))
    rest = edges.join(own.withColumnRenamed("node", "src"), [P, "src"], "left_anti").join(own.withColumnRenamed("node", "dst"), [P, "dst"], "left_anti")
    left = rest.unionByName(sides.where("a <> b").select(P, F.col("a").alias("src"), F.col("b").alias("dst"))).distinct()
    return steps.keep(left), chains, steps.keep(round_.select(P, "node", F.col("low").alias("root")))


def _met(edges: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame | None]:
    """Edges after nodes that lead to one another directly are one; `node`, `root` of those that went: each to its least such neighbour, and so on."""
    back = edges.select(P, F.col("src").alias("dst"), F.col("dst").alias("src"))
    root = steps.keep(edges.where("dst < src").join(back, [P, "src", "dst"], "left_semi").groupBy(P, F.col("src").alias("node")).agg(F.min("dst").alias("root")))
    if root.isEmpty():
        return edges, None
    while True:
        jump = root.select(P, F.col("node").alias("root"), F.col("root").alias("further"))
        root = steps.keep(root.join(jump, [P, "root"], "left").select(P, "node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if root.where("moved").isEmpty():
            break
        root = root.drop("moved")
    root = root.select(P, "node", "root")
    return steps.keep(_renamed(edges, root).where("src <> dst").distinct()), root


def _renamed(edges: DataFrame, root: DataFrame, *more: str) -> DataFrame:
    of = lambda c: root.select(P, F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    return edges.join(of("src"), [P, "src"], "left").join(of("dst"), [P, "dst"], "left").select(P, F.coalesce("src_root", "src").alias("src"), F.coalesce("dst_root", "dst").alias("dst"), *more)


def _split(edges: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Edges between nodes of equal labels, and `node`, `root` of the components that the labels tell.

    A node whose first ancestor in an order is also its first descendant in it is in the
    component of that one. Other nodes stay together only if all labels are equal.
    """
    labels = _labels(edges, steps)
    same = F.array_compact(F.zip_with("x", "y", lambda x, y: F.when(x == y, x)))
    labels = steps.keep(labels.withColumn("root", F.get(same, F.lit(0))))
    side = lambda c, k: labels.where("root IS NULL").select(P, F.col("node").alias(c), F.struct("x", "y").alias(k))
    rest = edges.join(side("src", "s"), [P, "src"]).join(side("dst", "t"), [P, "dst"]).where("s = t").select(P, "src", "dst")
    return steps.keep(rest), labels.where("root IS NOT NULL").select(P, "node", "root")


def strong_edges(edges: DataFrame, steps: Steps) -> DataFrame:
    """The edges inside strongly connected components, with `component`, its least node.

    Rounds of short cuts: chains become edges, rings and nodes that lead to one another one
    node. What they leave is told apart by labels. Then the rounds are undone from the last
    one on: what became a node has its component, and a chain that of both of its ends.
    """
    every = steps.keep(edges.select(P, "src", "dst").where(F.col("src") != F.col("dst")).distinct())
    live, undo = steps.keep(_trimmed(every)), []
    left = live.count()
    while left:
        before = left
        live, chains, rings = _short_cut(live, steps)
        undo += [(chains, True), (rings, False)]
        live, root = _met(live, steps)
        undo.append((root, False))
        live = steps.keep(_trimmed(live))
        left = live.count()
        if left > SHRUNK * before:
            live, root = _split(live, steps)
            undo.append((root, False))
            live = steps.keep(_trimmed(live))
            left = live.count()
    of = every.select(P, F.col("src").alias("node"), F.col("src").alias("root")).limit(0)
    for table, chained in reversed(undo):
        if table is None:
            continue
        if chained:
            ends = _renamed(table.select(P, F.col("a").alias("src"), F.col("b").alias("dst"), "node"), of, "node").where("src = dst")
            of = steps.keep(of.unionByName(ends.select(P, "node", F.col("src").alias("root"))))
        else:
            up = of.select(P, F.col("node").alias("root"), F.col("root").alias("further"))
            of = steps.keep(of.unionByName(table.join(up, [P, "root"], "left").select(P, "node", F.coalesce("further", "root").alias("root"))))
    named = _renamed(every.withColumns({"from": F.col("src"), "to": F.col("dst")}), of, "from", "to").where("src = dst").select(P, F.col("src").alias("own"), F.col("from").alias("src"), F.col("to").alias("dst"))
    strong = steps.keep(named)
    least = strong.groupBy(P, "own").agg(F.min("src").alias("component"))
    return strong.join(least, [P, "own"]).select(P, "component", "src", "dst")


def contracted(edges: DataFrame, steps: Steps) -> DataFrame:
    """Ways `a` -> `b` between the nodes of components where edges meet or part, with the nodes `inner` between.

    Nodes with one edge in and one out, but for a component's least, are in chains. Each
    finds the start of its chain by pointers that double, so a ring of any length takes
    logarithmic rounds, and a chain is put together once.
    """
    edges = steps.keep(edges)
    out = edges.groupBy(P, "component", F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("dst").alias("next"))
    into = edges.groupBy(P, "component", F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("src").alias("previous"))
    plain = out.join(into, [P, "component", "node"]).where("n_out = 1 AND n_in = 1 AND node <> component").select(P, "component", "node", "next", "previous")
    plain = steps.keep(plain)
    own = plain.select(P, "node")
    direct = edges.join(own.withColumnRenamed("node", "src"), [P, "src"], "left_anti").join(own.withColumnRenamed("node", "dst"), [P, "dst"], "left_anti")
    direct = direct.select(P, "component", F.col("src").alias("a"), F.col("dst").alias("b"), F.array().cast("array<string>").alias("inner"))
    if plain.isEmpty():
        return direct
    # up: the pointer towards the chain's start, far: the nodes that it passes; a start points to itself
    before = own.select(P, F.col("node").alias("previous"), F.lit(True).alias("chained"))
    state = steps.keep(plain.join(before, [P, "previous"], "left").select(P, "node", F.when(F.col("chained"), F.col("previous")).otherwise(F.col("node")).alias("up"), F.when(F.col("chained"), 1).otherwise(0).cast("long").alias("far")))
    while True:
        jump = state.select(P, F.col("node").alias("up"), F.col("up").alias("further"), F.col("far").alias("more"))
        after = steps.keep(state.join(jump, [P, "up"]).select(P, "node", F.col("further").alias("up"), (F.col("far") + F.col("more")).alias("far"), (F.col("more") > 0).alias("moved")))
        state = after.select(P, "node", "up", "far")
        if after.where("moved").isEmpty():
            break
    chains = plain.join(state, [P, "node"]).groupBy(P, "component", "up").agg(F.sort_array(F.collect_list(F.struct("far", "node"))).alias("x"), F.min_by("previous", "far").alias("a"), F.max_by("next", "far").alias("b"))
    return direct.unionByName(chains.select(P, "component", "a", "b", F.col("x.node").alias("inner")))


def from_least(nodes: Column) -> Column:
    """A cycle's nodes, turned so that the least one is first."""
    at = F.array_position(nodes, F.array_min(nodes)).cast("int")
    return F.concat(F.slice(nodes, at, F.size(nodes)), F.slice(nodes, F.lit(1), at - 1))


def simple_cycles(edges: DataFrame, most: int) -> DataFrame:
    """`project_id`, `cycle_id`, `length`, `nodes`: the first `most` simple cycles of each project by length, then by nodes from the least one.

    A cycle is a path from its least meeting node on and a path back to it, of half the
    ways each, that have nothing else in common. Both grow by one join on the node at
    their end; each level of the search is a step. Once a project has `most` cycles,
    paths that could only make longer ones are dropped. The work grows with the paths of
    up to half the last cycle's ways, which may be many where a component has few short
    cycles and many long ones. Null ends and edges from a node to itself are no edges.
    """
    spark = edges.sparkSession
    steps, done = Steps(spark, "cycles"), Steps(spark, "cycles-found")
    edges = edges.select(F.col(P).cast("string").alias(P), "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    # a null project is a project
    edges = edges.select(F.coalesce(F.concat(F.lit("="), P), F.lit("")).alias(P), "src", "dst")
    ways = steps.keep(contracted(strong_edges(edges, steps), steps))
    key = [P, "component", "start"]
    nodes = F.concat(F.array("a"), "inner")
    best = ways.where("a = b").select(P, nodes.alias("nodes"))
    best = steps.keep(_first(best, most))
    ahead = ways.where("b > a").select(P, "component", F.col("a").alias("start"), F.col("b").alias("at"), F.concat(nodes, F.array("b")).alias("path"))
    back = ways.where("a > b").select(P, "component", F.col("b").alias("start"), F.col("a").alias("at"), nodes.alias("path"))
    ahead, turn = steps.keep(ahead), True
    longer, back = ahead, ahead if ahead.isEmpty() else steps.keep(back)
    while not longer.isEmpty():
        other = back.select(*key, "at", F.col("path").alias("rest"))
        met = ahead.join(other, [*key, "at"]).select(P, F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), "rest")
        found = met.where(~F.arrays_overlap("path", "rest")).select(P, F.concat("path", "rest").alias("nodes"))
        best = steps.keep(_first(best.unionByName(found), most))
        full = best.groupBy(P).agg(F.count("*").alias("n"), F.max(F.size("nodes")).alias("bound")).where(F.col("n") >= most).select(P, "bound")
        if turn:
            ahead = longer = steps.keep(_grown(ahead, ways, full, True))
        else:
            back = longer = steps.keep(_grown(back, ways, full, False))
        turn = not turn
    ranked = Window.partitionBy(P).orderBy(F.size("nodes"), "nodes")
    project = F.when(F.col(P) != "", F.substring(P, 2, 1 << 30)).alias(P)
    result = done.keep(best.select(project, F.row_number().over(ranked).cast("int").alias("cycle_id"), F.size("nodes").alias("length"), "nodes"))
    steps.drop()
    return result


def _first(cycles: DataFrame, most: int) -> DataFrame:
    """The first `most` of each project; each task cuts its own before the shuffle."""
    turned = cycles.select(P, from_least(F.col("nodes")).alias("nodes"))
    rank = F.row_number().over(Window.partitionBy(P).orderBy(F.size("nodes"), "nodes"))
    return turned.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def _grown(paths: DataFrame, ways: DataFrame, full: DataFrame, ahead: bool) -> DataFrame:
    """Paths with one way more, to nodes above their start that they don't pass yet, as far as they may still be among the first."""
    end, new = ("a", "b") if ahead else ("b", "a")
    made = paths.join(ways.select(P, "component", F.col(end).alias("at"), F.col(new).alias("new"), "inner"), [P, "component", "at"])
    made = made.where((F.col("new") > F.col("start")) & ~F.array_contains("path", F.col("new")))
    path = F.concat("path", "inner", F.array("new")) if ahead else F.concat(F.array("new"), "inner", "path")
    made = made.select(P, "component", "start", F.col("new").alias("at"), path.alias("path"))
    return made.join(full, P, "left").where("bound IS NULL OR size(path) <= bound").drop("bound")
