"""Reachability, shortest paths, strongly connected components and fixpoints as iterative joins (G family)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from plumbline.sources.shared import discard, materialize

COMPACT = 8  # rounds after which the tables of what was seen become one


class Seen:
    """What the rounds have found, in few tables: every COMPACT rounds these become one."""

    def __init__(self, first: DataFrame, name: str):
        self.name = name
        self.rows, path = materialize(first, name)
        self.paths, self.before = [path], []

    def add(self, new: DataFrame) -> DataFrame:
        """Stores new rows and returns them as stored."""
        stored, path = materialize(new, self.name)
        discard(stored.sparkSession, *self.before)  # the frontiers that a table of all has replaced
        self.before = []
        self.rows = self.rows.unionByName(stored)
        self.paths.append(path)
        if len(self.paths) > COMPACT:
            self.rows, whole = materialize(self.rows, self.name)
            self.before, self.paths = self.paths, [whole]
        return stored


def shortest_paths(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., node, depth, path): one shortest path from the starts to each node that can be reached, ties to the least.

    edges(src, dst, ord), starts(by..., node[, path]): rows of different `by` are different searches; path, if given, stands for
    the way to a start. Breadth first: each round joins the frontier to the edges, keeps one path
    for each new node with partial minima, and drops nodes seen before by an anti-join. Rounds follow the depth;
    each is written to the shared folder, which cuts lineage.
    """
    keys = [*by, "node"]
    way = F.col("path") if "path" in starts.columns else F.array("node")
    seen = Seen(starts.select(*keys, way.alias("path")).groupBy(*keys).agg(F.min("path").alias("path")).select(*keys, F.lit(0).alias("depth"), "path"), "seen")
    frontier, depth = seen.rows, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        steps = frontier.join(edges.select(F.col("src").alias("node"), "dst", "ord"), "node")
        new = steps.groupBy(*by, "dst").agg(F.min(F.struct("path", "ord")).alias("m")).select(*by, F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.concat("m.path", F.array("dst")).alias("path"))
        frontier = seen.add(new.join(seen.rows.select(*keys), keys, "left_anti"))
        if frontier.isEmpty():
            break
    return seen.rows


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The least set that holds the seed and is closed under step: each round steps from the new rows only."""
    seen = Seen(seed.distinct(), "fixpoint")
    new = seen.rows
    while not new.isEmpty():
        new = seen.add(step(new).distinct().join(seen.rows, seen.rows.columns, "left_anti"))
    return seen.rows


def _trim(edges: DataFrame) -> DataFrame:
    """Edges without those at nodes that nothing enters or nothing leaves: they are on no cycle."""
    edges, path = materialize(edges, "edges")
    n = edges.count()
    while n:
        kept, new = materialize(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "edges")
        discard(edges.sparkSession, path)
        before, edges, path, n = n, kept, new, kept.count()
        if n == before:
            break
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node from which each can be reached, by minima along the edges until nothing changes."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    now, path = materialize(nodes.select("node", F.col("node").alias("colour")), "colours")
    while True:
        come = edges.join(now, edges.src == now.node).select(F.col("dst").alias("node"), "colour")
        new, new_path = materialize(now.unionByName(come).groupBy("node").agg(F.min("colour").alias("colour")), "colours")
        same = new.join(now, ["node", "colour"], "left_anti").isEmpty()
        discard(edges.sparkSession, path)
        now, path = new, new_path
        if same:
            return now


def cycles(edges: DataFrame) -> DataFrame:
    """(component, node) of nodes on a cycle; component is its least node. A self-loop is a cycle of one.

    Edges on no cycle are trimmed; then each node gets the least node that reaches it as its colour, and what reaches a colour's
    own node inside the colour is that node's component. Those nodes go, and the rest has another round. No closure is formed.
    """
    rest = _trim(edges.select("src", "dst").distinct())
    found = None
    while not rest.isEmpty():
        colour = _colours(rest)
        of = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))  # noqa: B023, E731
        inside, inside_path = materialize(rest.join(of("src"), "src").join(of("dst"), "dst").filter("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("component")), "inside")
        roots = inside.select("component", F.col("component").alias("node")).distinct()
        back = fixpoint(roots, lambda new: new.join(inside.select("component", F.col("dst").alias("node"), "src"), ["component", "node"]).select("component", F.col("src").alias("node")))  # noqa: B023
        round_, _ = materialize(back.join(_closed(inside, back), "component", "left_semi"), "components")
        found = round_ if found is None else found.unionByName(round_)
        gone = back.select("node").distinct()
        rest = _trim(rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        discard(edges.sparkSession, inside_path)
    return found if found is not None else edges.select(F.col("src").alias("component"), F.col("src").alias("node")).limit(0)


def _closed(inside: DataFrame, members: DataFrame) -> DataFrame:
    """Components that an edge between their members closes: of more than one node, or of one with an edge to itself."""
    at = lambda end: members.select("component", F.col("node").alias(end))
    return inside.join(at("src"), ["component", "src"], "left_semi").join(at("dst"), ["component", "dst"], "left_semi").select("component").distinct()


def witnesses(edges: DataFrame) -> DataFrame:
    """(component, cycle) of each component of `cycles`: from its least node over that node's least other neighbour inside back to it."""
    inside = cycles(edges)
    at = lambda end: inside.select("component", F.col("node").alias(end))
    own, _ = materialize(edges.select("src", "dst").distinct().join(at("src"), "src").join(at("dst"), ["component", "dst"]).select("component", "src", "dst", F.lit(0).alias("ord")), "cycle-edges")
    first = own.filter("src = component and dst <> component").groupBy("component").agg(F.min("dst").alias("node"))
    back = shortest_paths(own, first, by=("component",)).filter("node = component").select("component", F.concat(F.array("component"), "path").alias("cycle"))
    alone = inside.join(first, "component", "left_anti").select("component", F.array("component", "component").alias("cycle"))
    return back.unionByName(alone)
