"""Connected components by alternating large-star and small-star, as joins and
pre-aggregated groups; each round's edges are a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf


#: So many rows of a table of ids are sent to all executors; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def small(table: DataFrame, n: int) -> DataFrame:
    """table, of n rows at most, for the side of a join that is sent to all tasks if it is small."""
    return F.broadcast(table) if n <= BROADCAST_IDS else table


def _minima(edges: DataFrame) -> DataFrame:
    """(node, component, high) of edges (u, v), v < u: the least and the greatest of the labels that a
    node has, which are its neighbours below and, if it has one above, itself."""
    labels = edges.select(F.col("u").alias("node"), "v").union(edges.select("v", "v"))
    return labels.groupBy("node").agg(F.min("v").alias("component"), F.max("v").alias("high"))


def components(edges: DataFrame, shelf: Shelf, name: str = "cc") -> DataFrame:
    """edges (a long, b long) -> (node, component), a table: for each node with an edge to
    another node, the least node reachable.

    Self-loops, repeated and null-ended edges count for nothing; no edges: no rows.
    The large star links each node above v to the least node around v, v included; the small star
    links u and its neighbours below u to the least of them. Both minima are pre-aggregated, so a
    hub's neighbours are never gathered, and those of a round's result are the next one's large
    stars. No round has more edges than the one before; all is done when each node has one label.
    Rounds grow with the logarithm of the number of nodes."""
    now = shelf.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a != b"), f"{name}0")
    for k in range(1, 100):
        around = shelf.put(_minima(now), f"{name}_minima{k}")
        n, several = around.agg(F.count("*"), F.count_if(F.col("component") != F.col("high"))).first()
        shelf.drop(f"{name}_minima{k - 1}")
        if not several:
            break
        large = now.join(small(around.select(F.col("node").alias("v"), "component"), n), "v")
        down = shelf.put(large.select("u", F.col("component").alias("v")), f"{name}_down{k}")
        least = shelf.put(down.groupBy("u").agg(F.min("v").alias("m")), f"{name}_least{k}")
        moved = down.join(small(least, n), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = shelf.put(moved.union(least.select("u", F.col("m").alias("v"))), f"{name}{k}")
        shelf.drop(f"{name}{k - 1}", f"{name}_down{k}", f"{name}_least{k}")
    shelf.drop(f"{name}{k - 1}")
    return around.select("node", "component")


def joined(found: DataFrame, edges: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """The table (node, component) after further edges (a, b): only the edges between components are
    searched, from label to label."""
    n = found.count()
    ends = edges
    for c in ("a", "b"):
        label = small(found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label")), n)
        ends = ends.join(label, c, "left")
    ends = ends.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    more = components(ends, shelf, name)
    m = more.count()
    label = small(more.select(F.col("node").alias("component"), F.col("component").alias("label")), m)
    old = found.join(label, "component", "left").select("node", F.coalesce("label", "component").alias("component"))
    return shelf.put(old.union(more.join(small(found.select("node"), n), "node", "left_anti")), f"{name}_joined")
