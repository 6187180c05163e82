"""Connected components of a link table: least-neighbour hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.session import discard, written


def _flat(parents: DataFrame) -> DataFrame:
    """parents (node, root), each root a smaller node or the node itself, with every path cut to its end."""
    while True:
        ends = parents.select(F.col("node").alias("root"), F.col("root").alias("end"))
        jumped = written(parents.select("node", "root").join(ends, "root").select("node", F.col("root").alias("was"), F.col("end").alias("root")), "labels")
        discard(parents)
        if jumped.where("was <> root").isEmpty():
            return jumped
        parents = jumped


def connected(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component), for every node that has a link.

    Rows: null ends are ignored, repeated links and links of a node with itself change nothing; an empty table gives no rows.

    Each round hooks every node to its least neighbour, if that is smaller, follows these hooks to their ends by pointer jumping,
    and contracts the links to links between ends. A node that stays its own root was hooked to by a neighbour, so a round leaves
    half of the nodes at most, and the jumps double the distance: rounds and jumps grow with the logarithm of the number of nodes
    and of the longest path. Tables of a round are written to the shared folder and deleted when the next ones stand; only whether
    anything is left reaches the driver. Neighbours are reduced per task before they are shuffled.
    """
    a, b = links.columns[:2]
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    edges = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while True:
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("other")).union(edges.select("a", "b"))
        hooked = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "labels")
        flat = _flat(hooked)
        if roots is None:
            roots = written(flat.select("node", "root"), "roots")
        else:
            moved = flat.select(F.col("node").alias("root"), F.col("root").alias("next"))
            further = roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            roots, old = written(further, "roots"), roots
            discard(old)
        new_a, new_b = (flat.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        moved = edges.join(new_a, "a").join(new_b, "b").where("root_a <> root_b")
        less = moved.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct()
        edges, old = written(less, "edges"), edges
        discard(old, flat)
        if edges.isEmpty():
            discard(edges)
            return roots


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) of some links, as `connected` gives them, with more links (a, b): the same as of all links together."""
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    rooted = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    rooted = written(rooted.select("a", "b", *(F.coalesce(f"root_{x}", x).alias(f"root_{x}") for x in "ab")), "rooted-links")
    moved = connected(rooted.select("root_a", "root_b")).toDF("root", "next")
    nodes = rooted.select(F.col("a").alias("node")).union(rooted.select("b")).distinct().join(roots, "node", "left_anti")
    both = roots.select("node", "root").union(nodes.select("node", F.col("node").alias("root")))
    out = written(both.join(moved, "root", "left").select("node", F.least("root", "next").alias("root")), "roots")
    discard(rooted)
    return out
