"""Connected components by contraction, with DataFrame operations only.

Every round each node that has a smaller neighbour hooks on to its smallest one;
pointer jumping then flattens the trees, and the edges are rewritten between roots.
Each node with an edge hooks or is hooked on to, so the number of nodes at least
halves from round to round. No label, edge or component comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_written, discard, written


def flattened(parent: DataFrame) -> DataFrame:
    """parent: written (node, root) trees, which are discarded. The same with all nodes on their tree's root, which has no row; a written table."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        jumped = written(jumped, "trees")
        discard(parent)
        if jumped.filter("moved").isEmpty():
            return jumped
        parent = jumped


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). A written table of rows (node, root) for each node but its component's smallest, which is the root."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min("b").alias("root")).filter("root < a").select(F.col("a").alias("node"), "root")
        tree = flattened(written(hooked, "trees"))
        if roots is None:
            roots = tree  # not discarded until it is superseded
        else:
            moved, before = tree.select(F.col("node").alias("root"), F.col("root").alias("above")), roots
            roots = written(roots.join(moved, "root", "left").select("node", F.coalesce("above", "root").alias("root")).union(tree.select("node", "root")), "roots")
        a = tree.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = tree.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        led = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        past, edges = edges, written(led.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        discard(past)
        if roots is not tree:
            discard(before, tree)
    if roots is None:
        return as_written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), edges)
    discard(edges)
    return as_written(roots.select("node", "root"), roots)
