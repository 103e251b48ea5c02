"""Connected components of a table of links, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mark, release, stored


def joining_links(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between a's and b's numbers (rows and columns of linked), as many as join what they join: two arrays of ends."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    at, to = place[: len(a)], place[len(a) :]
    low = np.arange(len(names))  # the least number that each is known to reach
    while len(a) and len(b):
        before = low.copy()
        np.minimum.at(low, at, np.where(linked, low[to], len(names)).min(1))
        np.minimum.at(low, to, np.where(linked.T, low[at], len(names)).min(1))
        if (low == before).all():
            break
    tied = np.flatnonzero(low != np.arange(len(names)))
    return names[low[tied]], names[tied]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for each node with a link to another, the smallest node that it reaches.

    A round points each node to its smallest neighbour if that is smaller, follows the pointers twice, and replaces
    the ends of the links by where they lead; links within one node go. Their number falls by a factor in each round.
    Joins have a unique side, so that AQE can split the other where one node has many links. Each round's tables go to
    the shared folder, so no lineage grows and a lost executor costs one round at most; those before are deleted.
    """
    before = mark()
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    edges = stored(links.select(*pair(F.col(a), F.col(b))).filter("a <> b").distinct(), "links")
    roots = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        hooks = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("to"))
        hooks = stored(hooks, "hooks")
        for _ in range(2):
            then = hooks.select(F.col("n").alias("to"), F.col("to").alias("next"))
            hooks = hooks.join(then, "to").select("n", F.col("next").alias("to"))
        hooks = stored(hooks, "hooks")
        roots = roots.join(hooks, roots.root == hooks.n, "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = stored(roots, "roots")
        left = hooks.select(F.col("n").alias("a"), F.col("to").alias("x"))
        right = hooks.select(F.col("n").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").filter("x <> y")
        edges = stored(moved.select(*pair(F.col("x"), F.col("y"))).distinct(), "links")
        release(before, edges, roots)
    return roots
