"""Connected components by contraction, with nothing but joins and aggregations over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b).

    Each round puts the nodes into a random order of its own, hooks every node to the first of itself and its neighbours,
    follows the hooks three times more, and contracts. The first of their neighbourhoods stay, at most half of the nodes of
    an edge, and in a random order chains of hooks are short, so the rounds are logarithmic in the nodes. Edges stay
    distributed; the driver sees one row a round. A node with very many neighbours is one row a task in the
    aggregation, and in the joins a key that Spark's skew join splits."""
    edges = stored(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    at: DataFrame | None = None
    salt = 0
    while edges.head(1):
        salt += 1
        place = lambda c: F.xxhash64(F.lit(salt), c)  # noqa: E731, B023
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        hooked = both.groupBy("node").agg(F.min_by("to", place(F.col("to"))).alias("low"))
        parent = stored(hooked.select("node", F.when(place(F.col("low")) < place(F.col("node")), F.col("low")).otherwise(F.col("node")).alias("parent")), "hooks")
        for _ in range(2):
            parent = jumped(parent)
        parent = stored(parent, "parents")
        moved = renamed(renamed(edges, "a", parent), "b", parent).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = stored(moved.distinct(), "edges")
        if at is None:
            at = parent.withColumnRenamed("parent", "component")
        else:
            at = stored(renamed(at, "component", parent), "labels")
    if at is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = at.groupBy("component").agg(F.min("node").alias("least"))
    return stored(at.join(least, "component").select("node", F.col("least").alias("component")), "components")


def jumped(parent: DataFrame) -> DataFrame:
    """Every hook followed once more."""
    step = parent.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
    return parent.join(step, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"))


def renamed(rows: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """rows with the parents of the nodes in a column, which itself stays where a node has none."""
    step = parent.select(F.col("node").alias(column), F.col("parent").alias("next"))
    name: list[Column] = [F.coalesce("next", column).alias(column) if c == column else F.col(c) for c in rows.columns]
    return rows.join(step, column, "left").select(*name)
