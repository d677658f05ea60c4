"""Connected components over a table of edges, without bringing any of it to the driver.

Each round hooks every node to its smallest neighbour, follows the hooks one
step, and contracts the edges to what the nodes hang on. Edges inside a
component vanish; the rounds needed grow with the logarithm of the longest
path. A node with very many neighbours is only ever a key of a minimum, which is
taken before the shuffle, or the side of a join that Spark can split.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, component): the smallest node of the component, for every node with an edge."""
    left = materialize(_ordered(edges.select(F.col("a").alias("a"), F.col("b").alias("b"))), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        hooks = materialize(hooks, "hooks")  # so that both sides of the join below are dealt out for it alone, and a hub's side can be split
        further = hooks.select(F.col("node").alias("up"), F.col("up").alias("above"))
        hooks = materialize(hooks.join(further, "up", "left").select("node", F.coalesce("above", "up").alias("up")), "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("up").alias("component"))
        else:
            step = hooks.select(F.col("node").alias("component"), "up")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
            labels = materialize(labels, "labels")
        a, b = hooks.select(F.col("node").alias("a"), F.col("up").alias("ua")), hooks.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        left = materialize(_ordered(left.join(a, "a").join(b, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b"))), "edges")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
