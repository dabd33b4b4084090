"""Connected components of an edge table, by contraction.

In each round every node points at its smallest neighbour (or itself), pointers are followed to their ends by
doubling, nodes are replaced by these ends, and edges within one node go. Every node with an edge left is gone or has taken
one in, so the nodes at least halve in each round, also on long paths. The smallest node of a component never
moves, so it ends as the component's label.
Every step is a partial aggregation or an equi-join; nothing is collected but the number of edges left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.session import free, materialize

MAX_ROUNDS = 60


def _ends(start: DataFrame) -> DataFrame:
    """Pointers (node, to) followed to the nodes that point at themselves."""
    to = start
    while True:
        pointers = to.select("node", "to")
        following = to.select(F.col("node").alias("to"), F.col("to").alias("end"))
        moved = (F.col("end") != F.col("to")).alias("moved")
        onward = materialize(pointers.join(following, "to").select("node", F.col("end").alias("to"), moved), "ends")
        free(to)
        to = onward
        if onward.where("moved").isEmpty():
            return to


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    for r in range(MAX_ROUNDS):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        to = _ends(materialize(to, f"pointers{r}"))
        ends = to.select("node", "to")
        old_edges, old_labels = e, labels
        x, y = (ends.select(F.col("node").alias(k), F.col("to").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        left = e.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        e = materialize(left.distinct(), f"edges{r}")
        free(old_edges)
        if labels is None:
            labels = to
        else:
            following = ends.select(F.col("node").alias("to"), F.col("to").alias("next"))
            onward = labels.select("node", "to").join(following, "to", "left")
            labels = materialize(onward.select("node", F.coalesce("next", "to").alias("to")), f"labels{r}")
            free(old_labels, to)
    else:
        raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
    if labels is None:
        kind = e.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    free(e)
    return labels.select("node", F.col("to").alias("component"))
