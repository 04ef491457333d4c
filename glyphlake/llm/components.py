"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is two joins or aggregations over the edge table, written to the shared folder; the driver sees only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphlake.llm.common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
    linked = down.join(least, F.col("a") == F.col("c"))
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame, ws: Workspace, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)``, a <> b, in any direction -> ``(node, component)`` for every node with an edge but the least of each component.

    ``component`` is the least node that is reachable. Ends when a round changes nothing.
    """
    state = ws.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        after = ws.save(_small_star(_large_star(state)).distinct(), "star")
        row = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        ws.drop(state)
        state = after
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
