"""Connected components by contraction, all in DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.tables import cut


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); nodes of one component have the same root, one of them.

    Each round maps a node to the smallest of itself and its neighbours and contracts the edges. Node ids are
    digests, so their order is random and a round takes away a constant share of the nodes; stars end in one. Every round
    is written, and the maps are composed at the end. Empty edges give an empty result."""
    edges, maps = cut(_canonical(edges), "edges"), []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "step")
        maps.append(step)
        first = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        second = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = cut(_canonical(edges.join(first, "a").join(second, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def composed(later: DataFrame, earlier: DataFrame) -> DataFrame:
        onward = later.select(F.col("node").alias("root"), F.col("root").alias("end"))
        return earlier.join(onward, "root", "left").select("node", F.coalesce("end", "root").alias("root"))

    return reduce(composed, reversed(maps))
