"""Connected components of a graph too large for one machine, by randomised contraction.

Each round gives every node a name: the node of its closed neighbourhood that comes first in a seeded random order.
Renaming both ends of every edge keeps the components, since the edge from a node to its name becomes an edge between
the two names; loops go.  The random order is drawn anew each round, so the edges shrink by a constant factor in
expectation, whatever the shape of the graph (a chain in id order included).  Every round's names and edges are written
to the shared folder, so no task ever holds a component, lineage stays one round long, and the joins read two plain
tables, which adaptive execution can split where one node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mark, stored, sweep


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the same within a component, and one of its nodes.

    Null ends and loops are ignored (a node with loops alone does not appear); repeated edges count once.  An empty
    table gives an empty result.
    """
    spark = edges.sparkSession
    names: list[DataFrame] = []
    now = stored(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for round_ in range(most_rounds):
        if now.isEmpty():
            break
        both = now.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(now.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(round_)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        first = both.groupBy("node").agg(F.min(order("near")).alias("m"))
        name = stored(first.select("node", F.least("m", order("node"))["v"].alias("name")), "names")
        names.append(name)
        moved = (
            now.join(name.select(F.col("node").alias("a"), F.col("name").alias("na")), "a")
            .join(name.select(F.col("node").alias("b"), F.col("name").alias("nb")), "b")
            .where("na <> nb")
            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
            .distinct()
        )
        since = mark() - 2  # the edges and names of this round
        now = stored(moved, "edges")
        sweep(spark, since, now, name)
    else:
        raise RuntimeError("the contraction did not end")
    if not names:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    at = names[0].select("node", F.col("name").alias("root"))
    for name in names[1:]:
        at = at.join(name.select(F.col("node").alias("root"), F.col("name").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return at
