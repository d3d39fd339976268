"""Graph tables: vocabulary statistics and ids, encoding with higher-order functions, path tuples, size percentiles.

A graph is struct<tags, symbols, edges: array<struct<src, dst, type>>>; all of this stays in expressions over arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bound, number_bucket
from ..schema import MAX_GRAPH_NODES

# Fixed vocabularies of edge types, in id order.
SLT_EDGES = ("next", "sup", "sub", "presup", "presub", "over", "under", "above", "below", "within", "index", "row", "cell")
OPT_EDGES = ("op", "arg", "arg1", "arg2", "arg3", "arg4", "argN", "bvar", "lowlimit", "uplimit", "degree", "condition", "domainofapplication", "logbase", "momentabout")
SPECIAL_TAGS = ("<pad>", "<unk>")
SPECIAL_SYMBOLS = ("<pad>", "<unk>", "<none>", "<int1>", "<int2>", "<int3>", "<int4>", "<int5>", "<decimal>", "<number>")
LIMITS = (32, 64, 128, 256, 512)
QUANTILES = (0.5, 0.9, 0.99, 0.999)


def size_of(graph: str) -> Column:
    return F.coalesce(F.greatest(F.size(f"{graph}.tags"), F.lit(0)), F.lit(0))


def histogram(graphs: DataFrame, graph: str, what: str) -> DataFrame:
    """(token, n) of 'tags', 'symbols' (the non-empty ones) or 'edges' (types)."""
    values = F.transform(f"{graph}.edges", lambda e: e["type"]) if what == "edges" else F.col(f"{graph}.{what}")
    return graphs.select(F.explode(values).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def status(graphs: DataFrame, xml: str, graph: str) -> DataFrame:
    """Counts of missing, unparseable_or_empty and ok."""
    s = F.when(F.col(xml).isNull(), "missing").when(F.col(graph).isNull(), "unparseable_or_empty").otherwise("ok")
    return graphs.groupBy(s.alias("status")).agg(F.count("*").alias("n"))


def percentiles(values: DataFrame, column: str, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Nearest-rank percentiles: the smallest value whose cumulative count reaches q of the total.

    The window runs over distinct values, not rows."""
    counts = values.groupBy(column).agg(F.count("*").alias("n"))
    run = counts.withColumn("cum", F.sum("n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    rows = run.select(column, "cum", "total", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q"))
    return rows.where(F.col("cum") >= F.col("q") * F.col("total")).groupBy("q").agg(F.min(column).alias("value"))


def over_limits(values: DataFrame, column: str, limits: Sequence[int] = LIMITS) -> DataFrame:
    return values.agg(*[F.count_if(F.col(column) > n).alias(f"over_{n}") for n in limits], F.max(column).alias("largest"), F.count("*").alias("total"))


def vocabulary(counts: DataFrame, least: int = 5, special: Sequence[str] = SPECIAL_SYMBOLS) -> DataFrame:
    """(token, id): the special entries first, then tokens of at least ``least`` occurrences in code-point order.

    Tokens are numbered within those of the same first two characters, after all that begin with less: only the counts of
    such beginnings, in every alphabet some thousands, meet in one task."""
    kept = counts.where(F.col("n") >= least).select("token", F.substring("token", 1, 2).alias("head"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = kept.groupBy("head").agg(F.count("*").alias("n")).select("head", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("head").orderBy("token"))
    own = kept.withColumn("place", place).join(heads, "head").select("token", (F.col("before") + F.col("place") - 1 + len(special)).cast("int").alias("id"))
    return own.unionByName(own.sparkSession.createDataFrame([(t, i) for i, t in enumerate(special)], "token string, id int"))


def coverage(counts: DataFrame, least: int = 5) -> DataFrame:
    """Share of symbol occurrences that a vocabulary keeps."""
    return counts.agg((F.sum(F.when(F.col("n") >= least, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"), F.count_if(F.col("n") >= least).alias("kept"), F.count("*").alias("types"))


def symbol_id(table: Column, tag: Column, symbol: Column) -> Column:
    """none for no symbol, its id, the number bucket of an unknown number, unknown."""
    at = lambda key: F.try_element_at(table, key)
    number = F.when(tag.isin("mn", "cn"), at(number_bucket(symbol)))
    return F.when(F.coalesce(symbol, F.lit("")) == "", at(F.lit("<none>"))).otherwise(F.coalesce(at(symbol), number, at(F.lit("<unk>"))))


def as_map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def encode(graph: Column, tags: Column, symbols: Column, edge_types: Sequence[str], max_nodes: int = MAX_GRAPH_NODES, both_ways: bool = True) -> Column:
    """Ids of the first max_nodes nodes (0: all) and the edges between them; both_ways appends each edge reversed, with
    its type moved up by the number of types."""
    size = F.size(graph["tags"])
    n = F.least(size, F.lit(max_nodes)) if max_nodes > 0 else size
    types = as_map({t: i for i, t in enumerate(edge_types)})
    cut_tags, cut_symbols = F.slice(graph["tags"], F.lit(1), n), F.slice(graph["symbols"], F.lit(1), n)
    edges = F.filter(graph["edges"], lambda e: (e["src"] < n) & (e["dst"] < n))
    edge = lambda s, d, t: F.struct(s.alias("src"), d.alias("dst"), t.cast("int").alias("type"))
    forward = F.transform(edges, lambda e: edge(e["src"], e["dst"], F.element_at(types, e["type"])))
    backward = F.transform(edges, lambda e: edge(e["dst"], e["src"], F.element_at(types, e["type"]) + len(edge_types)))
    return F.when(
        graph.isNotNull(),
        F.struct(
            F.transform(cut_tags, lambda t: F.coalesce(F.try_element_at(tags, t), F.try_element_at(tags, F.lit("<unk>")))).alias("tag"),
            F.zip_with(cut_tags, cut_symbols, lambda t, s: symbol_id(symbols, t, s)).alias("symbol"),
            (F.concat(forward, backward) if both_ways else forward).alias("edges"),
            (size > n).alias("truncated"),
        ),
    )


def reverse_edges(edges: Column, n_types: int) -> Column:
    """Forward edges followed by their reverses, the direction the network needs at batch time."""
    return F.concat(edges, F.transform(edges, lambda e: F.struct(e["dst"].alias("src"), e["src"].alias("dst"), (e["type"] + n_types).alias("type"))))


def describe(graph: Column) -> Column:
    """'x -sup-> 2' for each edge, or the nodes' names where there is none."""
    name = F.zip_with(graph["tags"], graph["symbols"], lambda t, s: F.when(s == "", t).otherwise(s))
    lines = lambda names: F.transform(graph["edges"], lambda e: F.concat(F.get(names, e["src"]), F.lit(" -"), e["type"], F.lit("-> "), F.get(names, e["dst"])))
    return F.when(F.size(graph["edges"]) > 0, bound(name, lines)).otherwise(name)


def two_edge_paths(edges: DataFrame, key: str | None = None) -> DataFrame:
    """(a, t1, b, t2, c) by self-join of an edge table (src, dst, type), within key where given."""
    on = [key] if key else []
    first = edges.select(*on, F.col("src").alias("a"), F.col("type").alias("t1"), F.col("dst").alias("b"))
    second = edges.select(*on, F.col("src").alias("b"), F.col("type").alias("t2"), F.col("dst").alias("c"))
    return first.join(second, [*on, "b"])


def three_edge_paths(edges: DataFrame, key: str | None = None) -> DataFrame:
    on = [key] if key else []
    third = edges.select(*on, F.col("src").alias("c"), F.col("type").alias("t3"), F.col("dst").alias("d"))
    return two_edge_paths(edges, key).join(third, [*on, "c"])
