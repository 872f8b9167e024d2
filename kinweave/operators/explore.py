"""Neighbourhoods of one entity within a budget of nodes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import layer_of
from ..store import Growing
from .paths import _ids, distances
from .small import LOCAL_EDGES, frame, small


def induced_view(view: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of the view between nodes, without loops: (from, to, similarity)."""
    inner = view.where("src != dst").join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return inner.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("sim").alias("similarity"))


def explore_hops(view: DataFrame, owners: DataFrame, center, budget: int, local: bool = False) -> DataFrame:
    """(id, similarity, layer, ord): the first `budget` nodes in order of discovery.

    The order is (layer, place of the discoverer, rank in its list); only nodes with a list of their own,
    owners(id), are discovered. The centre is always there. Each level is cut to what the budget
    still allows before it is numbered, so no task sees more rows than the budget.
    """
    spark = view.sparkSession
    held = small(view, local)
    if held is not None and owners.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        rows = held.explore(center, budget, {r["id"] for r in owners.select("id").collect()})
        return frame(spark, rows, ["id", "similarity", "layer", "ord"], [held.kind, pa.float64(), pa.int32(), pa.int64()])
    nodes = Growing(spark, "explored")
    frontier, found = nodes.add(_ids(spark, view, center).select("id", F.lit(1.0).alias("similarity"), F.lit(0).alias("layer"), F.lit(0).cast("long").alias("ord")))
    layer = 0
    while found < budget:
        layer += 1
        reached = view.join(frontier.select(F.col("id").alias("src"), F.col("ord").alias("parent")), "src")
        reached = reached.join(nodes.all().select(F.col("id").alias("dst")), "dst", "left_anti").join(owners.select(F.col("id").alias("dst")), "dst", "left_semi")
        first = reached.groupBy("dst").agg(F.min(F.struct("parent", "rk", F.col("sim").cast("double").alias("sim"))).alias("m"))
        cut = first.select(F.col("dst").alias("id"), F.col("m.sim").alias("similarity"), F.col("m.parent"), F.col("m.rk")).orderBy("parent", "rk").limit(budget - found)
        numbered = cut.withColumn("ord", F.row_number().over(Window.orderBy("parent", "rk")) + F.lit(found - 1))
        frontier, n = nodes.add(numbered.select("id", "similarity", F.lit(layer).alias("layer"), F.col("ord").cast("long")))
        if not n:
            break
        found += n
    return nodes.all()


def explore_weighted(view: DataFrame, center, budget: int, local: bool = False) -> DataFrame:
    """(id, similarity, layer): the `budget` nearest nodes by summed 1 - similarity; budget 0 is empty."""
    start = _ids(view.sparkSession, view, center)
    if budget <= 0:
        near = start.select("id", F.lit(0).cast("long").alias("c")).limit(0)
    else:
        near = distances(view, start, nearest=budget, local=local).orderBy("c", "id").limit(budget)
    same = F.col("id") == F.lit(center)
    return near.select("id", F.round(F.lit(1.0) - F.col("c") / 1_000_000_000, 9).alias("similarity"), F.when(same, 0).otherwise(layer_of(F.col("c"))).alias("layer"))


def flip(edges: DataFrame) -> DataFrame:
    """Reverse exploration returns its edges the way they point in the graph."""
    return edges.select(F.col("to").alias("from"), F.col("from").alias("to"), "similarity")


def with_names(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes with name and URL; those without an entity drop out."""
    return nodes.join(entities.select("id", "name", "url"), "id")
