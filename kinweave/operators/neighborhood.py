"""A path with the neighbours that touch it most, within a budget of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import counted
from .paths import Graph, path_edges

#: Nodes up to which a set of them is broadcast.
FEW = 100_000


def candidates(graph: Graph, path: DataFrame) -> DataFrame:
    """(id, connections, sim) of every neighbour of the path.

    connections: path nodes it touches, in either's lists; sim: the largest similarity among
    its own lists' entries and, for each path node, the first entry of that node's lists.
    """
    on = path.select(F.col("id").alias("p"))
    is_on = F.broadcast(path.select(F.col("id").alias("n")))  # a path: no longer than the budget
    own = lambda v: v.join(F.broadcast(on), F.col("src") == F.col("p")).select("p", F.col("dst").alias("n"), F.col("sim").cast("double").alias("sim"))
    back = lambda v: v.join(F.broadcast(on), F.col("dst") == F.col("p")).select("p", F.col("src").alias("n"), F.col("sim").cast("double").alias("sim"))
    ahead = own(graph.forward)
    behind = own(graph.reverse).join(ahead.select("p", "n"), ["p", "n"], "left_anti")
    mine = ahead.unionByName(behind)
    near = mine.select("n").distinct()
    theirs = back(graph.forward).unionByName(back(graph.reverse)).join(near, "n", "left_semi")
    touched = mine.unionByName(theirs).join(is_on, "n", "left_anti")
    return touched.groupBy(F.col("n").alias("id")).agg(F.count_distinct("p").alias("connections"), F.max("sim").alias("sim"))


def path_neighborhood(graph: Graph, path: DataFrame, budget: int) -> DataFrame:
    """(id, similarity, layer) of the path (layer: step) and of the added neighbours (layer: length of the path)."""
    length = path.count()
    own = path.select("id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.col("step").alias("layer"))
    if budget <= length:
        return own
    added = candidates(graph, path).orderBy(F.col("connections").desc(), F.col("sim").desc(), "id").limit(budget - length)
    return own.unionByName(added.select("id", F.col("sim").alias("similarity"), F.lit(length).alias("layer")))


def neighborhood_edges(graph: Graph, path: DataFrame, nodes: DataFrame, directed: bool = False) -> DataFrame:
    """(from, to, similarity): path edges, then entries of forward and reverse lists among the nodes.

    One edge for each (from, to), from the first of these three that has it; the reverse of a path edge is
    left out. A reverse-list entry of x is given as an edge from x; with `directed` a column `direction`
    tells "out" from "in".
    """
    steps = path_edges(path)
    ids, n = counted(nodes.select("id"), "nodes")
    small = F.broadcast if n <= FEW else (lambda x: x)  # as many as the budget says
    inner = lambda v: v.where("src != dst").join(small(ids.select(F.col("id").alias("src"))), "src", "left_semi").join(small(ids.select(F.col("id").alias("dst"))), "dst", "left_semi")
    parts = [steps.select("src", "dst", F.col("sim").cast("double").alias("sim"), F.lit(0).alias("prio"))]
    undone = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    for k, v in ((1, graph.forward), (2, graph.reverse)):
        parts.append(inner(v).join(F.broadcast(undone), ["src", "dst"], "left_anti").select("src", "dst", F.col("sim").cast("double").alias("sim"), F.lit(k).alias("prio")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = every.groupBy("src", "dst").agg(F.min(F.struct("prio", (-F.col("sim")).alias("o"))).alias("m"))
    out = best.select(F.col("src").alias("from"), F.col("dst").alias("to"), (-F.col("m.o")).alias("similarity"), F.when(F.col("m.prio") == 2, "in").otherwise("out").alias("direction"))
    return out if directed else out.drop("direction")


def path_status(path: DataFrame, budget: int) -> DataFrame:
    """One row: status (success, path_too_long, no_path), path_length and minimum_budget_needed."""
    n = path.agg(F.count("*").cast("int").alias("n"))
    long = F.col("n") > budget
    return n.select(
        F.when(F.col("n") == 0, "no_path").when(long, "path_too_long").otherwise("success").alias("status"),
        F.when(F.col("n") > 0, F.col("n")).alias("path_length"),
        F.when(long, F.col("n")).alias("minimum_budget_needed"),
    )
