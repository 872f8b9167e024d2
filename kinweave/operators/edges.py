"""Views of the edge table (src, dst, sim, and pos where the order of a list matters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import tasks, with_row


def at_least(sim: Column, least: float, kind: str) -> Column:
    """Inclusive threshold; the literal takes the column's type, or 0.7 as a float would fall below 0.7."""
    return (sim >= F.lit(least).cast(kind)) & ~F.isnan(sim)


def top_edges(edges: DataFrame, min_sim: float = 0.0, top_n: int = 80) -> DataFrame:
    """The strongest top_n edges of each source among those with sim >= min_sim, with their rank `rk`.

    min_sim 0 filters nothing. Ties go by pos if there is one, else by dst. Edges with a column `place` (rank in the
    whole list, by sim and dst) are cut where they lie, as a threshold takes the head of a list; others are shuffled once,
    into partitions whose number follows that of the edges.
    """
    kind = edges.schema["sim"].dataType.simpleString()
    kept = edges.where(at_least(F.col("sim"), min_sim, kind)) if min_sim > 0 else edges
    if "place" in edges.columns:
        return kept.where(F.col("place") <= top_n).withColumnRenamed("place", "rk")
    kept = kept.repartition(tasks(edges.sparkSession, edges.count()), "src")
    w = Window.partitionBy("src").orderBy(F.col("sim").desc(), F.col("pos" if "pos" in edges.columns else "dst"))
    return kept.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top_n)


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim")


def first_edges(edges: DataFrame, most: int = 250) -> DataFrame:
    """The first edges of each list in the order of the file."""
    return edges.where(F.col("pos") < most)


def incoming_only(edges: DataFrame, most: int = 250) -> DataFrame:
    """Lists of the strongest incoming edges: (src, dst, sim, rk), where dst points at src."""
    return top_edges(transpose(edges), 0.0, most)


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, connections): lists by falling similarity."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("o"), F.col("dst").alias("id"), F.col("sim").alias("sim"))))
    return edges.groupBy(F.col("src").alias("id")).agg(F.transform(pairs, lambda p: F.struct(p["id"].alias("id"), p["sim"].alias("sim"))).alias("connections"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among nodes(id)."""
    return edges.drop("place").join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def pair_strength(edges: DataFrame) -> DataFrame:
    """The larger similarity of the two directions of each pair."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("sim").alias("sim"))


def local_degree(edges: DataFrame) -> DataFrame:
    """Edges at each node of a result graph, and the largest such number."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return with_row(ends, ends.agg(F.max("degree").alias("max_degree")))


def induced_with_stats(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The induced subgraph and one row of what it keeps."""
    inner = induced(edges, nodes)
    before = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").agg(F.count("*").alias("edges_before"))
    after = inner.agg(F.count("*").alias("edges_kept"), F.count_distinct("src").alias("sources_kept"))
    stats = with_row(before, after).withColumns({
        "preserved": F.when(F.col("edges_before") > 0, F.col("edges_kept") / F.col("edges_before")).otherwise(0.0),
        "average_degree": F.when(F.col("sources_kept") > 0, F.col("edges_kept") / F.col("sources_kept")).otherwise(0.0),
    })
    return inner, stats
