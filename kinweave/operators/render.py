"""Results as JSON and as text, and the figures a drawing of a graph needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import font_size, link_length, link_strength, zoom_floor


def _ordered(path: DataFrame, *columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("step", *columns)))


def path_json(path: DataFrame, query: str, nodes_explored: int, seconds: float) -> DataFrame:
    """One JSON document; the first step has no similarity, a missing path is left out."""
    steps = F.transform(_ordered(path, "id", "name", "url", "similarity"), lambda s: F.struct(s["id"].alias("id"), s["name"].alias("name"), s["url"].alias("url"), F.when(s["step"] > 0, s["similarity"]).alias("similarity_to_previous")))
    row = path.agg(steps.alias("p"), F.count("*").alias("n"))
    doc = F.struct(
        F.lit(query).alias("query"),
        F.struct((F.col("n") > 0).alias("found"), F.when(F.col("n") > 0, F.col("p")).alias("path"), F.when(F.col("n") > 0, F.col("n") - 1).alias("steps")).alias("result"),
        F.struct(F.lit(nodes_explored).alias("nodes_explored"), F.lit(int(seconds * 1000)).alias("search_time_ms")).alias("stats"),
    )
    return row.select(F.to_json(doc, {"ignoreNullFields": "true"}).alias("json"))


def path_text(path: DataFrame, show_url: bool = False, show_similarity: bool = True) -> DataFrame:
    """(flow, lines): names joined by arrows, and a numbered list."""
    p = _ordered(path, "name", "url", "similarity")
    line = lambda s: F.concat(
        F.format_string("%d. %s", s["step"] + 1, s["name"]),
        F.when((s["step"] > 0) & F.lit(show_similarity), F.format_string(" [%.3f]", s["similarity"])).otherwise(""),
        F.when(F.lit(show_url), F.concat(F.lit(" - "), F.coalesce(s["url"], F.lit("")))).otherwise(""),
    )
    row = path.agg(p.alias("p"))
    return row.select(F.concat_ws(" → ", F.transform("p", lambda s: s["name"])).alias("flow"), F.concat_ws("\n", F.transform("p", line)).alias("lines"))


def layout(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """Length and strength of each link, with the font sizes of its ends; degrees as of edges.local_degree."""
    size = font_size(F.col("degree"), F.col("max_degree"))
    a, b = (degrees.select(F.col("id").alias(e), size.alias(f"{e}_font")) for e in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", link_length(F.col("sim")).alias("length"), link_strength(F.col("sim")).alias("strength"), "src_font", "dst_font")


def node_boxes(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """(id, font, width, height) of nodes (id, name): a box follows its font and the length of its name."""
    font = font_size(F.coalesce("degree", F.lit(0)), F.coalesce("max_degree", F.lit(1)))
    sized = nodes.join(degrees, "id", "left").select("id", "name", font.alias("font"))
    return sized.select("id", "font", (F.length("name") * F.col("font") * 0.6 + 8).alias("width"), (F.col("font") + 10).alias("height"))


def view_limits(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).withColumn("min_zoom", zoom_floor(F.col("nodes")))


def highlight(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """edges with `on_path`: whether either direction is a step of the path (src, dst)."""
    either = steps.select("src", "dst").union(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("on_path", F.lit(True))
    return edges.join(F.broadcast(either), ["src", "dst"], "left").withColumn("on_path", F.coalesce("on_path", F.lit(False)))  # a path


def drawable(nodes: DataFrame, edges: DataFrame, most_nodes: int = 500, most_edges: int = 2000, force: bool = False) -> bool:
    """Whether a result is small enough to draw."""
    return force or (nodes.limit(most_nodes + 1).count() <= most_nodes and edges.limit(most_edges + 1).count() <= most_edges)


def without_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (from, to, ...) both of whose ends are nodes(id)."""
    return edges.join(nodes.select(F.col("id").alias("from")), "from", "left_semi").join(nodes.select(F.col("id").alias("to")), "to", "left_semi")
