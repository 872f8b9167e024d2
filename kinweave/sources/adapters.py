"""Graphs over the TPC-H-like tables: things are similar that share orders, as listeners share artists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.edges import top_edges, transpose
from ..operators.paths import Graph
from ..store import built, observed, tasks, widen


def co_occurrence(pairs: DataFrame) -> DataFrame:
    """(src, dst, sim, place) of pairs (item, thing): n shared items over the most any dst shares with src; place: the edge's rank in the list of src.

    Pairs of things are shuffled once, by src, where they are counted, compared and ranked; the number of partitions follows the number of pairs.
    """
    spark = pairs.sparkSession
    held = pairs.where("item is not null").repartition(tasks(spark, pairs.count()), "item").groupBy("item").agg(F.collect_set("thing").alias("things"))
    lists, seen = observed(held.where("size(things) > 1").select("things"), "lists", pairs=F.coalesce(F.sum(F.size("things").cast("long") * (F.size("things") - 1)), F.lit(0)))
    widen(spark, seen["pairs"])
    both = lists.select("things", F.explode("things").alias("src")).select("src", F.explode("things").alias("dst")).where("src != dst")
    n = both.repartition(tasks(spark, seen["pairs"]), "src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    w = Window.partitionBy("src").orderBy(F.col("n").desc(), "dst")
    return n.select("src", "dst", (F.col("n") / F.first("n").over(w)).alias("sim"), F.row_number().over(w).alias("place"))


def _build(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return co_occurrence(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("item"), F.col(column).alias("thing")))


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "supplier-edges", lambda: _build(spark, sf_dir, "l_suppkey"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "part-edges", lambda: _build(spark, sf_dir, "l_partkey"))


def supplier_view(spark: SparkSession, sf_dir: str, top_n: int, min_sim: float = 0.0, reverse: bool = False) -> DataFrame:
    edges = supplier_edges(spark, sf_dir)
    name = f"supplier-view-{top_n}-{min_sim}-{reverse}"
    return built(spark, sf_dir, name, lambda: top_edges(transpose(edges) if reverse else edges, min_sim, top_n))


def supplier_graph(spark: SparkSession, sf_dir: str, top_n: int = 80) -> Graph:
    return Graph(supplier_view(spark, sf_dir, top_n), supplier_view(spark, sf_dir, top_n, reverse=True))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("https://supplier.example/"), F.col("s_suppkey").cast("string")).alias("url"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("https://part.example/"), F.col("p_partkey").cast("string")).alias("url"))
