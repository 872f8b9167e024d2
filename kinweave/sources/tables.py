"""Parquet stores: the graph as tables, the metadata cache, metric files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_name
from ..operators.edges import transpose


def write_graph(edges: DataFrame, entities: DataFrame, folder: str) -> None:
    """edges by source, the transpose by target, entities, and the name lookup.

    Rows are sorted by their owner within files, so that a lookup reads the few row groups whose
    statistics admit it.
    """
    for name, df in (("edges", edges), ("edges_rev", transpose(edges))):
        df.repartition("src").sortWithinPartitions("src", F.col("sim").desc()).write.mode("overwrite").parquet(f"{folder}/{name}")
    entities.write.mode("overwrite").parquet(f"{folder}/entities")
    entities.select(clean_name(F.col("name")).alias("clean"), "id").groupBy("clean").agg(F.array_sort(F.collect_set("id")).alias("ids")).write.mode("overwrite").parquet(f"{folder}/name_lookup")


def read_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("edges", "edges_rev", "entities", "name_lookup")}


def snapshot(cache: DataFrame, folder: str) -> str:
    """Write a new version of the cache beside the old ones and point `CURRENT` at it; returns its path."""
    spark = cache.sparkSession
    at = f"{folder}/v-{uuid.uuid4().hex}"
    cache.write.parquet(at)
    spark.createDataFrame([(at,)], "path string").coalesce(1).write.mode("overwrite").text(f"{folder}/CURRENT")
    return at


def load_snapshot(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The current version; a cache that is missing or broken starts empty."""
    try:
        at = spark.read.text(f"{folder}/CURRENT").first()
        return spark.read.schema(schema).parquet(at["value"])
    except Exception:  # noqa: BLE001  whatever is wrong with it, the cache is only a cache
        return spark.createDataFrame([], schema)


def write_metrics(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def write_distribution(values: DataFrame, column: str, folder: str, sample: int = 5000, seed: int = 0) -> None:
    """The whole distribution as Parquet and a sample of bounded size as JSON."""
    from ..operators.sample import reservoir

    values.select(column).write.mode("overwrite").parquet(f"{folder}/{column}")
    reservoir(values.select(column), sample, seed).write.mode("overwrite").json(f"{folder}/{column}_sample")


def sizes(before: DataFrame, after_bytes: int, before_bytes: int) -> DataFrame:
    """Non-blank lines of a text table and the space a packed copy saves, in percent."""
    lines = before.where(F.length(F.btrim("value")) > 0).agg(F.count("*").alias("lines"))
    saved = 100.0 * (1 - after_bytes / before_bytes) if before_bytes else 0.0
    return lines.withColumn("saved_percent", F.lit(saved))
