"""Newline-delimited JSON of graphs and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_uuid


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): non-blank lines with their order: file, then place in it."""
    raw = spark.read.text(path).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("line"))
    return raw.where(F.length(F.btrim("value")) > 0).drop("f")


def graph_records(spark: SparkSession, path: str) -> DataFrame:
    """(line, id, connections) of well-formed lines; malformed ones are skipped."""
    parsed = F.from_json("value", F.lit("id string, connections array<array<string>>"))
    rows = _lines(spark, path).select("line", parsed.alias("r"))
    return rows.where("r.id is not null and r.connections is not null").select("line", "r.id", "r.connections")


def edges_of(records: DataFrame, last_wins: bool = True) -> DataFrame:
    """(src, dst, sim, pos) of records (line, id, connections).

    Ids that are no UUIDs drop out with their edges. Of several records of one id the last counts in
    forward lists; reverse lists (last_wins False) merge all.
    """
    kept = records.withColumn("src", canonical_uuid(F.col("id"))).where("src is not null")
    if last_wins:
        kept = kept.groupBy("src").agg(F.max_by("connections", "line").alias("connections"))
    flat = kept.select("src", F.posexplode("connections").alias("pos", "c"))
    out = flat.select("src", canonical_uuid(F.get("c", F.lit(0))).alias("dst"), F.get("c", F.lit(1)).try_cast("float").alias("sim"), "pos")
    return out.where("dst is not null and sim is not null")


def read_edges(spark: SparkSession, path: str, last_wins: bool = True) -> DataFrame:
    return edges_of(graph_records(spark, path), last_wins)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, url); the last record of an id wins."""
    parsed = F.from_json("value", F.lit("id string, name string, url string"))
    rows = _lines(spark, path).select("line", parsed.alias("r")).select("line", canonical_uuid(F.col("r.id")).alias("id"), "r.name", "r.url").where("id is not null")
    return rows.groupBy("id").agg(F.max_by(F.struct("name", "url"), "line").alias("m")).select("id", "m.name", "m.url")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines, malformed lines and lines whose id is no UUID."""
    parsed = F.from_json("value", F.lit("id string, connections array<array<string>>"))
    r = _lines(spark, path).select(parsed.alias("r"))
    bad = F.col("r.id").isNull() | F.col("r.connections").isNull()
    return r.agg(F.count("*").alias("lines"), F.count_if(bad).alias("malformed"), F.count_if(~bad & canonical_uuid(F.col("r.id")).isNull()).alias("invalid_ids"))


def write_graph(adjacency: DataFrame, path: str, mode: str = "append") -> None:
    """adjacency: (id, connections array<struct<id, sim>>); one [id, sim] pair for each connection."""
    pair = F.transform("connections", lambda c: F.concat(F.lit('["'), c["id"].cast("string"), F.lit('",'), c["sim"].cast("double").cast("string"), F.lit("]")))
    line = F.concat(F.lit('{"id":"'), F.col("id").cast("string"), F.lit('","connections":['), F.concat_ws(",", pair), F.lit("]}"))
    adjacency.select(line.alias("value")).write.mode(mode).text(path)


def write_entities(entities: DataFrame, path: str, mode: str = "append") -> None:
    entities.select("id", "name", "url").write.mode(mode).json(path)


def best_by_line(records: DataFrame, key: str) -> DataFrame:
    """The last record of each key, by window; for keys with wide records."""
    w = Window.partitionBy(key).orderBy(F.col("line").desc())
    return records.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
