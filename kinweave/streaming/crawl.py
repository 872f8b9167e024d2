"""Crawl of a similarity service: replay of recorded answers, resumable state, caches with a time to live."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_name, resolve_id
from ..operators.metrics import cumulated
from ..store import Growing, ship


class Transient(Exception):
    """A failure worth another try: rate limit, network, anything but a refusal or an unknown entity."""


def with_retry(call: Callable, tries: int = 5, least: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """call(), again after 1, 2, 4 ... seconds if it raises Transient; None if it never succeeds."""
    for k in range(tries):
        try:
            return call()
        except Transient:
            if k + 1 < tries:
                sleep(min(most, least * 2**k))
    return None


def fetch(ids: DataFrame, client: Callable[[str], list[tuple[str, float]] | None], concurrency: int = 1, pause: float = 0.0) -> DataFrame:
    """(id, dst, sim): answers of a client for every id, fetched within tasks; an id without an answer has one null row.

    Each task keeps `concurrency` requests in flight and waits `pause` seconds between starting one and the next.
    """
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        def asked(i: str, k: int) -> list[tuple]:
            if pause and k:
                time.sleep(pause)
            return [(i, d, float(s)) for d, s in (with_retry(lambda: client(i)) or [(None, float("nan"))])]

        for f in frames:
            with ThreadPoolExecutor(concurrency) as pool:
                rows = [r for found in pool.map(asked, f["id"], range(len(f))) for r in found]
            yield pd.DataFrame(rows, columns=["id", "dst", "sim"])

    ship(ids.sparkSession)
    return ids.select("id").mapInPandas(run, "id string, dst string, sim double")


def crawl(recorded: DataFrame, seeds: list[str], most: int | None = None, batch: int | None = None, save: str | None = None) -> DataFrame:
    """(id, dst, sim) gathered from recorded(id, connections) by crawling outwards from the seeds.

    A batch is the first `batch` of the queue (all of it, if None), in the order in which entities were queued and then of ids; its answers are
    looked up, and what it has not seen is queued behind all others. `most` entities are asked for in all.
    As nothing gets in front of those that wait, all whole batches that wait are asked for in one round, each entity under the number of its batch:
    the order is that of one batch after the other, in about as many rounds as there are hops. Every round adds a part to shared tables, so a round
    costs what is new in it. With `save` the state goes there after each round. No seeds give no rows.
    """
    spark = recorded.sparkSession
    queued, done, found = (Growing(spark, n) for n in ("queued", "done", "answers"))
    _, waiting = queued.add(spark.createDataFrame([(s, 0) for s in dict.fromkeys(seeds)], "id string, batch int"))
    done.add(spark.createDataFrame([], "id string, batch int"))
    found.add(spark.createDataFrame([], "id string, dst string, sim double, batch int"))
    left, k = most, 0
    while waiting and (left is None or left > 0):
        queue = queued.all().join(done.all(), "id", "left_anti")
        size = waiting if batch is None else waiting // batch * batch or waiting
        size = size if left is None else min(size, left)
        if batch is None and size == waiting:
            now = queue.select("id", F.lit(k + 1).alias("batch"))
        else:
            placed = cumulated(queue.select(F.struct("batch", "id").alias("at"), F.lit(1).alias("n")), "at", "n")
            now = placed.where(F.col("n_before") < size).select("at.id", (F.floor(F.col("n_before") / (batch or size)) + k + 1).cast("int").alias("batch"))
        now, n = done.add(now)
        k += -(-n // (batch or n))
        left = None if left is None else left - n
        got, _ = found.add(recorded.join(now, "id").select("id", F.explode("connections").alias("c"), "batch").select("id", F.col("c.id").alias("dst"), F.col("c.sim").cast("double").alias("sim"), "batch"))
        _, new = queued.add(got.where("dst is not null").groupBy(F.col("dst").alias("id")).agg(F.min("batch").alias("batch")).join(queued.all(), "id", "left_anti"))
        waiting += new - n
        if save:
            save_state(spark, save, done.all(), queued.all().join(done.all(), "id", "left_anti"))
    return found.all().drop("batch")


def resolve_answers(answers: DataFrame) -> DataFrame:
    """(id, name, url) of answers (mbid, name, url): the id given, else one made from the URL; without either the row goes."""
    return answers.select(resolve_id(F.col("mbid"), F.col("url")).alias("id"), "name", "url").where("id is not null")


def first_seen(entities: DataFrame, order: str = "line") -> DataFrame:
    """The first record of each id in the order of a column."""
    rest = [c for c in entities.columns if c not in ("id", order)]
    return entities.groupBy("id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("id", *(F.col(f"r.{c}") for c in rest))


def new_seeds(seeds: DataFrame, processed: DataFrame, queue: DataFrame) -> DataFrame:
    """Seeds that are neither processed nor queued."""
    return seeds.select("id").distinct().join(processed, "id", "left_anti").join(queue, "id", "left_anti")


def save_state(spark: SparkSession, path: str, processed: DataFrame, queue: DataFrame) -> None:
    processed.select("id", F.lit(True).alias("processed")).union(queue.select("id", F.lit(False))).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    state = spark.read.parquet(path)
    return state.where("processed").select("id"), state.where("not processed").select("id")


def stream_edges(spark: SparkSession, folder: str, out: str, checkpoint: str, trigger: dict | None = None):
    """A stream that appends the edges of NDJSON files as they arrive; exactly once by its checkpoint."""
    lines = spark.readStream.schema("value string").text(folder)
    rec = lines.select(F.from_json("value", F.lit("id string, connections array<array<string>>")).alias("r")).where("r.id is not null")
    flat = rec.select(F.col("r.id").alias("src"), F.explode("r.connections").alias("c")).select("src", F.get("c", F.lit(0)).alias("dst"), F.get("c", F.lit(1)).try_cast("float").alias("sim"))
    return flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def stream_entities(spark: SparkSession, folder: str, out: str, checkpoint: str, trigger: dict | None = None):
    """A stream of entities, each id once.

    Every batch writes what the batches before it have not written, to a folder of its own (which a repeated batch replaces), so the
    stream holds no state however long it runs.
    """

    def add(rows: DataFrame, batch: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        fresh = rows.groupBy("id").agg(F.min(F.struct("name", "url")).alias("r")).select("id", "r.name", "r.url").withColumn("clean", clean_name(F.col("name")))
        if known:
            before = rows.sparkSession.read.schema("id string, batch long").parquet(out).where(F.col("batch") < batch)
            fresh = fresh.join(before.select("id"), "id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    rows = spark.readStream.schema("id string, name string, url string").json(folder)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()
