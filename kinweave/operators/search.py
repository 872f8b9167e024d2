"""Finding entities by name. entities: (id, name, url[, pos]); pos is the order of the file, else id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_name


def name_index(entities: DataFrame) -> DataFrame:
    """entities with the columns that lookups use; written once, searches prune and push down on it."""
    return entities.withColumn("clean", clean_name(F.col("name")))


def by_name(index: DataFrame, names: DataFrame) -> DataFrame:
    """(query, id, name): best match of every row of names(query).

    A name that is equal but for case comes first, then the order of the file.
    """
    asked = names.select("query", clean_name(F.col("query")).alias("clean"))
    hit = asked.join(index, "clean")
    pos = "pos" if "pos" in index.columns else "id"
    w = Window.partitionBy("query").orderBy((F.lower("name") == F.lower("query")).desc(), pos)
    return hit.withColumn("k", F.row_number().over(w)).where("k = 1").select("query", "id", "name")


def lookup(index: DataFrame) -> DataFrame:
    """(clean, ids): all ids of each clean name."""
    return index.groupBy("clean").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def search(index: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Names that contain the query, the most relevant first: exact, then equal key, then prefix, then short.

    A blank query finds nothing; one whose key is empty finds every name.
    """
    if not query.strip():
        return index.select("id", "name", "url").limit(0)
    q = clean_name(F.lit(query))
    hit = index.where(F.contains("clean", q)).dropDuplicates(["id"])
    order = [(F.lower("name") == F.lower(F.lit(query))).desc(), (F.col("clean") == q).desc(), F.startswith("clean", q).desc(), F.octet_length("name"), F.col("id")]
    return hit.orderBy(*order).limit(limit).select("id", "name", "url")


def random_entity(entities: DataFrame, seed: int | None = None) -> DataFrame:
    """One entity, each equally likely; no row if there is none."""
    return entities.orderBy(F.rand(seed)).limit(1)


def details(entities: DataFrame, cache: DataFrame, wanted: DataFrame, now=None) -> DataFrame:
    """Entities of wanted(id) with their cached metadata where it is fresh; others have nulls to fetch."""
    from ..functions.values import is_fresh

    fresh = cache.where(is_fresh(F.col("last_fetched"), now) & F.col("lastfm").isNotNull()).select("id", "last_fetched", "lastfm", "tracks")
    return entities.join(wanted.select("id"), "id", "left_semi").join(fresh, "id", "left").withColumn("cached", F.col("last_fetched").isNotNull())


def zip_previews(tracks: DataFrame, previews: DataFrame) -> DataFrame:
    """Tracks (id, name, ...) with the preview of their name; the last preview given for a name counts (by n)."""
    last = previews.groupBy("id", "name").agg(F.max_by("preview_url", "n").alias("preview_url"))
    return tracks.join(last, ["id", "name"], "left")
