"""Answers of the music services as rows: JSON documents in, typed columns out, all in Catalyst.

A client is any function that fetches a document for a key; `streaming.crawl.fetch` runs one in tasks with
retries, and recorded documents stand in for it in tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import resolve_id
from ..functions.values import clean_bio, first_image

SIMILAR = "similarartists struct<artist: array<struct<name: string, mbid: string, url: string, match: string>>>, error int"
INFO = "artist struct<name: string, mbid: string, url: string, image: array<struct<`#text`: string, size: string>>, stats: struct<listeners: string, playcount: string>, tags: struct<tag: array<struct<name: string>>>, bio: struct<summary: string, content: string>>, error int"
TRACKS = "toptracks struct<track: array<struct<name: string, url: string, playcount: string, listeners: string>>>, error int"
PREVIEW = "results array<struct<trackName: string, previewUrl: string>>"


def _read(body: Column, schema: str) -> Column:
    return F.from_json(body, F.lit(schema))


def similar(answers: DataFrame) -> DataFrame:
    """(src, dst, sim float, pos, name, url) of answers (id, body); entries without id and URL drop out."""
    rows = answers.select(F.col("id").alias("src"), F.posexplode(_read(F.col("body"), SIMILAR)["similarartists"]["artist"]).alias("pos", "a"))
    out = rows.select("src", resolve_id(F.col("a.mbid"), F.col("a.url")).alias("dst"), F.col("a.match").try_cast("float").alias("sim"), "pos", "a.name", "a.url")
    return out.where("dst is not null and sim is not null")


def info(answers: DataFrame) -> DataFrame:
    """(id, name, lastfm) of answers (id, body); lastfm is null for an error or an unreadable document."""
    a = _read(F.col("body"), INFO)["artist"]
    images = F.transform(a["image"], lambda i: F.struct(i["size"].alias("size"), i["#text"].alias("url")))
    made = F.struct(
        a["url"].alias("url"), first_image(images).alias("image_url"), a["stats"]["listeners"].alias("listeners"), a["stats"]["playcount"].alias("playcount"),
        F.transform(a["tags"]["tag"], lambda t: t["name"]).alias("tags"), clean_bio(a["bio"]["summary"]).alias("bio_summary"), clean_bio(a["bio"]["content"]).alias("bio_full"),
    )
    return answers.select("id", a["name"].alias("name"), F.when(a.isNotNull(), made).alias("lastfm"))


def tracks(answers: DataFrame, most: int = 5) -> DataFrame:
    """(id, name, url, playcount, listeners) of the first tracks of each answer."""
    t = F.slice(_read(F.col("body"), TRACKS)["toptracks"]["track"], 1, most)
    return answers.select("id", F.explode(t).alias("t")).select("id", "t.*")


def preview(answers: DataFrame) -> DataFrame:
    """(id, name, preview_url, n) of answers (id, name, body, n): the first result's preview, null without one."""
    return answers.select("id", "name", F.get(_read(F.col("body"), PREVIEW)["results"], F.lit(0))["previewUrl"].alias("preview_url"), "n")
