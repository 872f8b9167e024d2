"""Scalar functions of results, caches and the drawing of graphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How long stored metadata and answers held in memory stay fresh.
TTL_SECONDS, MEMORY_TTL_SECONDS = 90 * 24 * 3600, 24 * 3600


def cost(sim: Column) -> Column:
    """1 - similarity in whole billionths, so that sums are exact and ties are ties."""
    return F.round((F.lit(1.0) - sim.cast("double")) * 1_000_000_000).cast("long")


def layer_of(cost_units: Column) -> Column:
    """Ring of a node in weighted exploration: 1 + trunc(5 * cost), never below 1."""
    return F.greatest(F.lit(1), F.floor(cost_units * F.lit(5) / F.lit(1_000_000_000)).cast("int") + 1)


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def form_encode(x: Column) -> Column:
    """Percent-encoding with %20 for spaces; '*' is encoded and '~' is not."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def search_term(artist: Column, track: Column) -> Column:
    joined = F.concat_ws(" ", artist, track)
    return F.replace(F.replace(joined, F.lit(" "), F.lit("+")), F.lit("&"), F.lit("and"))


def clean_bio(x: Column) -> Column:
    return F.nullif(F.btrim(F.replace(x, F.lit("Read more on Last.fm"), F.lit(""))), F.lit(""))


def first_image(images: Column) -> Column:
    """URL of the first image of size large or medium; empty means none."""
    found = F.get(F.filter(images, lambda i: i["size"].isin("large", "medium")), F.lit(0))
    return F.nullif(found["url"], F.lit(""))


def is_fresh(last_fetched: Column, now: Column | None = None, ttl: int = TTL_SECONDS) -> Column:
    return ((F.unix_timestamp() if now is None else now) - last_fetched) < F.lit(ttl)


def has_preview(tracks: Column) -> Column:
    return F.coalesce(F.exists(tracks, lambda t: t["preview_url"].isNotNull()), F.lit(False))


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| / |a| in percent; with a = 0 it is 0 or infinite."""
    return F.when(a == 0, F.when(b == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(F.abs(a - b) / F.abs(a) * 100)


def effect_label(d: Column) -> Column:
    m = F.abs(d)
    return F.when(m < 0.2, "Negligible").when(m < 0.5, "Small").when(m < 0.8, "Medium").otherwise("Large")


def verdict(mean_difference: Column) -> Column:
    return F.when(mean_difference < 10, "excellent").when(mean_difference < 20, "good").otherwise("poor")


def link_length(sim: Column) -> Column:
    return F.lit(30.0) + (F.lit(1.0) - sim) * F.lit(170.0)


def link_strength(sim: Column) -> Column:
    return sim * F.lit(0.8)


def zoom_floor(nodes: Column) -> Column:
    """How far a drawing of so many nodes may be zoomed out."""
    return F.greatest(F.lit(0.005), F.least(F.lit(0.5), F.lit(2.0) / F.sqrt(F.greatest(nodes, F.lit(1)))))


def font_size(degree: Column, largest: Column) -> Column:
    return F.lit(9.0) + degree / F.greatest(largest, F.lit(1)) * F.lit(6.0)
