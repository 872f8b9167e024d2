"""One function for each entry point; results are DataFrames.

A Library holds the tables: edges (src, dst, sim), entities (id, name, url) and, if there is one, the
metadata cache. Cut views are built once for each (direction, min_similarity, max_relations) and kept.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Algorithm, PathConfig
from .operators import compare as two
from .operators import edges as views
from .operators import explore as around
from .operators import metrics, neighborhood, paths, sample
from .operators import search as names
from .store import table


@dataclass
class Library:
    edges: DataFrame
    entities: DataFrame
    cache: DataFrame | None = None
    _views: dict = field(default_factory=dict, repr=False)

    def view(self, cfg: PathConfig, reverse: bool = False) -> DataFrame:
        key = (cfg.min_match, cfg.top_related, reverse)
        if key not in self._views:
            e = views.transpose(self.edges) if reverse else self.edges
            self._views[key] = table(views.top_edges(e, cfg.min_match, cfg.top_related), "view")
        return self._views[key]

    def graph(self, cfg: PathConfig) -> paths.Graph:
        return paths.Graph(self.view(cfg), self.view(cfg, reverse=True))

    def index(self) -> DataFrame:
        if "names" not in self._views:
            self._views["names"] = table(names.name_index(self.entities), "names")
        return self._views["names"]


def _config(algorithm: str | None, min_similarity: float, max_relations: int) -> PathConfig:
    if not 0 <= min_similarity <= 1:
        raise ValueError("min_similarity has to lie between 0 and 1")
    if max_relations < 0:
        raise ValueError("max_relations must not be negative")
    return PathConfig(min_similarity, max_relations, Algorithm.parse(algorithm) is Algorithm.DIJKSTRA)


def _given(**ids) -> None:
    for name, value in ids.items():
        if value is None or value == "":
            raise ValueError(f"{name} is missing")


def search(lib: Library, q: str, limit: int = 10) -> DataFrame:
    return names.search(lib.index(), q, limit)


def _stats(lib: Library, seen: DataFrame, began: float) -> DataFrame:
    """artists_visited and duration_ms of a search that is over."""
    n = seen.count()
    return lib.edges.sparkSession.createDataFrame([(n, int((time.perf_counter() - began) * 1000))], "artists_visited long, duration_ms long")


def path_with_stats(lib: Library, from_id, to_id, algorithm: str = "bfs", min_similarity: float = 0.0, max_relations: int = 80, local: bool = False) -> dict[str, DataFrame]:
    """path (step, id, name, url, similarity), without rows if there is none, and search_stats. A node without an entity keeps its row."""
    _given(from_id=from_id, to_id=to_id)
    cfg = _config(algorithm, min_similarity, max_relations)
    graph, began = lib.graph(cfg), time.perf_counter()
    found = paths.search(graph, from_id, to_id, cfg.weighted, local)
    stats = _stats(lib, found.seen, began)
    named = found.path.join(lib.entities.select("id", "name", "url"), "id", "left")
    return {"path": named.select("step", "id", "name", "url", "similarity").orderBy("step"), "search_stats": stats}


def find_path(lib: Library, from_id, to_id, algorithm: str = "bfs", min_similarity: float = 0.0, max_relations: int = 80, local: bool = False) -> DataFrame:
    """The path of path_with_stats."""
    return path_with_stats(lib, from_id, to_id, algorithm, min_similarity, max_relations, local)["path"]


def resolve(lib: Library, *given: str) -> list:
    """The id of the best match of each name."""
    spark = lib.edges.sparkSession
    best = {r["query"]: r["id"] for r in names.by_name(lib.index(), spark.createDataFrame([(x,) for x in dict.fromkeys(given)], "query string")).collect()}
    for x in given:
        if x not in best:
            raise LookupError(f"'{x}' not found")
    return [best[x] for x in given]


def find_path_by_name(lib: Library, a: str, b: str, **options) -> DataFrame:
    return find_path(lib, *resolve(lib, a, b), **options)


def enhanced_path(lib: Library, from_id, to_id, algorithm: str = "bfs", min_similarity: float = 0.0, max_relations: int = 80, budget: int = 100, local: bool = False) -> dict[str, DataFrame]:
    """status, path, nodes, edges and search_stats; nodes and edges are those of the path and its neighbourhood if status is success."""
    _given(from_id=from_id, to_id=to_id)
    cfg = _config(algorithm, min_similarity, max_relations)
    graph, began = lib.graph(cfg), time.perf_counter()
    found = paths.search(graph, from_id, to_id, cfg.weighted, local)
    path = table(found.path, "path")
    searched = _stats(lib, found.seen, began)
    status = neighborhood.path_status(path, budget)
    ok = status.first()["status"] == "success"
    shown = path if ok else path.limit(0)
    nodes = neighborhood.path_neighborhood(graph, shown, budget if ok else 0)
    return {"status": status, "path": path, "nodes": around.with_names(nodes, lib.entities), "edges": neighborhood.neighborhood_edges(graph, shown, nodes, directed=True), "search_stats": searched}


def explore(lib: Library, artist_id, algorithm: str = "bfs", min_similarity: float = 0.0, max_relations: int = 80, budget: int = 100, reverse: bool = False, local: bool = False) -> dict[str, DataFrame]:
    """center, nodes, edges and search_stats around an entity; an unknown one gives "Unknown Artist" and no rows."""
    _given(artist_id=artist_id)
    cfg = _config(algorithm, min_similarity, max_relations)
    spark, view, began = lib.edges.sparkSession, lib.view(cfg, reverse), time.perf_counter()
    known = lib.entities.where(F.col("id") == F.lit(artist_id)).select("id", "name", "url")
    center = paths._ids(spark, view, artist_id).join(known, "id", "left").withColumn("name", F.coalesce("name", F.lit("Unknown Artist")))
    nodes = around.explore_weighted(view, artist_id, budget, local) if cfg.weighted else around.explore_hops(view, metrics.owners(view), artist_id, budget, local)
    nodes = table(nodes if not known.isEmpty() else nodes.limit(0), "explored")
    shown = around.with_names(nodes, lib.entities)
    searched = _stats(lib, nodes, began)
    inner = around.induced_view(view, nodes)
    return {"center": center, "nodes": shown, "edges": around.flip(inner) if reverse else inner, "search_stats": searched}


def explore_reverse(lib: Library, artist_id, **options) -> dict[str, DataFrame]:
    return explore(lib, artist_id, reverse=True, **options)


def stats(lib: Library) -> DataFrame:
    return lib.entities.agg(F.count("*").alias("total_artists"))


def random_entity(lib: Library, seed: int | None = None) -> DataFrame:
    return names.random_entity(lib.entities, seed)


def details(lib: Library, ident, now=None) -> DataFrame:
    """The entity with its cached metadata; no row if it is unknown."""
    from . import schema

    cache = lib.cache if lib.cache is not None else lib.edges.sparkSession.createDataFrame([], schema.CACHED)
    return names.details(lib.entities, cache, lib.entities.where(F.col("id") == F.lit(ident)).select("id"), now)


def metric_report(lib: Library, cap: int = 250) -> dict[str, DataFrame]:
    """All statistics of the graph over the strongest `cap` edges of each node."""
    e = table(views.top_edges(lib.edges, 0.0, cap), "capped")
    ins, outs = table(metrics.in_degree(e), "in"), table(metrics.out_degree(e), "out")
    summaries = [metrics.summary(d, c).withColumn("of", F.lit(n)) for n, d, c in (("in_degree", ins, "degree"), ("out_degree", outs, "degree"), ("weight", e, "sim"))]
    return {
        "counts": metrics.graph_counts(e), "summaries": reduce(DataFrame.unionByName, summaries), "gini": metrics.gini(ins, "degree"), "reciprocity": metrics.reciprocity(e), "clustering": metrics.clustering(e),
        "power_law": metrics.power_law(ins, "degree"), "top_in": metrics.top_nodes(ins, lib.entities), "top_out": metrics.top_nodes(outs, lib.entities, largest_id_first=True),
    }


def compare_report(full: DataFrame, sub: DataFrame) -> dict[str, DataFrame]:
    """Two edge tables: size ratios, differences of the in-degree's summary, two-sample statistics and a verdict."""
    a, b = metrics.in_degree(full), metrics.in_degree(sub)
    tall = lambda d: metrics.summary(d, "degree").unpivot([], ["mean", "median", "std", "q25", "q75"], "metric", "value")
    differences = two.metric_differences(tall(a), tall(b))
    both = table(two.two_samples(a, b, "degree"), "samples")
    return {"sizes": two.size_ratios(metrics.graph_counts(full), metrics.graph_counts(sub)), "differences": differences, "verdict": two.representativeness(differences), "ks": two.ks_statistic(both), "mann_whitney": two.mann_whitney(both), "levene": two.levene(both), "cohens_d": two.cohens_d(both)}


def subgraph(lib: Library, share: float = 0.2, seed: int = 456, **options) -> dict[str, DataFrame]:
    """A random-walk sample of the graph: its nodes, its edges and what share of them it keeps."""
    nodes = table(sample.walk_subgraph(lib.edges, metrics.out_degree(lib.edges), share, seed, **options), "nodes")
    inner, kept = views.induced_with_stats(lib.edges, nodes)
    return {"nodes": nodes, "edges": inner, "stats": kept}
