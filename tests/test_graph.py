"""Paths, exploration and neighbourhoods on small graphs with known answers."""

import heapq
import random

import pytest

from kinweave.operators import edges, explore, metrics, neighborhood, paths

QUAD = [("T", "O", 1.0), ("O", "B", 0.8), ("O", "T", 1.0), ("B", "F", 1.0), ("B", "O", 0.8), ("F", "B", 1.0)]
PENTA = [("A", "B", 0.9), ("A", "D", 0.7), ("B", "A", 0.9), ("B", "C", 0.8), ("B", "E", 0.6), ("C", "B", 0.8), ("D", "A", 0.7), ("E", "B", 0.6)]
DIAMOND = [("Alice", "Bob", 0.5), ("Alice", "Charlie", 0.9), ("Bob", "Dave", 0.8), ("Charlie", "Dave", 0.7)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, sim double")


def graph(spark, rows, min_sim=0.0, top=80):
    e = frame(spark, rows)
    return paths.Graph(edges.top_edges(e, min_sim, top).cache(), edges.top_edges(edges.transpose(e), min_sim, top).cache())


def ids(path):
    return [r["id"] for r in path.orderBy("step").collect()]


@pytest.fixture(params=[True, False], ids=["in memory", "distributed"])
def local(request):
    return request.param


def test_hop_path(spark, local):
    g = graph(spark, QUAD)
    rows = paths.hop_path(g, "T", "B", local).orderBy("step").collect()
    assert [(r["id"], r["similarity"]) for r in rows] == [("T", None), ("O", 1.0), ("B", 0.8)]
    assert ids(paths.hop_path(g, "T", "T", local)) == ["T"]
    assert ids(paths.hop_path(g, "T", "nobody", local)) == []
    assert ids(paths.hop_path(g, "nobody", "nobody", local)) == []
    assert ids(paths.hop_path(graph(spark, PENTA), "A", "C", local)) == ["A", "B", "C"]


def test_weighted_path(spark, local):
    assert ids(paths.weighted_path(graph(spark, DIAMOND), "Alice", "Dave", local)) == ["Alice", "Charlie", "Dave"]
    assert ids(paths.weighted_path(graph(spark, DIAMOND, 0.75), "Alice", "Dave", local)) == []


@pytest.mark.parametrize(("budget", "least", "want"), [(2, 0.0, [("T", 1.0, 0), ("O", 1.0, 1)]), (4, 0.0, [("T", 1.0, 0), ("O", 1.0, 1), ("B", 0.8, 2), ("F", 1.0, 3)]), (4, 0.9, [("T", 1.0, 0), ("O", 1.0, 1)]), (0, 0.0, [("T", 1.0, 0)])])
def test_explore_hops(spark, local, budget, least, want):
    v = graph(spark, QUAD, least).forward
    nodes = explore.explore_hops(v, metrics.owners(v), "T", budget, local)
    assert [(r["id"], r["similarity"], r["layer"]) for r in nodes.orderBy("ord").collect()] == want
    if budget == 4 and not least:
        assert explore.induced_view(v, nodes).count() == 6


def test_explore_weighted(spark, local):
    # similarities are single precision in files: 1 - 0.8 lies just below 0.2, within the first ring
    v = edges.top_edges(frame(spark, QUAD).selectExpr("src", "dst", "cast(sim as float) as sim"))
    got = {(r["id"], round(r["similarity"], 6), r["layer"]) for r in explore.explore_weighted(v, "T", 4, local).collect()}
    assert got == {("T", 1.0, 0), ("O", 1.0, 1), ("B", 0.8, 1), ("F", 0.8, 1)}
    assert explore.explore_weighted(v, "T", 0, local).count() == 0


def test_explore_reverse(spark):
    v = graph(spark, QUAD).reverse
    nodes = explore.explore_hops(v, metrics.owners(v), "F", 3)
    assert {(r["id"], r["similarity"], r["layer"]) for r in nodes.collect()} == {("F", 1.0, 0), ("B", 1.0, 1), ("O", 0.8, 2)}
    flipped = explore.flip(explore.induced_view(v, nodes))
    assert {tuple(r) for r in flipped.collect()} == {("B", "F", 1.0), ("B", "O", 0.8), ("F", "B", 1.0), ("O", "B", 0.8)}


def test_only_owners_are_discovered(spark, local):
    v = graph(spark, [("A", "B", 1.0), ("A", "C", 0.9), ("C", "A", 0.9)]).forward
    got = explore.explore_hops(v, metrics.owners(v), "A", 10, local)
    assert {r["id"] for r in got.collect()} == {"A", "C"}
    assert {r["id"] for r in explore.explore_weighted(v, "A", 10, local).collect()} == {"A", "B", "C"}


def test_neighborhood(spark):
    g = graph(spark, PENTA)
    p = paths.hop_path(g, "A", "C").cache()
    nodes = neighborhood.path_neighborhood(g, p, 10)
    assert {tuple(r) for r in nodes.collect()} == {("A", 0.0, 0), ("B", 0.9, 1), ("C", 0.8, 2), ("D", 0.7, 3), ("E", 0.6, 3)}
    got = {tuple(r) for r in neighborhood.neighborhood_edges(g, p, nodes).collect()}
    assert got == {("A", "B", 0.9), ("A", "D", 0.7), ("B", "C", 0.8), ("B", "E", 0.6), ("D", "A", 0.7), ("E", "B", 0.6)}
    four = neighborhood.path_neighborhood(g, p, 4)
    assert {r["id"] for r in four.collect()} == {"A", "B", "C", "D"}
    assert {tuple(r)[:2] for r in neighborhood.neighborhood_edges(g, p, four).collect()} == {("A", "B"), ("A", "D"), ("B", "C"), ("D", "A")}
    three = neighborhood.path_neighborhood(g, p, 3)
    assert {tuple(r)[:2] for r in neighborhood.neighborhood_edges(g, p, three).collect()} == {("A", "B"), ("B", "C")}
    assert tuple(neighborhood.path_status(p, 2).first()) == ("path_too_long", 3, 3)
    assert neighborhood.path_status(p, 3).first()["status"] == "success"
    assert neighborhood.path_status(paths.hop_path(g, "A", "isolated"), 10).first()["status"] == "no_path"
    strict = graph(spark, PENTA, 0.75)
    p = paths.hop_path(strict, "A", "C").cache()
    assert {r["id"] for r in neighborhood.path_neighborhood(strict, p, 5).collect()} == {"A", "B", "C"}


def test_metrics(spark):
    e = frame(spark, PENTA)
    assert tuple(metrics.graph_counts(e).first()) == (5, 8, 5, 0.4)
    assert metrics.reciprocity(e).first()["reciprocity"] == 1.0
    d = metrics.in_degree(e)
    assert {tuple(r) for r in d.collect()} == {("A", 2), ("B", 3), ("C", 1), ("D", 1), ("E", 1)}
    s = metrics.summary(d, "degree").first()
    assert (s["mean"], round(s["std"], 9)) == (1.6, 0.8)
    assert round(metrics.gini(d, "degree").first()["gini"], 9) == 0.25
    assert metrics.graph_counts(e.limit(0)).first()["density"] == 0.0


def test_views(spark):
    e = spark.createDataFrame([("a", x, s, k) for k, (x, s) in enumerate([("p", 0.5), ("q", 0.9), ("r", 0.5), ("s", float("nan"))])], "src string, dst string, sim float, pos int")
    assert [r["dst"] for r in edges.top_edges(e.where("dst <> 's'"), 0.0, 2).orderBy("rk").collect()] == ["q", "p"]
    assert {r["dst"] for r in edges.top_edges(e, 0.5, 9).collect()} == {"p", "q", "r"}
    assert edges.top_edges(e, 0.0, 9).count() == 4
    seven = spark.createDataFrame([("a", "b", 0.7, 0)], "src string, dst string, sim float, pos int")
    assert edges.top_edges(seven, 0.7, 9).count() == 1


def brute(rows, top, start, target, weighted):
    """Least (cost, hops) over forward edges, then reverse-list edges."""

    def lists(pairs):
        out = {}
        for s, d, w in pairs:
            out.setdefault(s, []).append((-w, d))
        return {s: sorted(x)[:top] for s, x in out.items()}

    def sweep(adj, a):
        best, heap = {}, [(0, 0, a)]
        while heap:
            c, h, n = heapq.heappop(heap)
            if n in best:
                continue
            best[n] = (c, h)
            for w, d in adj.get(n, []):
                heapq.heappush(heap, (c + round((1 + w) * 1e9) if weighted else c + 1, h + 1, d))
        return best

    f, r = sweep(lists(rows), start), sweep(lists([(d, s, w) for s, d, w in rows]), target)
    return min(((f[n][0] + r[n][0], f[n][1] + r[n][1]) for n in f if n in r), default=None)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    rows = list({(f"n{a}", f"n{b}"): (f"n{a}", f"n{b}", rng.randint(1, 20) / 20) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(30)) if a != b}.values())
    g = graph(spark, rows, top=2)
    for weighted, find in ((False, paths.hop_path), (True, paths.weighted_path)):
        want = brute(rows, 2, "n0", "n7", weighted)
        got = find(g, "n0", "n7", local=True).orderBy("step").collect()
        assert got == find(g, "n0", "n7", local=False).orderBy("step").collect()
        assert bool(got) == (want is not None)
        if got:
            assert (got[0]["id"], got[-1]["id"]) == ("n0", "n7")
            cost = sum(round((1 - r["similarity"]) * 1e9) for r in got[1:]) if weighted else len(got) - 1
            assert (cost, len(got) - 1) == want
    start = spark.createDataFrame([("n0",)], "id string")
    for f in (paths.hop_levels, paths.distances):
        assert sorted(f(g.forward, start, local=True).collect()) == sorted(f(g.forward, start, local=False).collect())
    one, two = (explore.explore_hops(g.forward, metrics.owners(g.forward), "n0", 6, x).orderBy("ord").collect() for x in (True, False))
    assert one == two
