"""The entry points, end to end."""

import pytest

from kinweave import api

EDGES = [("T", "O", 1.0), ("O", "B", 0.8), ("O", "T", 1.0), ("B", "F", 1.0), ("B", "O", 0.8), ("F", "B", 1.0)]
NAMES = {"T": "Taylor Swift", "O": "Olivia Rodrigo", "B": "Billie Eilish", "F": "FINNEAS"}


@pytest.fixture(scope="module")
def lib(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string, sim double").selectExpr("src", "dst", "cast(sim as float) as sim")
    return api.Library(e, spark.createDataFrame([(k, v, f"u/{k}") for k, v in NAMES.items()], "id string, name string, url string"))


def test_paths(lib):
    got = api.find_path(lib, "T", "B").collect()
    assert [(r["name"], r["similarity"] and round(r["similarity"], 6)) for r in got] == [("Taylor Swift", None), ("Olivia Rodrigo", 1.0), ("Billie Eilish", 0.8)]
    assert [r["id"] for r in api.find_path_by_name(lib, "taylor swift", "finneas", algorithm="dijkstra").collect()] == ["T", "O", "B", "F"]
    with pytest.raises(LookupError):
        api.find_path_by_name(lib, "nobody", "finneas")
    for bad in ({"from_id": "", "to_id": "B"}, {"from_id": "T", "to_id": "B", "min_similarity": 2}):
        with pytest.raises(ValueError):
            api.find_path(lib, **bad)


def test_enhanced(lib):
    got = api.enhanced_path(lib, "T", "B", budget=4)
    assert got["status"].first()["status"] == "success"
    assert {r["id"] for r in got["nodes"].collect()} == set(NAMES)
    short = api.enhanced_path(lib, "T", "F", budget=2)
    assert tuple(short["status"].first()) == ("path_too_long", 4, 4) and short["edges"].count() == 0
    assert api.enhanced_path(lib, "T", "nobody")["status"].first()["status"] == "no_path"


def test_explore(lib):
    got = api.explore(lib, "T", budget=2)
    assert {r["name"] for r in got["nodes"].collect()} == {"Taylor Swift", "Olivia Rodrigo"}
    got = api.explore_reverse(lib, "F", budget=3)
    assert {(r["from"], r["to"]) for r in got["edges"].collect()} == {("B", "F"), ("B", "O"), ("F", "B"), ("O", "B")}
    got = api.explore(lib, "nobody")
    assert got["center"].first()["name"] == "Unknown Artist" and got["nodes"].count() == got["edges"].count() == 0


def test_the_rest(lib):
    assert [r["id"] for r in api.search(lib, "billie").collect()] == ["B"]
    assert api.stats(lib).first()[0] == 4 and api.random_entity(lib, 1).count() == 1
    assert api.details(lib, "T").count() == 1 and api.details(lib, "nobody").count() == 0
    report = {k: v.collect() for k, v in api.metric_report(lib).items()}
    assert report["counts"][0]["edges"] == 6 and len(report["summaries"]) == 3
    same = {k: v.collect() for k, v in api.compare_report(lib.edges, lib.edges).items()}
    assert same["verdict"][0]["verdict"] == "excellent" and same["ks"][0]["ks"] == 0.0
    part = api.subgraph(lib, share=0.5, walks=2, steps=2)
    assert part["nodes"].count() <= 2 and part["stats"].count() == 1
