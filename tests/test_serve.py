"""HTTP routes, the command line and the client of the services."""

import json
import threading
import urllib.request

import pytest

from kinweave import __main__ as cli
from kinweave import api, serve
from kinweave.sources import client, service, tables
from kinweave.streaming.crawl import Transient

from .test_api import EDGES, NAMES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("graph"))
    e = spark.createDataFrame(EDGES, "src string, dst string, sim double").selectExpr("src", "dst", "cast(sim as float) as sim")
    tables.write_graph(e, spark.createDataFrame([(k, v, f"u/{k}") for k, v in NAMES.items()], "id string, name string, url string"), at)
    return at


@pytest.fixture(scope="module")
def lib(spark, folder):
    g = tables.read_graph(spark, folder)
    return api.Library(g["edges"], g["entities"])


def test_routes(lib):
    code, got = serve.respond(lib, "/api/path?from_id=T&to_id=B")
    assert code == 200 and [r["id"] for r in got["path"]] == ["T", "O", "B"] and "similarity" not in got["path"][0]
    assert (got["artist_count"], got["step_count"], got["algorithm"]) == (3, 2, "bfs") and got["search_stats"]["artists_visited"] >= 3
    assert "path" not in serve.respond(lib, "/api/path?from_id=T&to_id=nobody")[1]
    code, got = serve.respond(lib, "/api/enhanced_path?from_id=T&to_id=F&budget=2&algorithm=Dijkstra")
    assert (code, got["status"], got["error"]["minimum_budget_needed"], len(got["error"]["primary_path"])) == (200, "path_too_long", 4, 4)
    assert len(serve.respond(lib, "/api/enhanced_path?from_id=T&to_id=B&budget=4")[1]["data"]["nodes"]) == 4
    got = serve.respond(lib, "/api/explore?artist_id=T&budget=2")[1]
    assert (got["total_found"], got["center_artist"]["name"], got["search_stats"]["artists_visited"]) == (2, "Taylor Swift", 2)
    got = serve.respond(lib, "/api/explore_reverse?artist_id=nobody")[1]
    assert (got["center_artist"]["name"], got["total_found"], got["search_stats"]["artists_visited"]) == ("Unknown Artist", 0, 0)
    assert serve.respond(lib, "/api/artists/search?q=bill")[1]["results"][0]["name"] == "Billie Eilish"
    assert serve.respond(lib, "/api/stats") == (200, {"total_artists": 4}) and serve.respond(lib, "/health")[0] == 200
    assert serve.respond(lib, "/api/artist/F")[1]["name"] == "FINNEAS" and serve.respond(lib, "/api/artist/random")[1]["id"] in NAMES
    for url, want in (("/api/path?from_id=T", 400), ("/api/path?from_id=T&to_id=B&max_relations=x", 400), ("/api/path?from_id=T&to_id=B&min_similarity=2", 400), ("/api/explore", 400), ("/api/artists/search", 400), ("/api/artist/none", 404), ("/nothing", 404)):
        assert serve.respond(lib, url)[0] == want


def test_server(lib):
    server = serve.serve(lib, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/stats") as r:
        assert json.load(r) == {"total_artists": 4}
    server.shutdown()


def test_command_line(spark, folder, tmp_path, capsys):
    run = lambda *a: (cli.main(["--data-path", folder, *a], spark), capsys.readouterr().out)
    code, out = run("path", "taylor swift", "finneas", "-s", "-u", "-v", "-i")
    assert code == 0 and out.startswith("Taylor Swift → Olivia Rodrigo → Billie Eilish → FINNEAS\n1. Taylor Swift  T\n2. Olivia Rodrigo  [1.000]  O") and "visited" in out
    assert run("path", "taylor swift", "finneas", "-q", "-w") == (0, "Taylor Swift → Olivia Rodrigo → Billie Eilish → FINNEAS\n")
    assert json.loads(run("path", "taylor swift", "finneas", "--json")[1])["result"]["steps"] == 3
    assert run("path", "taylor swift", "finneas", "-m", "0.9")[1].startswith("No path")
    assert run("path", "nobody", "finneas")[0] == run("explore", "nobody")[0] == 1
    assert "Billie" in run("search", "bill")[1] and len(json.loads(run("explore", "finneas", "--budget", "2")[1])["nodes"]) == 2
    assert json.loads(run("metrics")[1])["counts"]["edges"] == 6
    assert run("subgraph", f"{tmp_path}/part", "--share", "0.5")[0] == 0
    assert run("compare", "--sub-path", f"{tmp_path}/part", "--output", f"{tmp_path}/c.json")[0] == 0
    assert json.loads((tmp_path / "c.json").read_text())["sizes"]["node_ratio"] <= 1


def test_client(spark):
    asked, fails = [], {"n": 2}

    def get(url):
        asked.append(url)
        if fails["n"]:
            fails["n"] -= 1
            raise Transient(url)
        return '{"error": 6}' if "mbid=" in url else json.dumps({"similarartists": {"artist": [{"name": "B", "mbid": "", "url": "u/b", "match": "0.5"}]}}) if "getsimilar" in url else None

    now = [0.0]
    c = client.Client(get, "k", client.Memory(2, 100, lambda: now[0]), sleep=lambda s: None)
    body = c.similar("m-1", "A & B")
    assert len(asked) == 4 and "artist=A%20%26%20B" in asked[-1] and "api_key=k" in asked[-1]
    assert service.similar(spark.createDataFrame([("x", body)], "id string, body string")).select("name", "sim").collect() == [("B", 0.5)]
    c.similar("m-1", "A & B")
    assert len(asked) == 4  # from memory
    now[0] = 200.0
    c.similar("m-1", "A & B")
    assert len(asked) == 6  # too old
    assert c.preview("a b", "c & d") is None and "term=a+b+c+and+d&" in asked[-1]
    assert c.info("x") is None and c.top_tracks("x") is None and "limit=5" in asked[-1]
    kept = client.recorded(spark.createDataFrame([(asked[3], "body")], "url string, body string"))
    assert client.Client(kept, "k").similar(None, "nobody") is None and kept(asked[3]) == "body"
