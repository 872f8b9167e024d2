"""Files, caches and the crawl."""

import json
import uuid

from pyspark.sql import functions as F

from kinweave import schema
from kinweave.operators import edges, search
from kinweave.sources import ndjson, packed, tables
from kinweave.streaming import crawl

A, B, C = (str(uuid.UUID(int=k + 1)) for k in range(3))


def test_ndjson(spark, tmp_path):
    lines = [json.dumps({"id": A, "connections": [[B, 0.5], ["bad", 0.9], [C, 0.25]]}), "", "not json", '{"id":', json.dumps({"id": "bad", "connections": [[A, 1.0]]}), json.dumps({"id": A, "connections": [[C, 0.75]]}), json.dumps({"id": B, "connections": []})]
    (tmp_path / "g.ndjson").write_text("\n".join(lines))
    got = {tuple(r)[:3] for r in ndjson.read_edges(spark, str(tmp_path / "g.ndjson")).collect()}
    assert got == {(A, C, 0.75)}
    merged = {tuple(r)[:3] for r in ndjson.read_edges(spark, str(tmp_path / "g.ndjson"), last_wins=False).collect()}
    assert merged == {(A, B, 0.5), (A, C, 0.25), (A, C, 0.75)}
    assert tuple(ndjson.rejected(spark, str(tmp_path / "g.ndjson")).first()) == (6, 2, 1)
    (tmp_path / "m.ndjson").write_text("\n".join(json.dumps({"id": A, "name": n, "url": "u"}) for n in ("old", "new")))
    assert [tuple(r) for r in ndjson.read_entities(spark, str(tmp_path / "m.ndjson")).collect()] == [(A, "new", "u")]


def test_packed(spark, tmp_path):
    e = spark.createDataFrame([(A, B, 0.5), (A, C, 0.75), (B, A, 1.0)], "src string, dst string, sim float")
    index = packed.write_adjacency(e, f"{tmp_path}/bin", 1)
    assert {(r["id"], r["connections"]) for r in index.collect()} == {(A, 2), (B, 1)}
    back = packed.read_adjacency(spark, f"{tmp_path}/bin")
    assert {(r["src"], r["dst"], r["sim"], r["pos"]) for r in back.collect()} == {(A, C, 0.75, 0), (A, B, 0.5, 1), (B, A, 1.0, 0)}
    raw = packed.encode_record(A, [(B, 0.5)])
    assert packed.connections_at(raw, 0, A) == [(B, 0.5)]
    assert packed.connections_at(raw, 0, B) == packed.connections_at(raw, 99, A) == packed.connections_at(raw[:-1], 0, A) == []
    assert list(packed.decode_adjacency(raw + raw[:30])) == [(A, 0, [(B, 0.5)])]


def test_metadata(spark, tmp_path):
    sections = {"entities": [(A, "Björk", "u/a"), (B, "", "")], "lookup": [("bjork", [A, B])], "forward": [(A, 0), (B, 44)], "reverse": []}
    raw = packed.encode_metadata(sections["entities"], sections["lookup"], sections["forward"], sections["reverse"])
    assert packed.decode_metadata(raw) == sections
    (tmp_path / "m.bin").write_bytes(raw)
    assert packed.read_metadata(spark, f"{tmp_path}/m.bin", "entities").count() == 2
    assert packed.decode_metadata(packed.encode_metadata([], [], [], [])) == {"entities": [], "lookup": [], "forward": [], "reverse": []}


def test_store_and_snapshot(spark, tmp_path):
    e = spark.createDataFrame([(A, B, 0.5)], "src string, dst string, sim float")
    names = spark.createDataFrame([(A, "Björk", "u")], "id string, name string, url string")
    tables.write_graph(e, names, f"{tmp_path}/g")
    g = tables.read_graph(spark, f"{tmp_path}/g")
    assert g["edges_rev"].first()["src"] == B and g["name_lookup"].first()["clean"] == "bjork"
    assert tables.load_snapshot(spark, f"{tmp_path}/none", schema.CACHED).count() == 0
    cache = spark.createDataFrame([(A, "Björk", "u", 5, ("u", None, None, None, ["x"], None, None), None)], schema.CACHED)
    tables.snapshot(cache, f"{tmp_path}/c")
    tables.snapshot(cache.union(cache), f"{tmp_path}/c")
    back = tables.load_snapshot(spark, f"{tmp_path}/c", schema.CACHED)
    assert back.count() == 2
    d = search.details(names, back.limit(1), names.select("id"), F.lit(10)).first()
    assert d["cached"] and d["lastfm"]["tags"] == ["x"]
    stale = search.details(names, back.limit(1), names.select("id"), F.lit(10**9)).first()
    assert not stale["cached"]


def test_crawl(spark):
    recorded = edges.adjacency(spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("c", "d", 0.7)], "src string, dst string, sim double"))
    assert {r["id"] for r in crawl.crawl(recorded, ["a"]).collect()} == {"a", "b", "c"}
    assert {r["id"] for r in crawl.crawl(recorded, ["a"], most=2).collect()} == {"a", "b"}
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise crawl.Transient
        return "ok"

    assert crawl.with_retry(flaky, sleep=lambda s: None) == "ok" and len(tries) == 3


def test_state_and_streams(spark, tmp_path):
    one, two = (spark.createDataFrame([(x,)], "id string") for x in "ab")
    crawl.save_state(spark, f"{tmp_path}/state", one, two)
    done, queue = crawl.load_state(spark, f"{tmp_path}/state")
    assert (done.first()["id"], queue.first()["id"]) == ("a", "b")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "g.ndjson").write_text(json.dumps({"id": A, "connections": [[B, 0.5]]}) + "\nbroken\n")
    q = crawl.stream_edges(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", {"availableNow": True})
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(A, B, 0.5)]
    (tmp_path / "ents").mkdir()
    (tmp_path / "ents" / "m.ndjson").write_text("\n".join(json.dumps({"id": A, "name": n, "url": "u"}) for n in ("x", "x")))
    q = crawl.stream_entities(spark, f"{tmp_path}/ents", f"{tmp_path}/ents-out", f"{tmp_path}/cp2", {"availableNow": True})
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/ents-out").count() == 1


def test_service_answers(spark):
    from kinweave.sources import service

    body = json.dumps({"similarartists": {"artist": [{"name": "x", "mbid": B, "url": "u", "match": "0.5"}, {"name": "y", "mbid": "", "url": "https://a/y", "match": "1"}, {"name": "z", "match": "1"}]}})
    df = spark.createDataFrame([(A, body), (B, '{"error": 6}'), (C, "broken")], "id string, body string")
    got = [(r["dst"], r["sim"], r["pos"]) for r in service.similar(df).orderBy("pos").collect()]
    assert got == [(B, 0.5, 0), (str(uuid.uuid5(uuid.NAMESPACE_URL, "https://a/y")), 1.0, 1)]
    body = json.dumps({"artist": {"name": "x", "url": "u", "image": [{"#text": "s", "size": "small"}, {"#text": "", "size": "large"}], "stats": {"listeners": "5", "playcount": "9"}, "tags": {"tag": [{"name": "pop"}]}, "bio": {"summary": "Hi. Read more on Last.fm", "content": ""}}})
    row = service.info(spark.createDataFrame([(A, body), (B, '{"error": 6}')], "id string, body string")).orderBy("id").collect()
    assert row[0]["lastfm"].asDict() == {"url": "u", "image_url": None, "listeners": "5", "playcount": "9", "tags": ["pop"], "bio_summary": "Hi.", "bio_full": None}
    assert row[1]["lastfm"] is None
    body = json.dumps({"toptracks": {"track": [{"name": f"t{k}", "url": "u", "playcount": "1", "listeners": "2"} for k in range(7)]}})
    t = service.tracks(spark.createDataFrame([(A, body)], "id string, body string"))
    assert t.count() == 5
    found = service.preview(spark.createDataFrame([(A, "t0", '{"results": [{"previewUrl": "p"}]}', 0), (A, "t1", '{"results": []}', 1)], "id string, name string, body string, n int"))
    assert {(r["name"], r["preview_url"]) for r in search.zip_previews(t.where("name in ('t0', 't1', 't2')"), found).collect()} == {("t0", "p"), ("t1", None), ("t2", None)}
