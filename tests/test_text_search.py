"""Names, ids, search, rendering and functions of values."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from kinweave.config import Algorithm, PathConfig
from kinweave.functions import text, values
from kinweave.operators import compare, render, search

CLEAN = {"HELLO WORLD": "hello world", "Björk": "bjork", "Beyoncé": "beyonce", "LØLØ": "lolo", "Röyksopp": "royksopp", "AC/DC": "ac/dc", "Panic! At The Disco": "panic! at the disco", "blink-182": "blink-182", "   Taylor   Swift   ": "taylor swift", "The\t\tBeatles": "the beatles", "Pink\nFloyd": "pink floyd", "   ": "", "": "", "Straße": "strasse", "Кино": "kino", "Æon": "aeon", "ﬁre": "fire"}


def test_clean_name(spark):
    df = spark.createDataFrame([(k, v) for k, v in CLEAN.items()], "x string, want string").withColumn("got", text.clean_name(F.col("x")))
    assert {r["x"]: r["got"] for r in df.collect()} == CLEAN
    assert spark.range(1).select(text.clean_name(F.lit(None).cast("string")).alias("x")).first()["x"] is None


def test_ids(spark):
    urls = ["https://a.b/c", "https://www.example/Кино", ""]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", text.uuid5_url(F.col("u")).alias("got"))
    assert all(r["got"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["u"])) for r in df.collect())
    one = "20244d07-534f-4eff-b4d4-930878889970"
    forms = [one, one.upper(), f"{{{one}}}", f"urn:uuid:{one}", one.replace("-", "")]
    df = spark.createDataFrame([(f,) for f in [*forms, "nope", "", None]], "x string").select(text.canonical_uuid(F.col("x")).alias("u"), text.is_real_mbid(F.col("x")).alias("real"))
    rows = df.collect()
    assert [r["u"] for r in rows] == [one] * 5 + [None] * 3
    assert [r["real"] for r in rows] == [True] * 5 + [False] * 3
    got = spark.createDataFrame([("m", "u"), ("", "https://a.b/c"), (None, ""), (None, None)], "m string, u string").select(text.resolve_id(F.col("m"), F.col("u")).alias("x"))
    assert [r["x"] for r in got.collect()] == ["m", str(uuid.uuid5(uuid.NAMESPACE_URL, "https://a.b/c")), None, None]


def entities(spark):
    names = ["Taylor Swift", "Swift Boat", "Olivia Rodrigo", "Billie Eilish", "SWIFT", "Björk"]
    return search.name_index(spark.createDataFrame([(f"id{k}", n, f"u/{k}") for k, n in enumerate(names)], "id string, name string, url string"))


def test_search(spark):
    index = entities(spark)
    found = lambda q, n=10: [r["name"] for r in search.search(index, q, n).collect()]
    assert found("billie") == ["Billie Eilish"]
    assert found("") == found("   ") == []
    assert found("swift") == ["SWIFT", "Swift Boat", "Taylor Swift"]
    assert found("swift", 1) == ["SWIFT"]
    assert found("bjork") == ["Björk"]
    best = search.by_name(index, spark.createDataFrame([("swift",), ("bjork",), ("nobody",)], "query string"))
    assert {(r["query"], r["name"]) for r in best.collect()} == {("swift", "SWIFT"), ("bjork", "Björk")}
    assert search.random_entity(index.limit(0)).count() == 0


def test_ambiguous_names(spark):
    index = search.name_index(spark.createDataFrame([("1", "Muse", "", 0), ("2", "MUSE", "", 1)], "id string, name string, url string, pos int"))
    best = lambda q: search.by_name(index, spark.createDataFrame([(q,)], "query string")).first()["id"]
    assert best("MÜSE") == "1"
    assert best("muse") == "1"


def test_json_and_text(spark):
    path = spark.createDataFrame([(0, "a", "Alice", "u/a", None), (1, "b", "Bob", "u/b", 0.8), (2, "c", "Charlie", "u/c", 0.6)], "step int, id string, name string, url string, similarity double")
    got = json.loads(render.path_json(path, "q", 1234, 1.567).first()["json"])
    assert [s.get("similarity_to_previous") for s in got["result"]["path"]] == [None, 0.8, 0.6]
    assert "similarity_to_previous" not in got["result"]["path"][0]
    assert got["stats"] == {"nodes_explored": 1234, "search_time_ms": 1567}
    none = json.loads(render.path_json(path.limit(0), "q", 1, 0.0).first()["json"])
    assert none["result"] == {"found": False}
    t = render.path_text(path).first()
    assert t["flow"] == "Alice → Bob → Charlie"
    assert t["lines"].split("\n")[1] == "2. Bob [0.800]"


def test_values(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(values.thousands(F.lit(1234567))) == "1,234,567"
    assert get(values.form_encode(F.lit("a b*c~d&e"))) == "a%20b%2Ac~d%26e"
    assert get(values.search_term(F.lit("Simon & Co"), F.lit("x y"))) == "Simon+and+Co+x+y"
    assert get(values.clean_bio(F.lit(" Read more on Last.fm "))) is None
    images = F.array(*(F.struct(F.lit(s).alias("size"), F.lit(u).alias("url")) for s, u in (("small", "s"), ("large", "l"), ("medium", "m"))))
    assert get(values.first_image(images)) == "l"
    assert get(values.first_image(F.filter(images, lambda i: i["size"] == "small"))) is None
    assert get(values.is_fresh(F.lit(0), F.lit(values.TTL_SECONDS))) is False
    assert get(values.is_fresh(F.lit(1), F.lit(values.TTL_SECONDS))) is True
    assert get(values.relative_difference(F.lit(0.0), F.lit(0.0))) == 0.0
    assert get(values.relative_difference(F.lit(0.0), F.lit(1.0))) == float("inf")
    assert [get(values.effect_label(F.lit(x))) for x in (0.1, 0.3, -0.6, 0.9)] == ["Negligible", "Small", "Medium", "Large"]


def test_config():
    assert [Algorithm.parse(x) for x in ("BFS", "Dijkstra", "what", None)] == [Algorithm.BFS, Algorithm.DIJKSTRA, Algorithm.BFS, Algorithm.BFS]
    assert (PathConfig().top_related, PathConfig().min_match, PathConfig(weighted=True).algorithm) == (80, 0.0, Algorithm.DIJKSTRA)


@pytest.mark.parametrize(("a", "b"), [([1, 2, 2, 3], [2, 3, 4]), ([1.0], [1.0]), ([5, 5, 5], [1, 2])])
def test_two_samples(spark, a, b):
    both = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "side string, x double")
    ks = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in a + b)
    assert abs(compare.ks_statistic(both).first()["ks"] - ks) < 1e-12
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    assert abs(compare.mann_whitney(both).first()["u"] - u) < 1e-9


def test_drawing(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b", 0.5), ("a", "x", 0.5)], "from string, to string, similarity double")
    assert render.without_dangling(nodes, e).count() == 1
    assert render.drawable(nodes, e) and not render.drawable(nodes, e, 1) and render.drawable(nodes, e, 1, force=True)


def test_empty_samples(spark):
    for rows in ([("a", 1.0), ("a", 2.0)], []):
        both = spark.createDataFrame(rows, "side string, x double")
        assert compare.ks_statistic(both).first()["ks"] is None and compare.levene(both).first()["p_value"] is None
        compare.mann_whitney(both).collect(), compare.cohens_d(both).collect()


def test_p_values():
    assert abs(compare.normal_two_sided(1.959963985) - 0.05) < 1e-9
    assert abs(compare.kolmogorov_sf(1.3580986) - 0.05) < 1e-6 and compare.kolmogorov_sf(0.0) == 1.0
    assert abs(compare.f_sf(4.0, 1, 10) - 0.0733880) < 1e-6 and abs(compare.f_sf(1.0, 5, 5) - 0.5) < 1e-12 and compare.f_sf(1e9, 1, 100) < 1e-12
