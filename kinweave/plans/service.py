"""Registered queries of files, service answers, caches and entry points, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api, config
from ..functions import text, values
from ..operators import edges, metrics, paths, render, sample, search
from ..sources import adapters, ndjson, packed, service, tables
from ..store import shared_dir, table
from ..streaming import crawl
from .queries import _AS_UID, _HOP, _UID, BUDGET, START, SUPPLIERS, TARGET, TOP, VIEWS, _explore, _hop_path, _levels, _uid, query, r6

_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({}))"
#: A supplier's UUID, made from "n/" and its key.
_KEYED = f"k AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal, {_UID.format('')} AS uid FROM (SELECT *, {_SHA.format(chr(39) + 'n/' + chr(39) + ' || s_suppkey')} AS h FROM supplier))"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").withColumn("uid", _uid("s_suppkey"))


def _uid_view(spark: SparkSession, sf_dir: str, reverse: bool = False) -> DataFrame:
    v = adapters.supplier_view(spark, sf_dir, TOP, reverse=reverse)
    return v.select(_uid("src").alias("src"), _uid("dst").alias("dst"), F.col("sim").cast("float").alias("sim"))


# --- files


@query(f"WITH {_KEYED} SELECT uid AS id, s_name || ' new' AS name, 'u/' || s_suppkey AS url FROM k")
def ndjson_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records of each entity, of which the last counts, with lines between them that are no records."""
    at = _folder(spark, "metadata")
    line = lambda name: F.to_json(F.struct(F.col("uid").alias("id"), name.alias("name"), F.concat(F.lit("u/"), F.col("s_suppkey").cast("string")).alias("url")))
    lines = F.concat_ws("\n", line(F.concat("s_name", F.lit(" old"))), F.lit(""), F.lit('{"id": "no uuid", "name": "x"}'), F.lit("{broken"), line(F.concat("s_name", F.lit(" new"))))
    _suppliers(spark, sf_dir).select(lines.alias("value")).write.text(at)
    return ndjson.read_entities(spark, at)


@query(f"WITH {_KEYED} SELECT uid AS id, s_name AS name, CAST(NULL AS VARCHAR) AS url FROM k WHERE s_nationkey < 5 UNION ALL SELECT uid, s_name, 'u/' || s_suppkey FROM k WHERE s_nationkey >= 5")
def ndjson_metadata_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities appended in two writes."""
    at = _folder(spark, "entities")
    s = _suppliers(spark, sf_dir).select("s_nationkey", F.col("uid").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") >= 5, F.concat(F.lit("u/"), F.col("s_suppkey").cast("string"))).alias("url"))
    for part in (s.where("s_nationkey < 5"), s.where("s_nationkey >= 5")):
        ndjson.write_entities(part, at)
    return ndjson.read_entities(spark, at)


@query("SELECT CAST(3 * count(*) + count(*) FILTER (s_nationkey < 9) AS BIGINT) AS lines, CAST(count(*) + count(*) FILTER (s_nationkey < 9) AS BIGINT) AS malformed, count(*) AS invalid_ids, 75.0::DOUBLE AS saved_percent FROM supplier")
def ndjson_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file, those that are no records and those whose id is no UUID; space saved by a copy a quarter its size."""
    at = _folder(spark, "counted")
    good = F.concat(F.lit('{"id":"'), "uid", F.lit('","connections":[]}'))
    lines = F.concat_ws("\n", good, F.lit('{"id":"none","connections":[]}'), F.lit("  "), F.lit("{"), F.when(F.col("s_nationkey") < 9, "[]"))
    _suppliers(spark, sf_dir).select(lines.alias("value")).write.text(at)
    sizes = tables.sizes(spark.read.text(at), 25, 100)
    return ndjson.rejected(spark, at).crossJoin(sizes.select("saved_percent"))  # one row and one row


@query(f"WITH {VIEWS}, {_AS_UID.replace('FROM f', 'FROM r')} SELECT src, dst, round(CAST(CAST(sim AS FLOAT) AS DOUBLE), 6) AS sim FROM u")
def packed_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "packed-reverse")
    packed.write_adjacency(_uid_view(spark, sf_dir, True), at, 3)
    return packed.read_adjacency(spark, at).select("src", "dst", r6(F.col("sim").cast("double")).alias("sim"))


@query(f"WITH {VIEWS}, {_AS_UID} SELECT src AS id, dst, round(CAST(CAST(sim AS FLOAT) AS DOUBLE), 6) AS sim FROM u WHERE src < '8'")
def packed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of half the owners, read at their offsets."""
    at = _folder(spark, "packed-lookup")
    index = packed.write_adjacency(_uid_view(spark, sf_dir), at, 4)
    return packed.lookup_lists(spark, at, index.where("id < '8'")).select("id", "dst", r6(F.col("sim").cast("double")).alias("sim"))


@query(f"WITH {VIEWS}, {_AS_UID}, n AS (SELECT src AS id, CAST(count(*) AS INTEGER) AS connections FROM u GROUP BY 1) SELECT id, connections FROM n")
def packed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.write_adjacency(_uid_view(spark, sf_dir), _folder(spark, "packed-index")).select("id", "connections")


def _metadata(spark: SparkSession, sf_dir: str) -> str:
    at = _folder(spark, "packed-metadata")
    s = _suppliers(spark, sf_dir).select(F.col("uid").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("u/"), F.col("s_suppkey").cast("string")).alias("url"), F.col("s_nationkey"), "s_suppkey")
    lookup = s.groupBy(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("name")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    index = s.select("id", (F.col("s_suppkey") * 5_000_000_000).alias("offset"))
    packed.write_metadata(spark, at, s, lookup, index, index)
    return at


@query(f"WITH {_KEYED} SELECT uid AS id, s_name AS name, 'u/' || s_suppkey AS url FROM k")
def packed_metadata_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.read_metadata(spark, _metadata(spark, sf_dir), "entities")


@query(f"WITH {_KEYED} SELECT 'nation ' || s_nationkey AS name, string_agg(uid, ',' ORDER BY uid) AS ids FROM k GROUP BY s_nationkey")
def packed_metadata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.read_metadata(spark, _metadata(spark, sf_dir), "lookup").select("name", F.concat_ws(",", "ids").alias("ids"))


@query(f"WITH {_KEYED} SELECT uid AS id, CAST(s_suppkey * 5000000000 AS BIGINT) AS forward, CAST(s_suppkey * 5000000000 AS BIGINT) AS reverse FROM k")
def packed_metadata_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _metadata(spark, sf_dir)
    f, r = (packed.read_metadata(spark, at, x).withColumnRenamed("offset", x) for x in ("forward", "reverse"))
    return f.join(r, "id")


@query("SELECT s_suppkey AS id, s_name AS name, epoch(TIMESTAMP '1998-01-01')::BIGINT + s_suppkey AS last_fetched FROM supplier")
def cache_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of two versions of a cache."""
    at = _folder(spark, "cache")
    rows = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.lit(883612800) + F.col("s_suppkey")).cast("long").alias("last_fetched"))
    tables.snapshot(rows.limit(1), at)
    tables.snapshot(rows, at)
    return tables.load_snapshot(spark, at, rows.schema)


@query("SELECT p_size AS value, count(*) AS count, (SELECT least(count(*), 5000) FROM part) AS sampled FROM part GROUP BY 1")
def distribution_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distribution as written, with the number of rows of its sample."""
    at = _folder(spark, "distribution")
    tables.write_distribution(_read(spark, sf_dir, "part").select("p_size"), "p_size", at)
    n = spark.read.json(f"{at}/p_size_sample").count()
    return metrics.histogram(spark.read.parquet(f"{at}/p_size"), "p_size").withColumn("sampled", F.lit(n).cast("long"))


@query(f"WITH {SUPPLIERS}, c AS (SELECT (SELECT count(DISTINCT id) FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT src) FROM edges) AS sources) SELECT *, round(edges / (CAST(nodes AS DOUBLE) * (nodes - 1)), 9) AS density FROM c")
def metrics_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "metrics")
    tables.write_metrics(metrics.graph_counts(adapters.supplier_edges(spark, sf_dir)), at)
    return spark.read.json(at).select("nodes", "edges", "sources", F.round("density", 9).alias("density"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_nationkey < 12 AS processed FROM supplier WHERE s_nationkey < 20")
def crawl_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "crawl-state")
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_nationkey")
    crawl.save_state(spark, at, s.where("s_nationkey < 12"), s.where("s_nationkey between 12 and 19"))
    done, queue = crawl.load_state(spark, at)
    return done.withColumn("processed", F.lit(True)).union(queue.withColumn("processed", F.lit(False)))


@query(f"WITH {VIEWS}, {_AS_UID} SELECT src, dst, round(CAST(CAST(sim AS FLOAT) AS DOUBLE), 6) AS sim FROM u")
def stream_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of NDJSON files, by a stream that takes what there is."""
    at, out = _folder(spark, "stream"), _folder(spark, "streamed")
    ndjson.write_graph(edges.adjacency(_uid_view(spark, sf_dir)), at)
    crawl.stream_edges(spark, at, out, _folder(spark, "checkpoint"), {"availableNow": True}).awaitTermination()
    return spark.read.parquet(out).select("src", "dst", r6(F.col("sim").cast("double")).alias("sim"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS id, min(o_orderpriority) AS name, lower(min(o_orderpriority)) AS clean FROM orders GROUP BY 1")
def stream_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity once, by a stream over files with repeated ids."""
    at, out = _folder(spark, "stream"), _folder(spark, "streamed")
    _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name")).write.json(at)
    crawl.stream_entities(spark, at, out, _folder(spark, "checkpoint"), {"availableNow": True}).awaitTermination()
    return spark.read.parquet(out).select("id", "name", "clean")


# --- answers of services

_PART = "SELECT p_partkey AS id, p_name, p_size, p_type, p_brand, p_retailprice FROM part"


@query(f"WITH p AS ({_PART}) SELECT id AS src, CASE WHEN p_size % 3 = 0 THEN '0000000' || (p_size % 10) || '-0000-4000-8000-000000000000' ELSE {_UID.format('')} END AS dst, round(CAST(CAST(p_size / 50 AS FLOAT) AS DOUBLE), 6) AS sim, 0 AS pos, p_name AS name FROM (SELECT *, {_SHA.format(chr(39) + 'u/' + chr(39) + ' || p_brand')} AS h FROM p) WHERE p_size % 5 <> 0")
def service_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar artists: an id given, one made from the URL, an entry with neither, and errors."""
    p = _read(spark, sf_dir, "part")
    mbid = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("0000000"), (F.col("p_size") % 10).cast("string"), F.lit("-0000-4000-8000-000000000000"))).otherwise("")
    one = F.struct(F.col("p_name").alias("name"), mbid.alias("mbid"), F.concat(F.lit("u/"), "p_brand").alias("url"), (F.col("p_size") / 50).cast("string").alias("match"))
    none = F.struct(F.lit("nobody").alias("name"), F.lit("").alias("mbid"), F.lit("").alias("url"), F.lit("0.5").alias("match"))
    body = F.when(F.col("p_size") % 5 == 0, F.when(F.col("p_size") % 2 == 0, '{"error": 6, "message": "not found"}').otherwise("<html>")).otherwise(F.to_json(F.struct(F.struct(F.array(one, none).alias("artist")).alias("similarartists"))))
    return service.similar(p.select(F.col("p_partkey").alias("id"), body.alias("body"))).select("src", "dst", r6(F.col("sim").cast("double")).alias("sim"), "pos", "name")


@query(f"WITH p AS ({_PART}) SELECT id, CASE WHEN p_size % 5 <> 0 THEN p_name END AS name, CASE WHEN p_size % 5 <> 0 THEN 'i/' || p_size END AS image, CASE WHEN p_size % 5 <> 0 THEN p_type || ',' || p_brand END AS tags, CASE WHEN p_size % 5 <> 0 AND p_size % 2 = 0 THEN 'about ' || p_name END AS bio FROM p")
def service_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist info: first large or medium image, tags, a bio without its closing link; errors give nulls."""
    p = _read(spark, sf_dir, "part")
    image = lambda size, url: F.struct(url.alias("#text"), F.lit(size).alias("size"))
    artist = F.struct(
        F.col("p_name").alias("name"), F.concat(F.lit("u/"), "p_brand").alias("url"), F.array(image("small", F.lit("s")), image("large", F.concat(F.lit("i/"), F.col("p_size").cast("string"))), image("medium", F.lit("m"))).alias("image"),
        F.struct(F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.col("p_brand").alias("name"))).alias("tag")).alias("tags"),
        F.struct(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("about "), "p_name", F.lit(" Read more on Last.fm"))).otherwise(" Read more on Last.fm").alias("summary")).alias("bio"),
    )
    body = F.when(F.col("p_size") % 5 == 0, '{"error": 6}').otherwise(F.to_json(F.struct(artist.alias("artist"))))
    return service.info(p.select(F.col("p_partkey").alias("id"), body.alias("body"))).select("id", "name", F.col("lastfm.image_url").alias("image"), F.concat_ws(",", "lastfm.tags").alias("t"), F.col("lastfm.bio_summary").alias("bio"), F.col("lastfm").isNotNull().alias("ok")).select("id", "name", "image", F.when(F.col("ok"), F.col("t")).alias("tags"), "bio")


@query("SELECT p_partkey AS id, p_name || ' ' || k AS name, CAST(k AS VARCHAR) AS playcount FROM part, range(7) t(k) WHERE k < 5")
def service_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of seven tracks."""
    p = _read(spark, sf_dir, "part")
    track = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.struct(F.concat("p_name", F.lit(" "), k.cast("string")).alias("name"), F.lit("u").alias("url"), k.cast("string").alias("playcount"), F.lit("1").alias("listeners")))
    body = F.to_json(F.struct(F.struct(track.alias("track")).alias("toptracks")))
    return service.tracks(p.select(F.col("p_partkey").alias("id"), body.alias("body"))).select("id", "name", "playcount")


@query("SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 3 <> 0 THEN 'p/' || p_size END AS preview_url FROM part")
def service_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview of the first result; none without results."""
    p = _read(spark, sf_dir, "part")
    hit = lambda u: F.struct(F.col("p_name").alias("trackName"), u.alias("previewUrl"))
    results = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<struct<trackName:string,previewUrl:string>>")).otherwise(F.array(hit(F.concat(F.lit("p/"), F.col("p_size").cast("string"))), hit(F.lit("other"))))
    return service.preview(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.to_json(F.struct(results.alias("results"))).alias("body"), F.lit(1).alias("n"))).select("id", "name", "preview_url")


@query(f"SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'given-' || s_suppkey ELSE {_UID.format('')} END AS id, s_name AS name FROM (SELECT *, {_SHA.format(chr(39) + 'u/' + chr(39) + ' || s_suppkey')} AS h FROM supplier) WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 <> 0")
def resolved_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of answers: given, made from the URL, or none (the row goes)."""
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    answers = s.select(F.when(k % 3 == 0, F.concat(F.lit("given-"), k.cast("string"))).when(k % 2 == 0, "").alias("mbid"), F.when(k % 5 != 0, F.concat(F.lit("u/"), k.cast("string"))).alias("url"), F.col("s_name").alias("name"), k)
    named = crawl.resolve_answers(answers)
    return named.join(answers.select("name", k.alias("key")), "name").select("key", "id", "name")


def _flaky(ident: str) -> list[tuple[str, float]] | None:
    """Fails twice for even ids, for ever for those that end in 7; has no answer for those that end in 9."""
    n = _flaky.tries[ident] = _flaky.tries.get(ident, 0) + 1
    if ident.endswith("7") or (int(ident) % 2 == 0 and n <= 2):
        raise crawl.Transient(ident)
    return None if ident.endswith("9") else [(f"{ident}x", 0.25), (f"{ident}y", 0.5)]


_flaky.tries = {}


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 10 NOT IN (7, 9) THEN s_suppkey || x END AS dst, CASE WHEN s_suppkey % 10 NOT IN (7, 9) THEN CAST(sim AS DOUBLE) END AS sim FROM supplier, (VALUES ('x', 0.25), ('y', 0.5)) t(x, sim) WHERE s_suppkey % 10 NOT IN (7, 9) OR x = 'x'")
def fetched_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers fetched within tasks from a client that often fails."""

    def client(ident: str) -> list[tuple[str, float]] | None:
        return crawl.with_retry(lambda: _flaky(ident), sleep=lambda s: None)

    ids = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    return crawl.fetch(ids, client, concurrency=4).select("id", "dst", F.nanvl("sim", F.lit(None).cast("double")).alias("sim"))


@query("SELECT o_custkey AS id, arg_min(o_orderpriority, o_orderkey) AS name FROM orders GROUP BY 1")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("line"))
    return crawl.first_seen(o)


# --- functions


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE u END AS canonical, p_partkey % 6 <> 5 AND p_size % 2 = 0 AS real_id FROM (SELECT *, printf('%08x-1234-%s234-8abc-%012x', p_partkey, CASE WHEN p_size % 2 = 0 THEN '4' ELSE '5' END, p_size) AS u FROM part)")
def uuid_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UUIDs in six notations, one of them none; those of version 5 were derived from a name."""
    p, k = _read(spark, sf_dir, "part"), F.col("p_partkey") % 6
    u = F.format_string("%08x-1234-%s234-8abc-%012x", "p_partkey", F.when(F.col("p_size") % 2 == 0, "4").otherwise("5"), F.col("p_size").cast("long"))
    form = F.when(k == 0, u).when(k == 1, F.upper(u)).when(k == 2, F.concat(F.lit("{"), u, F.lit("}"))).when(k == 3, F.concat(F.lit("urn:uuid:"), u)).when(k == 4, F.replace(u, F.lit("-"), F.lit(""))).otherwise(F.concat(u, F.lit("0")))
    return p.select(F.col("p_partkey").alias("id"), text.canonical_uuid(form).alias("canonical"), text.is_real_mbid(form).alias("real_id"))


@query("SELECT p_partkey AS id, p_size % 3 <> 0 AS has_preview, CASE WHEN p_size % 4 <> 0 THEN 'm' || p_size END AS image FROM part")
def preview_and_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    track = lambda c: F.struct(F.lit("t").alias("name"), c.alias("preview_url"))
    tracks = F.array(track(F.lit(None).cast("string")), track(F.when(F.col("p_size") % 3 != 0, "u")))
    image = lambda size, url: F.struct(F.lit(size).alias("size"), url.alias("url"))
    images = F.array(image("small", F.lit("s")), image("medium", F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("m"), F.col("p_size").cast("string"))).otherwise("")), image("large", F.lit("l")))
    return p.select(F.col("p_partkey").alias("id"), values.has_preview(tracks).alias("has_preview"), values.first_image(images).alias("image"))


_SPELT = [
    ("AC/DC", "ac/dc"), ("  Björk \t Guðmundsdóttir ", "bjork gudmundsdottir"), ("LØLØ", "lolo"), ("Кино", "kino"), ("Βαγγέλης", "baggeles"), ("北京 Band", "bei jing band"), ("한국", "hangug"),
    ("おんがく", "ongaku"), ("カタカナ", "katakana"), ("שלום", "shlvm"), ("العربية", "l`rby@"), ("Мумий Тролль", "mumii troll'"), ("☆ star", "☆ star"), ("", ""), ("🎸x", "🎸x"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in _SPELT) + ") t(name, clean)")
def clean_names_of_all_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(a,) for a, _ in _SPELT], "name string")
    return names.select("name", text.clean_name(F.col("name")).alias("clean"))


@query("SELECT * FROM (VALUES ('bfs', 'BFS'), ('Dijkstra', 'DIJKSTRA'), (' DIJKSTRA ', 'DIJKSTRA'), ('simple', 'BFS'), ('', 'BFS')) t(name, algorithm)")
def algorithm_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ["bfs", "Dijkstra", " DIJKSTRA ", "simple", ""]
    return spark.createDataFrame([(n, config.Algorithm.parse(n).name) for n in given], "name string, algorithm string")


@query("SELECT o_orderkey AS id, (epoch(TIMESTAMP '1998-08-01') - epoch(o_orderdate)) < 86400 AS fresh FROM orders")
def memory_cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), values.is_fresh(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), F.unix_timestamp(F.lit("1998-08-01 00:00:00")), values.MEMORY_TTL_SECONDS).alias("fresh"))


@query(f"WITH {VIEWS}, n AS (SELECT s_suppkey AS id FROM supplier WHERE s_nationkey < 12) SELECT src AS \"from\", dst AS \"to\" FROM f WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def edges_without_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _read(spark, sf_dir, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("id"))
    return render.without_dangling(nodes, adapters.supplier_view(spark, sf_dir, TOP).select(F.col("src").alias("from"), F.col("dst").alias("to")))


@query(f"WITH {VIEWS}, c AS (SELECT (SELECT count(*) FROM supplier) AS n, (SELECT count(*) FROM f) AS e) SELECT n <= 500 AND e <= 2000 AS usual, n <= n AND e <= e AS wide, true AS forced FROM c")
def large_result_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e = adapters.suppliers(spark, sf_dir), adapters.supplier_view(spark, sf_dir, TOP)
    wide = render.drawable(nodes, e, nodes.count(), e.count())
    return spark.createDataFrame([(render.drawable(nodes, e), wide, render.drawable(nodes, e, 1, 1, force=True))], "usual boolean, wide boolean, forced boolean")


# --- samples


@query(f"WITH {SUPPLIERS}, d AS (SELECT src AS id, count(*) AS degree FROM edges GROUP BY 1) SELECT id FROM d ORDER BY degree DESC, id LIMIT 40")
def seeds_all_sure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of which none is drawn."""
    return sample.seeds(metrics.out_degree(adapters.supplier_edges(spark, sf_dir)), top=100, number=40, sure=1.0)


@query(f"WITH {SUPPLIERS} SELECT least(1000, (SELECT count(*) FROM edges)) AS rows, least(1000, (SELECT count(*) FROM edges)) AS known, least(40, (SELECT count(*) FROM supplier)) AS seeds, true AS walked FROM (SELECT 1)")
def sample_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a reservoir: its rows, and how many distinct ones are edges; seeds among the top; whether a walk sample has its size and only known nodes."""
    e = adapters.supplier_edges(spark, sf_dir)
    d = metrics.out_degree(e)
    got = table(sample.reservoir(e, 1000, 7), "reservoir")
    known = e.select("src", "dst").join(F.broadcast(got.select("src", "dst")), ["src", "dst"], "left_semi").distinct().count()  # the drawn edges are few
    seeds = sample.seeds(d, top=100, number=40).join(d.orderBy(F.col("degree").desc(), "id").limit(100), "id", "left_semi").distinct().count()
    nodes, n = table(sample.walk_subgraph(e, d), "walked"), d.count()
    size = nodes.join(d, "id", "left_semi").distinct().count()
    return spark.createDataFrame([(got.count(), known, seeds, nodes.count() == size <= max(1, int(n * 0.2)) and size >= 0.9 * int(n * 0.2))], "rows long, known long, seeds long, walked boolean")


@query("SELECT CAST(1 AS BIGINT) AS rows, CAST(1 AS BIGINT) AS known, true AS same FROM (SELECT 1)")
def random_entity_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.parts(spark, sf_dir)
    one, again = (search.random_entity(p, 3).collect() for _ in range(2))
    return spark.createDataFrame([(len(one), p.where(F.col("id") == one[0]["id"]).count(), one == again)], "rows long, known long, same boolean")


# --- crawl and searches as a service gives them


@query(f"WITH RECURSIVE {VIEWS}, {_levels('df', 'f', START)} SELECT CAST(src AS VARCHAR) AS id, count(*) AS edges FROM f WHERE src IN (SELECT id FROM df) GROUP BY 1")
def crawl_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl by batches of 16, whose saved state holds all it has asked for."""
    v = adapters.supplier_view(spark, sf_dir, TOP)
    recorded = table(edges.adjacency(v.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "sim")), "recorded")
    state = _folder(spark, "crawl")
    got = crawl.crawl(recorded, [str(START)], batch=16, save=state)
    done, queue = crawl.load_state(spark, state)
    assert queue.isEmpty()
    return got.join(done, "id", "left_semi").groupBy("id").agg(F.count("*").alias("edges"))


@query(f"WITH RECURSIVE {VIEWS}, {_levels('df', 'f', START)}, n AS (SELECT src, count(*) AS c FROM f WHERE src <> dst GROUP BY 1) SELECT level, count(*) AS nodes, CAST(coalesce(sum(c), 0) AS BIGINT) AS edges FROM df LEFT JOIN n ON n.src = df.id GROUP BY 1")
def hop_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = adapters.supplier_view(spark, sf_dir, TOP)
    return paths.profile(v, paths._ids(spark, v, START))


def _library(spark: SparkSession, sf_dir: str) -> api.Library:
    return api.Library(adapters.supplier_edges(spark, sf_dir), adapters.suppliers(spark, sf_dir))


@query(f"{_HOP} SELECT step, id, s_name AS name, 'https://supplier.example/' || id AS url, round(similarity, 6) AS similarity FROM path LEFT JOIN supplier ON s_suppkey = id")
def api_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.find_path(_library(spark, sf_dir), START, TARGET).withColumn("similarity", r6("similarity"))


@query(f"{_HOP} SELECT step, id FROM path")
def api_path_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"supplier#{n:09d}" for n in (START, TARGET)]
    return api.find_path_by_name(_library(spark, sf_dir), *names).select("step", "id")


_EXPLORED = f"{_explore('f')}, known AS (SELECT id, layer FROM nodes JOIN supplier ON s_suppkey = id)"


@query(f"{_EXPLORED} SELECT id, layer, (SELECT count(*) FROM known) AS artists_visited FROM known")
def api_explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = api.explore(_library(spark, sf_dir), START, budget=BUDGET)
    visited = got["search_stats"].first()["artists_visited"]
    return got["nodes"].select("id", "layer").withColumn("artists_visited", F.lit(visited).cast("long"))


@query(f"{_HOP} SELECT 'success' AS status, (SELECT CAST(count(*) AS INTEGER) FROM path) AS path_length, true AS all_seen, true AS timed FROM (SELECT 1)")
def api_enhanced_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of a path with its neighbourhood; its search has seen all steps and says how long it took."""
    got = api.enhanced_path(_library(spark, sf_dir), START, TARGET, budget=BUDGET)
    stats, status = got["search_stats"].first(), got["status"].first()
    return spark.createDataFrame([(status["status"], status["path_length"], stats["artists_visited"] >= status["path_length"], stats["duration_ms"] >= 0)], "status string, path_length int, all_seen boolean, timed boolean")


@query(f"WITH RECURSIVE {VIEWS.replace(f'rk <= {TOP})', 'rk <= 5)')}, {_levels('df', 'f', START)}, {_levels('dr', 'r', TARGET)}, b AS (SELECT min(df.level + dr.level) AS n FROM df JOIN dr ON df.id = dr.id) SELECT count(*) AS artists_visited FROM (SELECT id FROM df, b WHERE level <= least(n, (SELECT max(level) FROM df)) UNION SELECT id FROM dr, b WHERE level <= least(n, (SELECT max(level) FROM dr)))")
def api_search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that a path search over lists of five has seen: both sweeps, as deep as the path is long."""
    lib = _library(spark, sf_dir)
    return api.path_with_stats(lib, START, TARGET, max_relations=5)["search_stats"].select("artists_visited")


@query("SELECT count(*) AS total_artists FROM supplier")
def api_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.stats(_library(spark, sf_dir))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE contains(lower(s_name), '00001') ORDER BY strlen(s_name), s_suppkey LIMIT 10")
def api_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.search(_library(spark, sf_dir), "00001").select("id", "name")


@query(f"SELECT s_suppkey AS id, s_name AS name, s_suppkey % 2 = 1 AS cached, CASE WHEN s_suppkey % 2 = 1 THEN 'url ' || s_suppkey END AS lastfm_url FROM supplier WHERE s_suppkey IN ({START}, {TARGET + 1})")
def api_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entities: one with fresh metadata, one whose metadata is too old."""
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    cache = s.select(k.alias("id"), F.when(k % 2 == 1, 2_000_000_000).otherwise(1).cast("long").alias("last_fetched"), F.struct(F.concat(F.lit("url "), k.cast("string")).alias("url")).alias("lastfm"), F.array().cast("array<struct<name:string>>").alias("tracks"))
    lib = api.Library(adapters.supplier_edges(spark, sf_dir), adapters.suppliers(spark, sf_dir), cache)
    found = [api.details(lib, i, F.lit(2_000_000_100)) for i in (START, TARGET + 1)]
    return found[0].union(found[1]).select("id", "name", "cached", F.col("lastfm.url").alias("lastfm_url"))


def _parsed(json: Column) -> Column:
    return F.from_json(json, F.lit("query string, result struct<found: boolean, path: array<struct<id: long, name: string, url: string, similarity_to_previous: double>>, steps: int>, stats struct<nodes_explored: int, search_time_ms: int>"))


@query(f"{_HOP} SELECT 'a -> b' AS query, true AS found, CAST(count(*) - 1 AS INTEGER) AS steps, string_agg(id || ' ' || s_name || ' ' || coalesce(printf('%.6f', similarity), ''), ';' ORDER BY step) AS path, 10 AS nodes_explored, 1567 AS search_time_ms FROM path JOIN supplier ON s_suppkey = id")
def path_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a JSON result says, read back."""
    named = _hop_path(spark, sf_dir).join(adapters.suppliers(spark, sf_dir), "id")
    r = render.path_json(named, "a -> b", 10, 1.567).select(_parsed(F.col("json")).alias("r"))
    step = lambda s: F.concat_ws(" ", s["id"].cast("string"), s["name"], F.coalesce(F.format_string("%.6f", s["similarity_to_previous"]), F.lit("")))
    first = lambda s: F.when(s["similarity_to_previous"].isNull(), F.concat(s["id"].cast("string"), F.lit(" "), s["name"], F.lit(" "))).otherwise(step(s))
    return r.select("r.query", "r.result.found", "r.result.steps", F.concat_ws(";", F.transform("r.result.path", first)).alias("path"), "r.stats.nodes_explored", "r.stats.search_time_ms")
