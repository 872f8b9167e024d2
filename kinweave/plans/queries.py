"""Registered queries of the graph engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import compare, edges, explore, metrics, neighborhood, paths, render, sample, search
from ..sources import adapters, ndjson
from ..store import built, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
START, TARGET, TOP, BUDGET = 1, 7, 80, 20


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _graph(column: str) -> str:
    return f"""pairs AS (SELECT DISTINCT l_orderkey AS item, {column} AS thing FROM lineitem),
co AS (SELECT a.thing AS src, b.thing AS dst, count(*) AS n FROM pairs a JOIN pairs b ON a.item = b.item AND a.thing <> b.thing GROUP BY 1, 2),
edges AS (SELECT src, dst, n / max(n) OVER (PARTITION BY src) AS sim FROM co)"""


SUPPLIERS, PARTS = _graph("l_suppkey"), _graph("l_partkey")
_RANK = "SELECT * FROM (SELECT src, dst, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rk FROM {t}{w}) WHERE rk <= {n}"
VIEWS = f"""{SUPPLIERS},
f AS ({_RANK.format(t="edges", w="", n=TOP)}),
r AS ({_RANK.format(t="(SELECT dst AS src, src AS dst, sim FROM edges)", w="", n=TOP)})"""


# --- views of the edges


@query(f"WITH {SUPPLIERS} SELECT src, dst, round(sim, 6) AS sim, CAST(rk AS INTEGER) AS rk FROM ({_RANK.format(t='edges', w='', n=10)})")
def top_edges_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.top_edges(adapters.supplier_edges(spark, sf_dir), 0.0, 10).select("src", "dst", r6("sim").alias("sim"), "rk")


@query(f"WITH {SUPPLIERS} SELECT src, dst, round(sim, 6) AS sim, CAST(rk AS INTEGER) AS rk FROM ({_RANK.format(t='edges', w=' WHERE sim >= 0.75', n=5)})")
def top_edges_min_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.top_edges(adapters.supplier_edges(spark, sf_dir), 0.75, 5).select("src", "dst", r6("sim").alias("sim"), "rk")


@query(f"WITH {SUPPLIERS} SELECT src, dst, round(CAST(CAST(sim AS FLOAT) AS DOUBLE), 6) AS sim FROM edges WHERE CAST(sim AS FLOAT) >= CAST(0.7 AS FLOAT)")
def float_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.supplier_edges(spark, sf_dir).withColumn("sim", F.col("sim").cast("float"))
    return e.where(edges.at_least(F.col("sim"), 0.7, "float")).select("src", "dst", r6(F.col("sim").cast("double")).alias("sim"))


@query(f"WITH {SUPPLIERS} SELECT dst AS src, src AS dst, round(sim, 6) AS sim FROM edges")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.transpose(adapters.supplier_edges(spark, sf_dir)).select("src", "dst", r6("sim").alias("sim"))


@query(f"WITH {PARTS} SELECT src, dst, round(sim, 6) AS sim, CAST(rk AS INTEGER) AS rk FROM ({_RANK.format(t='(SELECT dst AS src, src AS dst, sim FROM edges)', w='', n=250)})")
def incoming_top250(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.incoming_only(adapters.part_edges(spark, sf_dir), 250).select("src", "dst", r6("sim").alias("sim"), "rk")


_CAPPED = f"WITH {PARTS}, capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos FROM edges) WHERE pos < 50)"


@query(f"{_CAPPED} SELECT src, count(*) AS n, round(sum(sim), 6) AS total FROM capped WHERE sim > 0 GROUP BY src")
def first_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = adapters.part_edges(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1)
    return edges.first_edges(e, 50).where("sim > 0").groupBy("src").agg(F.count("*").alias("n"), r6(F.sum("sim")).alias("total"))


@query(f"WITH {VIEWS} SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY sim DESC, dst) AS ids FROM f GROUP BY src")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = edges.adjacency(adapters.supplier_view(spark, sf_dir, TOP))
    return a.select("id", F.concat_ws(",", F.transform("connections", lambda c: c["id"].cast("string"))).alias("ids"))


@query(f"WITH {VIEWS} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(max(sim), 6) AS sim FROM f GROUP BY 1, 2")
def pair_max_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.pair_strength(adapters.supplier_view(spark, sf_dir, TOP)).select("a", "b", r6("sim").alias("sim"))


@query(f"WITH {VIEWS}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM f UNION ALL SELECT dst FROM f) GROUP BY id) SELECT id, degree, max(degree) OVER () AS max_degree FROM d")
def local_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.local_degree(adapters.supplier_view(spark, sf_dir, TOP)).select("id", "degree", "max_degree")


_INNER = f"WITH {SUPPLIERS}, s AS (SELECT s_suppkey AS id FROM supplier WHERE s_nationkey < 12), kept AS (SELECT * FROM edges WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s))"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey < 12").select(F.col("s_suppkey").alias("id"))


@query(f"{_INNER} SELECT src, dst, round(sim, 6) AS sim FROM kept")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.induced(adapters.supplier_edges(spark, sf_dir), _nodes(spark, sf_dir)).select("src", "dst", r6("sim").alias("sim"))


@query(f"{_INNER} SELECT *, round(CASE WHEN edges_before > 0 THEN edges_kept / edges_before ELSE 0.0 END, 6) AS preserved, round(CASE WHEN sources_kept > 0 THEN edges_kept / sources_kept ELSE 0.0 END, 6) AS average_degree FROM (SELECT (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM s)) AS edges_before, (SELECT count(*) FROM kept) AS edges_kept, (SELECT count(DISTINCT src) FROM kept) AS sources_kept)")
def induced_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stats = edges.induced_with_stats(adapters.supplier_edges(spark, sf_dir), _nodes(spark, sf_dir))
    return stats.withColumns({c: r6(c) for c in ("preserved", "average_degree")})


# --- statistics

_ENDS = "(SELECT count(DISTINCT id) FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges))"


@query(f"WITH {PARTS}, c AS (SELECT {_ENDS} AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT src) FROM edges) AS sources) SELECT *, round(CASE WHEN nodes > 1 THEN edges / (CAST(nodes AS DOUBLE) * (nodes - 1)) ELSE 0.0 END, 9) AS density FROM c")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.graph_counts(adapters.part_edges(spark, sf_dir)).withColumn("density", F.round("density", 9))


@query(f"WITH {PARTS} SELECT p_partkey AS id, count(e.src) AS degree FROM part LEFT JOIN edges e ON e.src = p_partkey GROUP BY 1")
def degree_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.out_degree(adapters.part_edges(spark, sf_dir), adapters.parts(spark, sf_dir))


_IN = f"{PARTS}, d AS (SELECT dst AS id, count(*) AS degree FROM edges GROUP BY 1)"


@query(f"WITH {_IN} SELECT id, degree FROM d")
def degree_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.in_degree(adapters.part_edges(spark, sf_dir))


def _summary_sql(x: str, t: str) -> str:
    return f"SELECT round(avg({x}), 6) AS mean, round(quantile_cont(CAST({x} AS DOUBLE), 0.5), 6) AS median, round(stddev_pop({x}), 6) AS std, round(CAST(min({x}) AS DOUBLE), 6) AS min, round(CAST(max({x}) AS DOUBLE), 6) AS max, round(quantile_cont(CAST({x} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({x} AS DOUBLE), 0.75), 6) AS q75, count({x}) AS n FROM {t}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@query(f"WITH {_IN} {_summary_sql('degree', 'd')}")
def degree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.summary(metrics.in_degree(adapters.part_edges(spark, sf_dir)), "degree"))


@query(f"WITH {PARTS} {_summary_sql('sim', 'edges')}")
def weight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.summary(adapters.part_edges(spark, sf_dir), "sim"))


@query(f"WITH {_IN}, k AS (SELECT degree, row_number() OVER (ORDER BY degree) AS i FROM d) SELECT round(2.0 * sum(CAST(i * degree AS DOUBLE)) / (count(*) * sum(CAST(degree AS DOUBLE))) - (count(*) + 1) / count(*), 6) AS gini FROM k")
def gini_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.gini(metrics.in_degree(adapters.part_edges(spark, sf_dir)), "degree"))


@query(f"WITH {_IN} SELECT degree AS value, count(*) AS count FROM d GROUP BY 1")
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(metrics.in_degree(adapters.part_edges(spark, sf_dir)), "degree")


_FIT = f"{_IN}, h AS (SELECT degree AS value, count(*) AS c FROM d WHERE degree > 0 GROUP BY 1), fit AS (SELECT -regr_slope(log10(c), log10(value)) AS alpha, regr_intercept(log10(c), log10(value)) AS intercept, regr_r2(log10(c), log10(value)) AS r2, count(*) AS points FROM h HAVING count(*) > 1)"


@query(f"WITH {_FIT} SELECT round(alpha, 6) AS alpha, round(intercept, 6) AS intercept, round(r2, 6) AS r2, points FROM fit")
def power_law_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.power_law(metrics.in_degree(adapters.part_edges(spark, sf_dir)), "degree"))


@query(f"WITH {_FIT}, s AS (SELECT log10(min(degree)) AS lo, log10(max(degree)) AS hi FROM d WHERE degree > 0), g AS (SELECT CAST(k AS INTEGER) AS k, pow(10.0, lo + k * (hi - lo) / 49) AS x FROM s, range(50) t(k)) SELECT k, round(x, 6) AS x, round(pow(10.0, intercept) * pow(x, -alpha), 6) AS y FROM g, fit")
def fit_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.in_degree(adapters.part_edges(spark, sf_dir))
    return _rounded(metrics.fit_curve(metrics.power_law(d, "degree"), d, "degree", 50))


@query(f"WITH {_IN}, s AS (SELECT CAST(min(degree) AS DOUBLE) AS lo, CAST(max(degree) AS DOUBLE) AS hi FROM d), b AS (SELECT CAST(CASE WHEN hi > lo THEN least(floor((degree - lo) / ((hi - lo) / 50)), 49) ELSE 0 END AS INTEGER) AS bin, lo, hi FROM d, s) SELECT bin, round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 50), 6) AS low, count(*) AS count FROM b GROUP BY bin")
def degree_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.bins(metrics.in_degree(adapters.part_edges(spark, sf_dir)), "degree", 50))


@query(f"WITH {PARTS}, g AS (SELECT CAST(k AS INTEGER) AS k, k / 10.0 AS x FROM range(11) t(k)) SELECT k, round(CAST(x AS DOUBLE), 6) AS x, round(avg(exp(-pow((CAST(x AS DOUBLE) - sim) / 0.1, 2) / 2) / (0.1 * sqrt(2 * pi()))), 6) AS density FROM g, edges GROUP BY k, x")
def weight_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.density_curve(adapters.part_edges(spark, sf_dir), "sim", [k / 10 for k in range(11)]))


@query(f"WITH {_IN}, h AS (SELECT degree AS value, count(*) AS count FROM d GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM h) SELECT value, count FROM k WHERE n <= 10 OR k IN (SELECT CAST(floor(i * (n - 1) / 9) AS BIGINT) FROM range(10) t(i))")
def histogram_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = metrics.histogram(metrics.in_degree(adapters.part_edges(spark, sf_dir)), "degree")
    return metrics.evenly_spaced(h, "value", 10)


@query(f"WITH {PARTS}, m AS (SELECT count(DISTINCT (a.src, a.dst)) AS mutual FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src) SELECT mutual, (SELECT count(*) FROM edges) AS edges, round(mutual / (SELECT count(*) FROM edges), 6) AS reciprocity FROM m")
def reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.reciprocity(adapters.part_edges(spark, sf_dir)))


_WEDGES = f"""WITH {SUPPLIERS}, top AS ({_RANK.format(t="edges", w=" WHERE sim > 0", n=250)}),
w AS (SELECT a.src AS id, a.dst AS x, b.dst AS y FROM top a JOIN top b ON a.src = b.src AND a.dst < b.dst),
linked AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM top),
c AS (SELECT w.id, count(*) AS wedges, count(l.x) AS closed FROM w LEFT JOIN linked l ON l.x = w.x AND l.y = w.y GROUP BY 1)
SELECT round(avg(closed / wedges), 6) AS mean_local, round(sum(closed) / sum(wedges), 6) AS transitivity, CAST(sum(wedges) AS BIGINT) AS wedges FROM c"""


@query(_WEDGES)
def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all edges, up to the 250 strongest of each supplier."""
    return _rounded(metrics.clustering(adapters.supplier_edges(spark, sf_dir)))


@query(f"WITH {_IN} SELECT id, degree, coalesce(p_name, CAST(id AS VARCHAR)) AS name FROM (SELECT * FROM d ORDER BY degree DESC, id LIMIT 20) LEFT JOIN part ON p_partkey = id")
def top_nodes_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_nodes(metrics.in_degree(adapters.part_edges(spark, sf_dir)), adapters.parts(spark, sf_dir))


@query(f"WITH {PARTS}, d AS (SELECT src AS id, count(*) AS degree FROM edges GROUP BY 1) SELECT id, degree, coalesce(p_name, CAST(id AS VARCHAR)) AS name FROM (SELECT * FROM d ORDER BY degree DESC, id DESC LIMIT 20) LEFT JOIN part ON p_partkey = id")
def top_nodes_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_nodes(metrics.out_degree(adapters.part_edges(spark, sf_dir)), adapters.parts(spark, sf_dir), largest_id_first=True)


# --- names


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "part-names", lambda: search.name_index(adapters.parts(spark, sf_dir)))


_CLEAN = "lower(strip_accents(trim(regexp_replace({}, '\\s+', ' ', 'g'))))"


@query(f"SELECT p_partkey AS id, {_CLEAN.format('p_name')} AS clean FROM part")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.name_index(adapters.parts(spark, sf_dir)).select("id", "clean")


@query(f"SELECT {_CLEAN.format('p_name')} AS clean, count(DISTINCT p_partkey) AS n, min(p_partkey) AS first FROM part GROUP BY 1")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lookup(_names(spark, sf_dir)).select("clean", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("first"))


@query(f"WITH q AS (SELECT DISTINCT upper(p_name) AS query FROM part) SELECT query, id, name FROM (SELECT query, p_partkey AS id, p_name AS name, row_number() OVER (PARTITION BY query ORDER BY (lower(p_name) = lower(query)) DESC, p_partkey) AS k FROM q JOIN part ON {_CLEAN.format('p_name')} = {_CLEAN.format('query')}) WHERE k = 1")
def name_resolve_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.parts(spark, sf_dir)
    return search.by_name(_names(spark, sf_dir), p.select(F.upper("name").alias("query")).distinct())


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY (lower(p_name) = 'ring') DESC, (lower(p_name) = 'ring') DESC, starts_with(lower(p_name), 'ring') DESC, strlen(p_name), p_partkey LIMIT 25")
def name_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_names(spark, sf_dir), "Ring", 25).select("id", "name")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS uid FROM (SELECT s_suppkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('https://supplier.example/' || s_suppkey)) AS h FROM supplier)")
def uuid5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.suppliers(spark, sf_dir)
    url = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("url"))
    return s.select("id", text.resolve_id(F.lit(""), url).alias("uid"))


@query("SELECT count(*) AS entities FROM part")
def entity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.parts(spark, sf_dir).agg(F.count("*").alias("entities"))


@query()
def random_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.random_entity(adapters.parts(spark, sf_dir), 3)


# --- distances, paths, exploration

_W = "CAST(round((1 - {v}.sim) * 1000000000) AS BIGINT)"


def _levels(name: str, view: str, node: int) -> str:
    return f"{name}(id, level) USING KEY (id) AS (SELECT CAST({node} AS BIGINT), 0 UNION SELECT v.dst, min(l.level + 1) FROM {name} l JOIN {view} v ON v.src = l.id LEFT JOIN recurring.{name} k ON k.id = v.dst WHERE k.id IS NULL GROUP BY v.dst)"


def _costs(name: str, view: str, node: int, hops: bool) -> str:
    w = _W.format(v="v") + (" * 1048576 + 1" if hops else "")
    return f"{name}(id, level) USING KEY (id) AS (SELECT CAST({node} AS BIGINT), CAST(0 AS BIGINT) UNION SELECT v.dst, min(l.level + {w}) FROM {name} l JOIN {view} v ON v.src = l.id LEFT JOIN recurring.{name} k ON k.id = v.dst GROUP BY v.dst, k.level HAVING k.level IS NULL OR min(l.level + {w}) < k.level)"


def _path_sql(step) -> str:
    """CTEs up to path(step, id, similarity); step(parent, child) says that an edge continues a best path."""
    return f"""m AS (SELECT df.id, df.level AS a, dr.level AS b FROM df JOIN dr ON df.id = dr.id ORDER BY a + b, a DESC, df.id LIMIT 1),
fp AS (SELECT * FROM (SELECT v.dst AS id, v.src AS parent, v.sim, row_number() OVER (PARTITION BY v.dst ORDER BY v.sim DESC, v.src) AS k FROM f v JOIN df p ON p.id = v.src JOIN df c ON c.id = v.dst WHERE {step}) WHERE k = 1),
rp AS (SELECT * FROM (SELECT v.dst AS id, v.src AS parent, v.sim, row_number() OVER (PARTITION BY v.dst ORDER BY v.sim DESC, v.src) AS k FROM r v JOIN dr p ON p.id = v.src JOIN dr c ON c.id = v.dst WHERE {step}) WHERE k = 1),
fwalk(id, back, similarity) AS (SELECT m.id, 0, fp.sim FROM m LEFT JOIN fp ON fp.id = m.id UNION ALL SELECT q.id, w.back + 1, n.sim FROM fwalk w JOIN fp ON fp.id = w.id JOIN (SELECT DISTINCT id FROM df) q ON q.id = fp.parent LEFT JOIN fp n ON n.id = q.id),
rwalk(id, ahead, similarity) AS (SELECT m.id, 0, CAST(NULL AS DOUBLE) FROM m UNION ALL SELECT rp.parent, w.ahead + 1, rp.sim FROM rwalk w JOIN rp ON rp.id = w.id),
path AS (SELECT CAST((SELECT max(back) FROM fwalk) - back AS INTEGER) AS step, id, similarity FROM fwalk UNION ALL SELECT CAST((SELECT max(back) FROM fwalk) + ahead AS INTEGER), id, similarity FROM rwalk WHERE ahead > 0)"""


_HOP = f"WITH RECURSIVE {VIEWS}, {_levels('df', 'f', START)}, {_levels('dr', 'r', TARGET)}, {_path_sql('p.level = c.level - 1')}"
_WEIGHTED = f"WITH RECURSIVE {VIEWS}, {_costs('df', 'f', START, True)}, {_costs('dr', 'r', TARGET, True)}, {_path_sql('v.src <> v.dst AND p.level + ' + _W.format(v='v') + ' * 1048576 + 1 = c.level')}"


@query(f"WITH RECURSIVE {VIEWS}, {_levels('df', 'f', START)} SELECT id, level FROM df")
def hop_levels(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    g = adapters.supplier_graph(spark, sf_dir, top)
    return paths.hop_levels(g.forward, paths._ids(spark, g.forward, START), local=local)


@query(f"WITH RECURSIVE {VIEWS}, {_costs('df', 'f', START, False)} SELECT id, round(level / 1000000000, 6) AS cost FROM df")
def weighted_distance(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    g = adapters.supplier_graph(spark, sf_dir, top)
    return paths.distances(g.forward, paths._ids(spark, g.forward, START), local=local).select("id", r6(F.col("c") / 1_000_000_000).alias("cost"))


@query(f"{_HOP} SELECT step, id, round(similarity, 6) AS similarity FROM path")
def hop_path(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    return _rounded(_hop_path(spark, sf_dir, top, local))


def _hop_path(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    g = adapters.supplier_graph(spark, sf_dir, top)
    return paths.hop_path(g, START, TARGET, local)


@query(f"{_WEIGHTED} SELECT step, id, round(similarity, 6) AS similarity FROM path")
def weighted_path(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    return _rounded(paths.weighted_path(adapters.supplier_graph(spark, sf_dir, top), START, TARGET, local=local))


@query(f"{_HOP} SELECT a.id AS src, b.id AS dst, round(b.similarity, 6) AS sim FROM path a JOIN path b ON b.step = a.step + 1")
def path_edges(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    return _rounded(paths.path_edges(_hop_path(spark, sf_dir, top, local)))


@query(f"WITH RECURSIVE {VIEWS}, {_levels('df', 'f', START)}, {_levels('dr', 'r', TARGET)} SELECT count(*) AS visited FROM (SELECT id FROM df UNION SELECT id FROM dr)")
def visited_count(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    g = adapters.supplier_graph(spark, sf_dir, top)
    return paths.visited_count(paths.hop_levels(g.forward, paths._ids(spark, g.forward, START), local=local), paths.hop_levels(g.reverse, paths._ids(spark, g.forward, TARGET), local=local))


def _explore(view: str) -> str:
    return f"""WITH RECURSIVE {VIEWS}, owners AS (SELECT DISTINCT src AS id FROM {view}),
x(id, similarity, layer, ord) USING KEY (id) AS (
  SELECT CAST({START} AS BIGINT), CAST(1.0 AS DOUBLE), 0, CAST(0 AS BIGINT)
  UNION
  SELECT id, similarity, layer, CAST(base + row_number() OVER (ORDER BY parent, rk) AS BIGINT) FROM (
    SELECT v.dst AS id, arg_min(v.sim, l.ord * 1000000 + v.rk) AS similarity, any_value(l.layer) + 1 AS layer, min(l.ord * 1000000 + v.rk) // 1000000 AS parent, min(l.ord * 1000000 + v.rk) % 1000000 AS rk, (SELECT max(ord) FROM recurring.x) AS base
    FROM x l JOIN {view} v ON v.src = l.id JOIN owners o ON o.id = v.dst LEFT JOIN recurring.x k ON k.id = v.dst WHERE k.id IS NULL GROUP BY v.dst)
), nodes AS (SELECT * FROM x WHERE ord < {BUDGET})"""


_EDGES = 'SELECT src AS "from", dst AS "to", round(sim, 6) AS similarity FROM f WHERE src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)'


def _explored(spark: SparkSession, sf_dir: str, top: int, local: bool, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    v = adapters.supplier_view(spark, sf_dir, top, reverse=reverse)
    return v, explore.explore_hops(v, metrics.owners(v), START, BUDGET, local)


@query(f"{_explore('f')} SELECT id, round(similarity, 6) AS similarity, layer FROM nodes")
def explore_hops_nodes(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    return _explored(spark, sf_dir, top, local)[1].select("id", r6("similarity").alias("similarity"), "layer")


@query(f"{_explore('f')} {_EDGES}")
def explore_hops_edges(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    return _rounded(explore.induced_view(*_explored(spark, sf_dir, top, local)))


@query(f"{_explore('r')} SELECT id, round(similarity, 6) AS similarity, layer FROM nodes")
def explore_reverse_nodes(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    return _explored(spark, sf_dir, top, local, True)[1].select("id", r6("similarity").alias("similarity"), "layer")


@query(f"{_explore('r')} " + _EDGES.replace('src AS "from", dst AS "to"', 'dst AS "from", src AS "to"').replace("FROM f", "FROM r"))
def explore_reverse_edges(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    return _rounded(explore.flip(explore.induced_view(*_explored(spark, sf_dir, top, local, True))))


_NEAR = f"WITH RECURSIVE {VIEWS}, {_costs('df', 'f', START, False)}, nodes AS (SELECT * FROM df ORDER BY level, id LIMIT {BUDGET})"


@query(f"{_NEAR} SELECT id, round(1.0 - level / 1000000000, 6) AS similarity, CASE WHEN id = {START} THEN 0 ELSE CAST(floor(level * 5 / 1000000000) AS INTEGER) + 1 END AS layer FROM nodes")
def explore_weighted_nodes(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    return _rounded(explore.explore_weighted(adapters.supplier_view(spark, sf_dir, top), START, BUDGET, local))


@query(f"{_NEAR} {_EDGES}")
def explore_weighted_edges(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    v = adapters.supplier_view(spark, sf_dir, top)
    return _rounded(explore.induced_view(v, explore.explore_weighted(v, START, BUDGET, local)))


@query(f"{_NEAR} SELECT id, s_name AS name FROM nodes JOIN supplier ON s_suppkey = id WHERE s_nationkey < 20")
def named_nodes(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    known = adapters.suppliers(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey < 20").select(F.col("s_suppkey").alias("id")), "id", "left_semi")
    return explore.with_names(explore.explore_weighted(adapters.supplier_view(spark, sf_dir, top), START, BUDGET, local), known).select("id", "name")


# --- a path and its neighbourhood

_NEIGHBOURS = f"""{_HOP}, ahead AS (SELECT v.src AS p, v.dst AS n, v.sim FROM f v WHERE v.src IN (SELECT id FROM path)),
mine AS (SELECT * FROM ahead UNION ALL SELECT v.src, v.dst, v.sim FROM r v WHERE v.src IN (SELECT id FROM path) AND NOT EXISTS (SELECT 1 FROM ahead a WHERE a.p = v.src AND a.n = v.dst)),
theirs AS (SELECT v.dst AS p, v.src AS n, v.sim FROM (SELECT * FROM f UNION ALL SELECT * FROM r) v WHERE v.dst IN (SELECT id FROM path) AND v.src IN (SELECT n FROM mine)),
cand AS (SELECT n AS id, count(DISTINCT p) AS connections, max(sim) AS sim FROM (SELECT * FROM mine UNION ALL SELECT * FROM theirs) WHERE n NOT IN (SELECT id FROM path) GROUP BY n),
nodes AS (SELECT id, coalesce(similarity, 0.0) AS similarity, step AS layer FROM path UNION ALL SELECT * FROM (SELECT id, sim, CAST((SELECT count(*) FROM path) AS INTEGER) FROM cand ORDER BY connections DESC, sim DESC, id LIMIT greatest(0, {BUDGET} - (SELECT count(*) FROM path))))"""


@query(f"{_NEIGHBOURS} SELECT id, connections, round(sim, 6) AS sim FROM cand")
def path_candidates(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    return _rounded(neighborhood.candidates(adapters.supplier_graph(spark, sf_dir, top), _hop_path(spark, sf_dir, top, local)))


@query(f"{_NEIGHBOURS} SELECT id, round(similarity, 6) AS similarity, layer FROM nodes")
def enhanced_path_nodes(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    return _rounded(neighborhood.path_neighborhood(adapters.supplier_graph(spark, sf_dir, top), _hop_path(spark, sf_dir, top, local), BUDGET))


@query(f"""{_NEIGHBOURS}, steps AS (SELECT a.id AS src, b.id AS dst, b.similarity AS sim FROM path a JOIN path b ON b.step = a.step + 1),
u AS (SELECT src, dst, sim, 0 AS prio FROM steps UNION ALL SELECT src, dst, sim, 1 FROM f UNION ALL SELECT src, dst, sim, 2 FROM r)
SELECT src AS "from", dst AS "to", round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY prio, sim DESC) AS k FROM u
WHERE prio = 0 OR (src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) AND NOT EXISTS (SELECT 1 FROM steps s WHERE s.src = u.dst AND s.dst = u.src))) WHERE k = 1""")
def enhanced_path_edges(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    g, p = adapters.supplier_graph(spark, sf_dir, top), _hop_path(spark, sf_dir, top, local)
    return _rounded(neighborhood.neighborhood_edges(g, p, neighborhood.path_neighborhood(g, p, BUDGET)))


@query(f"{_HOP} SELECT CASE WHEN n = 0 THEN 'no_path' WHEN n > 2 THEN 'path_too_long' ELSE 'success' END AS status, CASE WHEN n > 0 THEN n END AS path_length, CASE WHEN n > 2 THEN n END AS minimum_budget_needed FROM (SELECT CAST(count(*) AS INTEGER) AS n FROM path)")
def enhanced_path_status(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    return neighborhood.path_status(_hop_path(spark, sf_dir, top, local), 2)


@query(f"{_HOP} SELECT src, dst, EXISTS (SELECT 1 FROM path a JOIN path b ON b.step = a.step + 1 WHERE (a.id = src AND b.id = dst) OR (a.id = dst AND b.id = src)) AS on_path FROM f")
def path_highlight(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    return render.highlight(adapters.supplier_view(spark, sf_dir, top), paths.path_edges(_hop_path(spark, sf_dir, top, local))).select("src", "dst", "on_path")


@query(f"WITH {VIEWS}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM f UNION ALL SELECT dst FROM f) GROUP BY id), m AS (SELECT greatest(max(degree), 1) AS most FROM d) SELECT f.src, f.dst, round(30 + (1 - sim) * 170, 6) AS length, round(sim * 0.8, 6) AS strength, round(9 + a.degree / most * 6, 6) AS src_font, round(9 + b.degree / most * 6, 6) AS dst_font FROM f JOIN d a ON a.id = f.src JOIN d b ON b.id = f.dst, m")
def layout_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = adapters.supplier_view(spark, sf_dir, TOP)
    return _rounded(render.layout(v, edges.local_degree(v)))


@query(f"WITH {VIEWS}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM f UNION ALL SELECT dst FROM f) GROUP BY id), b AS (SELECT s_suppkey AS id, s_name AS name, 9 + coalesce(degree, 0) / (SELECT max(degree) FROM d) * 6 AS font FROM supplier LEFT JOIN d ON d.id = s_suppkey) SELECT id, round(CAST(font AS DOUBLE), 6) AS font, round(CAST(length(name) * font * 0.6 + 8 AS DOUBLE), 6) AS width, round(CAST(font + 10 AS DOUBLE), 6) AS height FROM b")
def node_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(render.node_boxes(adapters.suppliers(spark, sf_dir), edges.local_degree(adapters.supplier_view(spark, sf_dir, TOP))))


@query("SELECT count(*) AS nodes, round(CAST(greatest(0.005, least(0.5, 2 / sqrt(greatest(count(*), 1)))) AS DOUBLE), 6) AS min_zoom FROM supplier")
def view_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(render.view_limits(adapters.suppliers(spark, sf_dir)))


@query(f"{_HOP} SELECT string_agg(s_name, ' → ' ORDER BY step) AS flow, string_agg(CAST(step + 1 AS VARCHAR) || '. ' || s_name || CASE WHEN step > 0 THEN ' [' || printf('%.3f', similarity) || ']' ELSE '' END, chr(10) ORDER BY step) AS lines FROM path JOIN supplier ON s_suppkey = id")
def path_text(spark: SparkSession, sf_dir: str, top: int = TOP, local: bool = False) -> DataFrame:
    named = _hop_path(spark, sf_dir, top, local).join(F.broadcast(adapters.suppliers(spark, sf_dir).join(_hop_path(spark, sf_dir, top, local).select("id"), "id", "left_semi")), "id")
    return render.path_text(named)


@query()
def path_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _hop_path(spark, sf_dir).join(adapters.suppliers(spark, sf_dir), "id")
    return render.path_json(named, "a -> b", 10, 1.567)


# --- comparison

_BOTH = f"WITH {PARTS}, a AS (SELECT CAST(count(*) AS DOUBLE) AS x FROM edges GROUP BY dst), s AS (SELECT p_partkey AS id FROM part WHERE p_size <= 25), b AS (SELECT CAST(count(*) AS DOUBLE) AS x FROM edges WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s) GROUP BY dst)"


def _half(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    return edges.induced(adapters.part_edges(spark, sf_dir), nodes)


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.two_samples(metrics.in_degree(adapters.part_edges(spark, sf_dir)), metrics.in_degree(_half(spark, sf_dir)), "degree")


#: An integral from t over the next 40, by Simpson's rule.
_TAIL = "(SELECT sum(CASE WHEN j = 0 OR j = 8000 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * ({f})) * 40 / 8000 / 3 FROM (SELECT j, {t} + j * 40 / 8000 AS t FROM range(8001) r(j)))"


@query(f"{_BOTH}, v AS (SELECT DISTINCT x FROM (SELECT x FROM a UNION ALL SELECT x FROM b)), na AS (SELECT count(*) AS n FROM a), nb AS (SELECT count(*) AS n FROM b), k AS (SELECT max(abs((SELECT count(*) FROM a WHERE a.x <= v.x) / (SELECT n FROM na) - (SELECT count(*) FROM b WHERE b.x <= v.x) / (SELECT n FROM nb))) AS ks FROM v), e AS (SELECT ks, ks * sqrt((SELECT n FROM na) * (SELECT n FROM nb) / ((SELECT n FROM na) + (SELECT n FROM nb))) AS x FROM k), q AS (SELECT ks, CASE WHEN x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * (SELECT sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * j * j * x * x)) FROM range(1, 101) t(j)))) END AS p FROM e) SELECT round(ks, 6) AS ks, round(p, 6) AS p_value, p < 0.05 AS significant, CASE WHEN p < 0.05 THEN 'Distributions differ' ELSE 'Distributions similar' END AS interpretation FROM q")
def ks_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.ks_statistic(_both(spark, sf_dir)))


@query(f"{_BOTH}, u AS (SELECT 1 AS s, x FROM a UNION ALL SELECT 2, x FROM b), k AS (SELECT s, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rk, count(*) OVER (PARTITION BY x) AS t FROM u), z AS (SELECT sum(rk) FILTER (s = 1) AS r, CAST(count(*) FILTER (s = 1) AS DOUBLE) AS na, CAST(count(*) FILTER (s = 2) AS DOUBLE) AS nb, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM k), y AS (SELECT r - na * (na + 1) / 2 AS u, r - na * (na + 1) / 2 - na * nb / 2 AS off, sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))) AS dev FROM z), q AS (SELECT u, off / dev AS z, {_TAIL.format(t='greatest(abs(off) - 0.5, 0) / dev', f='exp(-t * t / 2) * sqrt(2 / pi())')} AS p FROM y) SELECT round(u, 6) AS u, round(z, 6) AS z, round(p, 6) AS p_value, p < 0.05 AS significant, CASE WHEN p < 0.05 THEN 'Central tendencies differ' ELSE 'Central tendencies similar' END AS interpretation FROM q")
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.mann_whitney(_both(spark, sf_dir)))


@query(f"{_BOTH}, u AS (SELECT 1 AS s, x FROM a UNION ALL SELECT 2, x FROM b), z AS (SELECT s, abs(x - quantile_cont(x, 0.5) OVER (PARTITION BY s)) AS z FROM u), g AS (SELECT s, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY s), t AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m, sum(n * v) AS within FROM g), y AS (SELECT any_value(t.n) - 2 AS df, (any_value(t.n) - 2) * sum(g.n * (g.m - t.m) * (g.m - t.m)) / any_value(t.within) AS w FROM g, t), q AS (SELECT w, {_TAIL.format(t='sqrt(w)', f='2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + t * t / df, -(df + 1) / 2)')} AS p FROM y) SELECT round(w, 5) AS w, round(p, 6) AS p_value, p < 0.05 AS significant, CASE WHEN p < 0.05 THEN 'Variances differ' ELSE 'Variances similar' END AS interpretation FROM q")
def levene_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.levene(_both(spark, sf_dir)).withColumns({"w": F.round("w", 5), "p_value": r6("p_value")})


@query(f"{_BOTH}, d AS (SELECT ((SELECT avg(x) FROM a) - (SELECT avg(x) FROM b)) / sqrt(((SELECT var_pop(x) FROM a) + (SELECT var_pop(x) FROM b)) / 2) AS d) SELECT round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'Negligible' WHEN abs(d) < 0.5 THEN 'Small' WHEN abs(d) < 0.8 THEN 'Medium' ELSE 'Large' END AS effect FROM d")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.cohens_d(_both(spark, sf_dir)))


_METRICS = f"{_BOTH}, k AS (SELECT 'mean' AS metric, (SELECT avg(x) FROM a) AS f, (SELECT avg(x) FROM b) AS s UNION ALL SELECT 'median', (SELECT quantile_cont(x, 0.5) FROM a), (SELECT quantile_cont(x, 0.5) FROM b) UNION ALL SELECT 'std', (SELECT stddev_pop(x) FROM a), (SELECT stddev_pop(x) FROM b)), c AS (SELECT metric, f, s, CASE WHEN f = 0 THEN CASE WHEN s = 0 THEN 0 ELSE CAST('inf' AS DOUBLE) END ELSE abs(f - s) / abs(f) * 100 END AS difference FROM k)"


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    tall = lambda e: metrics.summary(metrics.in_degree(e), "degree").unpivot([], ["mean", "median", "std"], "metric", "value")
    return compare.metric_differences(tall(adapters.part_edges(spark, sf_dir)), tall(_half(spark, sf_dir)))


@query(f"{_METRICS} SELECT metric, round(f, 6) AS full, round(s, 6) AS sub, round(difference, 5) AS difference FROM c".replace("AS full", 'AS "full"'))
def metrics_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("metric", r6("full").alias("full"), r6("sub").alias("sub"), F.round("difference", 5).alias("difference"))


@query(f"{_METRICS} SELECT round(avg(difference), 5) AS mean_difference, CASE WHEN avg(difference) < 10 THEN 'excellent' WHEN avg(difference) < 20 THEN 'good' ELSE 'poor' END AS verdict FROM c")
def representativeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.representativeness(_compared(spark, sf_dir)).withColumn("mean_difference", F.round("mean_difference", 5))


@query(f"{_BOTH}, h AS (SELECT * FROM edges WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)) SELECT round((SELECT count(DISTINCT id) FROM (SELECT src AS id FROM h UNION ALL SELECT dst FROM h)) / {_ENDS}, 6) AS node_ratio, round((SELECT count(*) FROM h) / (SELECT count(*) FROM edges), 6) AS edge_ratio")
def size_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.size_ratios(metrics.graph_counts(adapters.part_edges(spark, sf_dir)), metrics.graph_counts(_half(spark, sf_dir))))


@query("WITH runs AS (SELECT r_name AS cache_state, n_name AS algorithm, CAST(n_nationkey * 7 % 11 + 1 AS DOUBLE) AS ms, CAST(n_nationkey * 5 % 13 + 1 AS DOUBLE) AS nodes FROM nation JOIN region ON r_regionkey = n_regionkey), best AS (SELECT *, row_number() OVER (PARTITION BY cache_state ORDER BY ms, algorithm) AS k FROM runs) SELECT runs.cache_state, runs.algorithm, best.algorithm AS fastest, round(runs.ms / best.ms, 6) AS slowdown, round(runs.nodes / best.nodes, 6) AS node_ratio FROM runs JOIN best ON best.cache_state = runs.cache_state AND best.k = 1")
def benchmark_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    runs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("cache_state"), F.col("n_name").alias("algorithm"), (F.col("n_nationkey") * 7 % 11 + 1).cast("double").alias("ms"), (F.col("n_nationkey") * 5 % 13 + 1).cast("double").alias("nodes"))
    return _rounded(compare.benchmark_rollup(runs))


# --- samples


@query()
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.reservoir(adapters.part_edges(spark, sf_dir), 1000, 7).select("src", "dst", r6("sim").alias("sim"))


@query()
def random_walk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.supplier_edges(spark, sf_dir)
    return sample.walk_subgraph(e, metrics.out_degree(e))


# --- files and functions


def _uid(c: str) -> Column:
    return text.uuid5_url(F.concat(F.lit("n/"), F.col(c).cast("string")))


_UID = "substr(h{0}, 1, 8) || '-' || substr(h{0}, 9, 4) || '-5' || substr(h{0}, 14, 3) || '-' || substr('89ab', CAST((instr('0123456789abcdef', substr(h{0}, 17, 1)) - 1) % 4 AS INTEGER) + 1, 1) || substr(h{0}, 18, 3) || '-' || substr(h{0}, 21, 12)"
_AS_UID = f"u AS (SELECT {_UID.format(1)} AS src, {_UID.format(2)} AS dst, sim FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('n/' || src)) AS h1, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('n/' || dst)) AS h2, sim FROM f))"


def _ndjson(spark: SparkSession, sf_dir: str) -> str:
    v = adapters.supplier_view(spark, sf_dir, TOP).select(_uid("src").alias("src"), _uid("dst").alias("dst"), F.col("sim").cast("float").alias("sim"))
    at = f"{shared_dir(spark)}/ndjson-{abs(hash((spark.sparkContext.applicationId, sf_dir)))}"
    ndjson.write_graph(edges.adjacency(v), at, "overwrite")
    return at


@query(f"WITH {VIEWS}, {_AS_UID} SELECT src, dst, round(CAST(CAST(sim AS FLOAT) AS DOUBLE), 6) AS sim FROM u")
def ndjson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndjson.read_edges(spark, _ndjson(spark, sf_dir)).select("src", "dst", r6(F.col("sim").cast("double")).alias("sim"))


@query(f"WITH {VIEWS}, {_AS_UID} SELECT src, dst, round(CAST(CAST(sim AS FLOAT) AS DOUBLE), 6) AS sim FROM u")
def packed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import packed

    v = adapters.supplier_view(spark, sf_dir, TOP).select(_uid("src").alias("src"), _uid("dst").alias("dst"), F.col("sim").cast("float").alias("sim"))
    at = f"{shared_dir(spark)}/packed-{abs(hash((spark.sparkContext.applicationId, sf_dir)))}"
    packed.write_adjacency(v, at, 2)
    return packed.read_adjacency(spark, at).select("src", "dst", r6(F.col("sim").cast("double")).alias("sim"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'a+b+' || replace(replace(p_name, ' ', '+'), '&', 'and') ELSE replace('c and d ' || p_name, ' ', '+') END AS term, replace(p_name, ' ', '%20') AS encoded, format('{:,}', p_partkey) AS thousands, printf('%.3f', p_retailprice) AS fixed, nullif(trim(replace(CASE WHEN p_size % 3 = 0 THEN ' Read more on Last.fm' ELSE p_type || ' Read more on Last.fm' END, 'Read more on Last.fm', '')), '') AS bio FROM part")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    artist = F.when(F.col("p_size") % 4 == 0, "a b").otherwise("c & d")
    bio = F.when(F.col("p_size") % 3 == 0, " Read more on Last.fm").otherwise(F.concat("p_type", F.lit(" Read more on Last.fm")))
    return p.select(F.col("p_partkey").alias("id"), values.search_term(artist, F.col("p_name")).alias("term"), values.form_encode(F.col("p_name")).alias("encoded"), values.thousands(F.col("p_partkey")).alias("thousands"), F.format_string("%.3f", "p_retailprice").alias("fixed"), values.clean_bio(bio).alias("bio"))


@query("SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS last_fetched, (epoch(TIMESTAMP '1998-08-01') - epoch(o_orderdate)) < 7776000 AS fresh FROM orders")
def cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("last_fetched"))
    return o.withColumn("fresh", values.is_fresh(F.col("last_fetched"), F.unix_timestamp(F.lit("1998-08-01 00:00:00"))))


@query("WITH t AS (SELECT o_custkey AS id, o_orderpriority AS name, o_orderkey AS n FROM orders), p AS (SELECT id, name, arg_max('u/' || n, n) AS preview_url FROM t WHERE n % 3 = 0 GROUP BY 1, 2) SELECT d.id, d.name, p.preview_url FROM (SELECT DISTINCT id, name FROM t) d LEFT JOIN p ON p.id = d.id AND p.name = d.name")
def track_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("n"))
    previews = t.where("n % 3 = 0").withColumn("preview_url", F.concat(F.lit("u/"), F.col("n").cast("string")))
    return search.zip_previews(t.select("id", "name").distinct(), previews).select("id", "name", "preview_url")


@query("SELECT DISTINCT CAST(s.s_suppkey AS VARCHAR) AS id FROM supplier s WHERE s.s_nationkey < 15 AND s.s_suppkey % 2 = 0 AND s.s_suppkey % 3 <> 0")
def seed_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.crawl import new_seeds

    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("id"), "s_nationkey", "s_suppkey")
    return new_seeds(s.where("s_nationkey < 15").select("id"), s.where("s_suppkey % 2 <> 0").select("id"), s.where("s_suppkey % 3 = 0").select("id"))


@query()
def crawl_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.crawl import crawl

    v = adapters.supplier_view(spark, sf_dir, TOP)
    recorded = table(edges.adjacency(v.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "sim")), "recorded")
    return crawl(recorded, [str(START)]).groupBy("id").agg(F.count("*").alias("edges"))


# --- the same over short lists, where searches go deeper, and in memory

_SEARCHES = ["hop_levels", "weighted_distance", "hop_path", "weighted_path", "path_edges", "visited_count", "explore_hops_nodes", "explore_hops_edges", "explore_reverse_nodes", "explore_reverse_edges", "explore_weighted_nodes", "explore_weighted_edges", "path_candidates", "enhanced_path_nodes", "enhanced_path_edges"]


def _variant(name: str, top: int, local: bool) -> None:
    f = _QUERIES[name]
    new = f"{name}_in_memory" if local else f"{name}_top{top}"
    _QUERIES[new] = lambda spark, sf_dir: f(spark, sf_dir, top=top, local=local)
    _SQL[new] = _SQL[name].replace(f"rk <= {TOP})", f"rk <= {top})")
    assert top == TOP or _SQL[new] != _SQL[name]


for _name in _SEARCHES:
    _variant(_name, 5, False)
for _name in ("hop_levels", "weighted_distance", "hop_path", "weighted_path", "explore_hops_nodes", "explore_weighted_nodes"):
    _variant(_name, TOP, True)
