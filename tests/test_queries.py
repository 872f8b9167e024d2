"""Every registered graph query against DuckDB on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from kinweave.plans import queries as graph

SMALL = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {Path(f).stem} AS FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(graph.oracle_sql()))
def test_same_rows(spark, db, name):
    df, want = graph.queries()[name](spark, SMALL), db.sql(graph.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    kinds = dict(df.dtypes)
    assert [TYPES[kinds[c]] for c in columns] == [str(dict(zip(want.columns, want.types))[c]) for c in columns]
    rows = lambda x: sorted(tuple(map(str, r)) for r in x)
    assert rows(df.select(*(f"`{c}`" for c in columns)).collect()) == rows(want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(graph.queries()) - set(graph.oracle_sql())))
def test_without_sql(spark, name):
    assert graph.queries()[name](spark, SMALL).count() > 0


def test_clustering_of_all_edges(spark):
    from itertools import combinations

    from kinweave.sources import adapters

    near = {}
    for r in adapters.supplier_edges(spark, "/root/testdata/sf0.01").where("sim > 0").collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    assert max(map(len, near.values())) > graph.TOP
    each = [(sum(b in near.get(a, ()) or a in near.get(b, ()) for a, b in combinations(sorted(x), 2)), len(x) * (len(x) - 1) // 2) for x in near.values() if len(x) > 1]
    want = sum(c / n for c, n in each) / len(each), sum(c for c, _ in each) / sum(n for _, n in each), sum(n for _, n in each)
    got = graph.queries()["clustering"](spark, "/root/testdata/sf0.01").first()
    assert abs(got["mean_local"] - want[0]) < 2e-6 and abs(got["transitivity"] - want[1]) < 2e-6 and got["wedges"] == want[2]


def test_walks_as_many_as_the_operator_makes(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(graph.sample, "walk_subgraph", lambda e, d, **kw: asked.append(kw) or d)
    graph.queries()["random_walk_sample"](spark, SMALL)
    assert asked == [{}]


def test_crawl_reaches_everything(spark):
    from kinweave.sources import adapters

    near = {}
    for r in adapters.supplier_view(spark, "/root/testdata/sf0.01", graph.TOP).collect():
        near.setdefault(str(r["src"]), set()).add(str(r["dst"]))
    seen, queue = set(), [str(graph.START)]
    while queue:
        x = queue.pop()
        if x not in seen:
            seen.add(x)
            queue += near.get(x, ())
    want = {x: len(near[x]) for x in seen if x in near}
    assert len(want) > 50
    assert {r["id"]: r["edges"] for r in graph.queries()["crawl_replay"](spark, "/root/testdata/sf0.01").collect()} == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
