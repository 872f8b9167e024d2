"""Steps whose cost was to grow no faster than their input: batches of a crawl, wedges, partitions, packed lists, walks."""

import random
import uuid
from collections import Counter
from itertools import combinations

import pytest

from kinweave import store
from kinweave.operators import edges, metrics, sample
from kinweave.sources import adapters, packed
from kinweave.streaming import crawl


def asked_one_batch_after_the_other(near, seeds, batch, most):
    queued, done, k = {s: 0 for s in seeds}, [], 0
    while (now := sorted((r, x) for x, r in queued.items() if x not in done)[: min(batch, most - len(done))]):
        k += 1
        done += [x for _, x in now]
        for _, x in now:
            for y in near.get(x, ()):
                queued.setdefault(y, k)
    return set(done)


@pytest.mark.parametrize(("batch", "most"), [(3, 5), (3, 11), (4, 23), (1, 17)])
def test_crawl_in_the_order_of_batches(spark, batch, most):
    rng = random.Random(batch * most)
    rows = sorted({(f"n{a:02d}", f"n{b:02d}") for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(90))} | {(f"n{k:02d}", f"n{(k * 7 + 3) % 40:02d}") for k in range(40)})
    near = {}
    for a, b in rows:
        near.setdefault(a, []).append(b)
    recorded = edges.adjacency(spark.createDataFrame([(a, b, 0.5) for a, b in rows], "src string, dst string, sim double"))
    got = crawl.crawl(recorded, ["n00", "n05"], most=most, batch=batch)
    want = asked_one_batch_after_the_other(near, ["n00", "n05"], batch, most)
    assert {r["id"] for r in got.select("id").distinct().collect()} == want
    assert got.count() == sum(len(near[x]) for x in want)


def test_crawl_takes_rounds_by_hops_not_by_batches(spark, tmp_path, monkeypatch):
    saved, save = [], crawl.save_state
    monkeypatch.setattr(crawl, "save_state", lambda *a: saved.append(1) or save(*a))
    rows = [("hub", f"n{k:03d}", 0.5) for k in range(100)] + [(f"n{k:03d}", "hub", 0.5) for k in range(100)]
    recorded = edges.adjacency(spark.createDataFrame(rows, "src string, dst string, sim double"))
    assert crawl.crawl(recorded, ["hub"], batch=2, save=f"{tmp_path}/state").count() == 200
    assert len(saved) <= 4
    done, queue = crawl.load_state(spark, f"{tmp_path}/state")
    assert done.count() == 101 and queue.isEmpty()


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize(("block", "long"), [(7, 3), (1 << 21, 4096)])
def test_wedges_by_blocks(spark, monkeypatch, kind, block, long):
    monkeypatch.setattr(metrics, "BLOCK_LINKS", block)
    monkeypatch.setattr(metrics, "LONG_LINKS", long)
    rng = random.Random(5)
    name = (lambda k: f"x{k * 37 % 101}") if kind == "string" else (lambda k: k * 1_000_003 - 5_000_000)
    rows = {(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(260))} | {(a, 0) for a in range(1, 30)}
    rows = [(name(a), name(b), 0.5) for a, b in rows] + [(name(1), name(2), 0.0), (name(40), name(41), 0.5)]
    near = {}
    for a, b, s in rows:
        if s > 0 and a != b:
            near.setdefault(a, set()).add(b)
    want = {(a, len(x) * (len(x) - 1) // 2, sum(c in near.get(b, ()) or b in near.get(c, ()) for b, c in combinations(x, 2))) for a, x in near.items() if len(x) > 1}
    got = metrics.wedges(spark.createDataFrame(rows, f"src {kind}, dst {kind}, sim double"))
    assert {tuple(r) for r in got.collect()} == want
    assert metrics.wedges(spark.createDataFrame([], f"src {kind}, dst {kind}, sim double")).count() == 0


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 64)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rng = random.Random(3)
    pairs = [(i, rng.randrange(25)) for i in range(120) for _ in range(rng.randrange(6))] + [(None, 3), (None, 4), (5, None)]
    try:
        got = adapters.co_occurrence(spark.createDataFrame(pairs, "item long, thing long"))
        items = {}
        for i, t in pairs:
            if i is not None and t is not None:
                items.setdefault(i, set()).add(t)
        n = Counter((a, b) for x in items.values() for a in x for b in x if a != b)
        assert got.rdd.getNumPartitions() >= sum(n.values()) / 64 > int(before)
        lists = {}
        for (a, b), c in n.items():
            lists.setdefault(a, []).append((-c, b))
        want = {(a, b, -c / -min(x)[0], k + 1) for a, x in lists.items() for k, (c, b) in enumerate(sorted(x))}
        assert {tuple(r) for r in got.collect()} == want
        plain = got.drop("place")
        for least, top in ((0.0, 3), (0.5, 9)):
            ranked, cut = (sorted(edges.top_edges(x, least, top).select("src", "dst", "sim", "rk").collect()) for x in (got, plain))
            assert ranked == cut and ranked
        assert edges.top_edges(edges.transpose(got), 0.0, 3).rdd.getNumPartitions() >= len(want) / 64
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_packed_files_are_bounded_and_read_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packed, "PART_EDGES", 10)
    u = lambda k: str(uuid.uuid5(uuid.NAMESPACE_URL, str(k)))
    rows = [(u(a), u(b), (a + b) / 64) for a in range(20) for b in range(a % 5 + 1)]
    index = packed.write_adjacency(spark.createDataFrame(rows, "src string, dst string, sim float"), f"{tmp_path}/bin", 2)
    assert index.select("file").distinct().count() > 2
    wrong = index.limit(3).selectExpr("id", "file", "offset + 4 AS offset", "connections").union(index.limit(3).selectExpr("id", "file", "1000000L", "connections"))
    found = packed.lookup_lists(spark, f"{tmp_path}/bin", index.where("id < '8'").union(wrong))
    got = [(r["id"], r["dst"], r["sim"]) for r in found.collect()]
    assert sorted(got) == sorted(r for r in rows if r[0] < "8") and 0 < len(got) < len(rows)
    plan = found._jdf.queryExecution().toString()
    assert "substring(content" not in plan  # the file's bytes beside every list that is wanted


def test_walks_are_the_same_wherever_rows_lie(spark):
    rng = random.Random(9)
    e = spark.createDataFrame([(a, b, rng.random()) for a in range(60) for b in rng.sample(range(80), 4)], "src long, dst long, sim double")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("2", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            start = spark.range(3).repartition(int(n)).select("id")
            got.append({r["id"] for r in sample.random_walks(e.repartition(int(n)), start, walks=3, steps=4).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len(got[0]) > 3
