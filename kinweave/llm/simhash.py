"""SimHash near-dedup with vantage-point trees.

Fingerprints within `radius` differing bits are linked. Equal fingerprints are collapsed first, so
copies cost nothing. The rest is an exact search by vantage-point trees, one for each of `parts` bit
blocks of the fingerprint: two fingerprints within `radius` differ by at most radius // parts bits in
some block (pigeonhole), so a tree over that block finds them with that small a radius, where
the triangle bound prunes; over all 64 bits at once distances crowd around 32 and it hardly would.

A tree node holds a vantage value and a median distance. A fingerprint lives ("home") on its own side;
one on the far side within the block radius of the boundary also visits ("guest") the near side. The
leaves are shards. A pair within reach meets exactly once in each tree: where their paths part, the
far one visits the near one's leaf. Each shard tests homes against homes and guests on all 64 bits,
and counts a pair only in the first block that brings it within reach. It returns a sum for each
fingerprint and a spanning forest of its links, never all pairs.

Components come from large-star / small-star rounds over those forests.

Defined results: null and empty texts have fingerprint zero, linked like any other; null ids are
allowed but never smaller than another id; repeated rows count as further documents; an empty table
gives an empty result; columns other than the two named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, schema_of, ship, table


def fingerprint_of(text: str | None, width: int = 2, seed: int = 42) -> int:
    """The SimHash of one whole text, as an unsigned 64-bit integer."""
    return int(fingerprints_of([text], width, seed)[0])


def fingerprints_of(texts: list[str | None], width: int = 2, seed: int = 42) -> np.ndarray:
    """The fingerprints of some texts, of which all shingles are held at once."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            sizes.append(0)
            continue
        if len(words) <= width:
            hashes.append(digest(b" ".join(words), seed))
            sizes.append(1)
            continue
        if width == 2:
            hashes.extend([digest(a + b" " + b, seed) for a, b in zip(words, words[1:])])
        else:
            hashes.extend(digest(b" ".join(words[i : i + width]), seed) for i in range(len(words) - width + 1))
        sizes.append(len(words) - width + 1)
    n = np.array(sizes, np.int64)
    out = np.zeros(len(n), np.uint64)
    h = np.array(hashes, np.uint64)
    ends = np.cumsum(n)
    for i in range(0, len(n)):
        if n[i]:
            out[i] = _majority(h[ends[i] - n[i] : ends[i]])
    return out


def _majority(h: np.ndarray) -> int:
    bits = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        part = h[k : k + (1 << 14)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, seed: int = 42) -> DataFrame:
    """(id, fp): the 64 bits as a long."""
    ship(df.sparkSession)
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(part.column(1).to_pylist(), width, seed).view(np.int64))], names=["id", "fp"])

    return picked.mapInArrow(run, type(picked.schema)([picked.schema["id"], *schema_of("fp long").fields]))


class VantageTree:
    """A complete tree of vantage values over one block of bits; leaves are numbered from 0."""

    def __init__(self, values: np.ndarray, depth: int, seed: int, bits: int = 16):
        self.depth = depth
        inner = (1 << depth) - 1
        self.vantage, self.median = np.zeros(inner, np.uint64), np.zeros(inner, np.int64)
        rng = np.random.default_rng(seed)
        bags = {0: values}
        for node in range(inner):
            bag = bags.pop(node, values[:0])
            best = (2.0, rng.integers(0, 1 << bits, dtype=np.uint64), bits // 2 - int(rng.integers(2)))
            for v in rng.choice(bag, 8) if len(bag) >= 8 else ():
                d = np.bitwise_count(bag ^ v).astype(np.int64)
                m = int(np.median(d))
                for cut in (m - 1, m):
                    share = abs(float((d <= cut).mean()) - 0.5)
                    if share < best[0]:
                        best = (share, v, cut)
            self.vantage[node], self.median[node] = best[1], best[2]
            near = np.bitwise_count(bag ^ best[1]) <= best[2]
            bags[2 * node + 1], bags[2 * node + 2] = bag[near], bag[~near]

    def route(self, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): every leaf that each value lives in or visits."""
        row, node, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(values[row] ^ self.vantage[node]).astype(np.int64) - self.median[node]
            near = d <= 0
            # a home goes to its side and, if far but within reach, visits the near side; a guest visits every side within reach
            go_near, go_far = (near | (d <= reach)), np.where(home, ~near, d > -reach)
            row = np.concatenate([row[go_near], row[go_far]])
            home = np.concatenate([(home & near)[go_near], home[go_far]])
            node = np.concatenate([2 * node[go_near] + 1, 2 * node[go_far] + 2])
        return row, node - ((1 << self.depth) - 1), home


def blocks_of(parts: int) -> list[tuple[int, int]]:
    """(shift, mask) of each block of the 64 bits."""
    cuts = [round(64 * k / parts) for k in range(parts + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def _block(fp: np.ndarray, shift: int, mask: int) -> np.ndarray:
    return (fp >> np.uint64(shift)) & np.uint64(mask)


def _search(fp: np.ndarray, n: np.ndarray, home: np.ndarray, part: int, layout: list[tuple[int, int]], radius: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents linked to each fingerprint by this shard's pairs, and a spanning forest (u, v) of them."""
    order = np.argsort(~home, kind="stable")
    sums = np.zeros(len(fp), np.int64)
    parent = np.arange(len(fp))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest: list[tuple[int, int]] = []
    f, homes = fp[order], int(home.sum())
    step = max(1, (1 << 18) // max(1, len(f)))
    for a in range(0, homes, step):
        b = min(a + step, homes)
        x = f[a:b, None] ^ f[None, a:]
        i, j = np.nonzero(np.bitwise_count(x) <= radius)
        keep = j > i
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        x = x[i, j]
        first = np.ones(len(i), bool)
        for shift, mask in layout[:part]:
            first &= np.bitwise_count(_block(x, shift, mask)) > reach
        first &= np.bitwise_count(_block(x, *layout[part])) <= reach
        i, j = order[a + i[first]], order[a + j[first]]
        np.add.at(sums, i, n[j])
        np.add.at(sums, j, n[i])
        for p, q in zip(i.tolist(), j.tolist()):
            p, q = find(p), find(q)
            if p != q:
                parent[p] = q
                forest.append((p, q))
    pairs = np.array(forest, np.int64).reshape(-1, 2)
    return sums, pairs[:, 0], pairs[:, 1]


def links(distinct: DataFrame, radius: int = 6, parts: int | None = None, leaf: int = 256, sample: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Of a table of distinct (fp, n): (fp, near) with the documents linked to each, and forest edges (u, v).

    The trees' medians come from a bounded sample of `sample` fingerprints; that shapes the shards
    only, as any tree gives the same pairs. More fingerprints call for longer blocks, whose trees can be
    deeper: `parts` is 4 up to 2**24 of them, 3 up to 2**32 and then 2.
    """
    spark = distinct.sparkSession
    ship(spark)
    total = distinct.count()
    parts = parts or (4 if total <= 1 << 24 else 3 if total <= 1 << 32 else 2)
    reach, layout = radius // parts, blocks_of(parts)
    depth = 0
    while total > leaf << depth and depth < {4: 14, 3: 18}.get(parts, 20):
        depth += 1
    seen = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(sample).toPandas()["fp"].to_numpy().astype(np.int64).view(np.uint64)
    trees = spark.sparkContext.broadcast([VantageTree(_block(seen, *layout[k]), depth, k, layout[k][1].bit_length()) for k in range(parts)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, n = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for k, tree in enumerate(trees.value):
                row, at, home = tree.route(_block(fp, *layout[k]), reach)
                yield pa.RecordBatch.from_arrays([pa.array(at + (k << depth), pa.int64()), pa.array(fp[row].view(np.int64)), pa.array(n[row]), pa.array(home)], names=["shard", "fp", "n", "home"])

    def search(group):
        import pandas as pd

        fp, n = group["fp"].to_numpy().view(np.uint64), group["n"].to_numpy()
        part = int(group["shard"].iloc[0]) >> depth
        sums, u, v = _search(fp, n, group["home"].to_numpy(), part, layout, radius, reach)
        some = np.flatnonzero(sums)
        fp = fp.view(np.int64)
        return pd.DataFrame({"u": np.concatenate([fp[some], fp[u]]), "v": np.concatenate([np.zeros(len(some), np.int64), fp[v]]), "near": np.concatenate([sums[some], np.zeros(len(u), np.int64)])})

    met = distinct.select("fp", "n").mapInArrow(route, "shard long, fp long, n long, home boolean")
    met = table(met.groupBy("shard").applyInPandas(search, "u long, v long, near long"), "simhash-links")
    return met.where("near > 0").groupBy(F.col("u").alias("fp")).agg(F.sum("near").alias("near")), met.where("near = 0").select("u", "v")


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of (u, v) long edges: root is the smallest node reachable.

    A round shortens paths by half or better, so even a chain of 2**60 nodes takes some hundred rounds; if `most_rounds` do not do, that is an error, not a result.
    """
    e = table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "components")
    last = None
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # every row has u > v now: small star hangs a node's neighbours and the node itself on their minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        before, e = e, table(small, "components")
        drop_table(before)
        state = e.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last or not state["n"]:
            break
        last = state
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 6, width: int = 2, parts: int | None = None, leaf: int = 256) -> DataFrame:
    """One row per document: id, fp (long), root (the same throughout a component), n_near (others linked directly), component_id (smallest id reachable).

    Only fingerprints leave the scan; texts are read once and never shuffled.
    """
    prints = table(fingerprints(df, id_col, text_col, width), "fingerprints")
    distinct = table(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("low")), "distinct")
    near, forest = links(distinct, radius, parts, leaf)
    roots = components(forest)
    found = distinct.join(near, "fp", "left").join(roots, distinct["fp"] == roots["node"], "left").select("fp", "n", "low", "near", F.coalesce("root", "fp").alias("root"))
    found = table(found, "classes")
    least = found.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = found.join(least, "root").select("fp", "root", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), "component_id")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "root", "n_near", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one row of each component: one with the smallest id.

    Rows are picked by id, so hot groups never meet in one task. Only rows that share their id with
    another picked row (repeated ids, null ids) are told apart by their component.
    """
    found = table(near_duplicates(df, id_col, text_col, **options).withColumnRenamed(id_col, "__id"), "near-duplicates")
    picked = found.where(F.col("__id").eqNullSafe(F.col("component_id")))
    names = df.columns
    held = df.join(picked.select("__id").distinct(), F.col(f"`{id_col}`").eqNullSafe(F.col("__id")), "left_semi")
    per_id = found.groupBy("__id").agg(F.count("*").alias("n"), F.count_if(F.col("__id").eqNullSafe(F.col("component_id"))).alias("picked"))
    shared = per_id.where("n > 1 and picked > 0").select("__id")
    if shared.isEmpty():
        return held
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id"))
    alone, rest = held.join(shared, same, "left_anti"), held.join(shared, same, "left_semi")
    roots = picked.select("__id", F.col("fp").alias("__pfp"), F.col("root").alias("__root")).distinct()
    one = with_fingerprint(rest, text_col, options.get("width", 2)).join(roots, same & (F.col("__fp") == F.col("__pfp")))
    return alone.unionByName(one.dropDuplicates([id_col, "__root"]).select(*(F.col(f"`{c}`") for c in names)))


def with_fingerprint(df: DataFrame, text_col: str = "text", width: int = 2, seed: int = 42) -> DataFrame:
    """df with a column __fp."""
    ship(df.sparkSession)

    @F.pandas_udf("long")
    def fp(t):
        import pandas as pd

        made = [fingerprints_of(t.iloc[i : i + 256].tolist(), width, seed) for i in range(0, len(t), 256)]
        return pd.Series(np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64))

    return df.withColumn("__fp", fp(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
