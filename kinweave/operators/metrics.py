"""Whole-graph statistics, exact over all edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import ship, table, with_row
from .edges import top_edges


def owners(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct()


def graph_counts(edges: DataFrame) -> DataFrame:
    """nodes, edges, sources and density in one row; one pass marks both ends of each edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out")))).alias("e"))
    nodes = ends.groupBy("e.id").agg(F.sum("e.out").alias("out"))
    row = nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("out"), F.lit(0)).cast("long").alias("edges"), F.coalesce(F.sum((F.col("out") > 0).cast("long")), F.lit(0)).alias("sources"))
    return row.withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes").cast("double") * (F.col("nodes") - 1))).otherwise(0.0))


def out_degree(edges: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(id, degree); with records(id), owners of empty lists count as 0."""
    found = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    if records is None:
        return found
    return records.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    """(id, degree) of nodes with an incoming edge."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))


def cumulated(h: DataFrame, value: str, *counts: str) -> DataFrame:
    """h, with one row for each value, and for each count column c the sum c_before over all smaller values.

    Rows are put into ranges of values; each range is summed by itself and starts from the totals of those before it.
    """
    parts = h.repartitionByRange(value).withColumn("__part", F.spark_partition_id())
    parts = table(parts, "ranges")
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = parts.groupBy("__part").agg(*(F.sum(c).alias(c) for c in counts)).select("__part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__{c}") for c in counts))
    within = Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.join(F.broadcast(starts), "__part")
    return joined.withColumns({f"{c}_before": F.col(f"__{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in counts}).drop("__part", *(f"__{c}" for c in counts))


def quantiles(h: DataFrame, value: str, count: str, shares: dict[str, float]) -> DataFrame:
    """One row with quantiles (linear between neighbours) of a histogram, found by rank."""
    x, n, before = F.col(value).cast("double"), F.col(count), F.col(f"{count}_before")
    placed = with_row(cumulated(h, value, count), h.agg(F.sum(count).alias("__n")))
    at = {name: (F.col("__n") - 1) * share for name, share in shares.items()}
    holds = lambda k: (before <= k) & (k < before + n)  # noqa: E731  the value of rank k, from 0
    row = placed.agg(*(F.max(F.when(holds(f(at[name])), x)).alias(f"{name}_{k}") for name in shares for k, f in ((0, F.floor), (1, F.ceil))), *(F.max(at[name] - F.floor(at[name])).alias(f"{name}_w") for name in shares))
    return row.select(*((F.col(f"{q}_0") + (F.col(f"{q}_1") - F.col(f"{q}_0")) * F.col(f"{q}_w")).alias(q) for q in shares))


def summary(values: DataFrame, column: str) -> DataFrame:
    """Mean, median, population deviation, extremes, quartiles (linear) and number of values.

    Quartiles come from ranks in a histogram, so no task and no buffer holds all values.
    """
    x = F.col(column).cast("double")
    plain = values.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"))
    h = histogram(values.where(F.col(column).isNotNull()), column)
    return with_row(plain, quantiles(h, "value", "count", {"q25": 0.25, "median": 0.5, "q75": 0.75})).select("mean", "median", "std", "min", "max", "q25", "q75", "n")


def histogram(values: DataFrame, column: str) -> DataFrame:
    return values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))


def gini(values: DataFrame, column: str) -> DataFrame:
    """Gini coefficient from the histogram: ranks of equal values sum in closed form."""
    h = cumulated(histogram(values.where(F.col(column).isNotNull()), column), "value", "count").withColumnRenamed("count_before", "before")
    c = F.col("count").cast("double")
    ranks = c * F.col("before") + c * (c + 1) / 2
    row = h.agg(F.sum(ranks * F.col("value")).alias("weighted"), F.sum(c * F.col("value")).alias("total"), F.sum(c).alias("n"))
    return row.select(F.when(F.col("total") > 0, 2 * F.col("weighted") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"))


def power_law(values: DataFrame, column: str) -> DataFrame:
    """Least squares of log10(count) on log10(value) over values > 0; no row with under two distinct ones."""
    h = histogram(values.where(F.col(column) > 0), column)
    y, x = F.log10(F.col("count").cast("double")), F.log10(F.col("value").cast("double"))
    row = h.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("points"))
    return row.where("points > 1").select((-F.col("slope")).alias("alpha"), "intercept", "r2", "points")


def fit_curve(fit: DataFrame, degrees: DataFrame, column: str, points: int = 50) -> DataFrame:
    """The fitted line at `points` places, evenly spaced in log10 between the extreme degrees."""
    span = degrees.where(F.col(column) > 0).agg(F.log10(F.min(column).cast("double")).alias("lo"), F.log10(F.max(column).cast("double")).alias("hi"))
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    grid = span.select("lo", "hi", at).select("k", F.pow(F.lit(10.0), F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x"))
    return with_row(grid, fit.select("intercept", "alpha")).select("k", "x", (F.pow(F.lit(10.0), "intercept") * F.pow(F.col("x"), -F.col("alpha"))).alias("y"))


def bins(values: DataFrame, column: str, number: int = 50) -> DataFrame:
    """(bin, low, count) of a histogram with bins of one width; empty bins are left out."""
    x = F.col(column).cast("double")
    span = values.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / number
    k = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((x - F.col("lo")) / width), F.lit(number - 1))).otherwise(0).cast("int")
    marked = with_row(values, span).select(k.alias("bin"), "lo", width.alias("w"))
    return marked.groupBy("bin").agg(F.count("*").alias("count"), F.first("lo").alias("lo"), F.first("w").alias("w")).select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), "count")


def density_curve(values: DataFrame, column: str, at: list[float], bandwidth: float = 0.1) -> DataFrame:
    """Gaussian kernel density of a column at some places, in one pass over the rows."""
    grid = F.array(*(F.lit(float(x)) for x in at))
    norm = 1.0 / (bandwidth * (2 * 3.141592653589793) ** 0.5)
    kernel = values.select(F.posexplode(F.transform(grid, lambda g: F.exp(-F.pow((g - F.col(column)) / bandwidth, F.lit(2.0)) / 2) * norm)).alias("k", "d"))
    return kernel.groupBy("k").agg(F.avg("d").alias("density")).select("k", F.element_at(grid, F.col("k") + 1).alias("x"), "density")


def evenly_spaced(values: DataFrame, order: str, most: int = 1000) -> DataFrame:
    """At most `most` rows, evenly spaced in the order of a column without equal values (a histogram)."""
    n = values.agg(F.count("*").alias("n"))
    ranked = with_row(cumulated(values.withColumn("__one", F.lit(1)), order, "__one").withColumnRenamed("__one_before", "k").drop("__one"), n)
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("n") - 1) / F.lit(most - 1)))
    return ranked.where((F.col("n") <= most) | F.array_contains(picks, F.col("k").cast("long"))).drop("n", "k")


def reciprocity(edges: DataFrame) -> DataFrame:
    """Distinct edges whose reverse exists, over all edges.

    Both directions of a pair are brought together by one aggregation, without a self join.
    """
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"), F.max((F.col("src") <= F.col("dst")).cast("int")).alias("up"), F.max((F.col("src") >= F.col("dst")).cast("int")).alias("down"))
    both = F.when((F.col("up") == 1) & (F.col("down") == 1), F.when(F.col("a") == F.col("b"), 1).otherwise(2)).otherwise(0)
    row = pairs.agg(F.coalesce(F.sum(both), F.lit(0)).cast("long").alias("mutual"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("edges"))
    return row.withColumn("reciprocity", F.when(F.col("edges") > 0, F.col("mutual") / F.col("edges")).otherwise(0.0))


#: Links that one task of `wedges` holds, and linked nodes from which a node is looked up in their list instead of reading it.
BLOCK_LINKS, LONG_LINKS = 1 << 21, 4096


def _closed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(id, closed) of the lists of one block: rows (kind, id, l), first the links (0) of the block's nodes to larger ones, then the lists (1).

    Of nodes with up to `most` links these are read, in those of others the list is looked up.
    """
    held, known = [], None
    for b in batches:
        kind, ids, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        first = int(np.searchsorted(kind, 1))
        held += [(int(ids[k]), flat[ends[k] : ends[k + 1]].copy()) for k in range(first)]
        if first == len(kind):
            continue
        if known is None:
            held.sort(key=lambda x: x[0])
            known = np.array([x for x, _ in held], np.int64)
            size = np.array([len(l) for _, l in held], np.int64)
            start = np.concatenate([[0], np.cumsum(size)]).tolist()
            far = np.concatenate([l for _, l in held]) if held else np.zeros(0, np.int64)
            names = np.unique(far)
            near = np.searchsorted(names, far).astype(np.int32)
            for k in range(len(held)):
                near[start[k] : start[k + 1]].sort()
            del held, far
            held, mark, long = [], np.zeros(len(names), np.uint8), size > most
        out = np.zeros(len(kind) - first, np.int64)
        if len(known):
            part = flat[ends[first] : ends[-1]]
            x, y = np.minimum(np.searchsorted(known, part), len(known) - 1), np.minimum(np.searchsorted(names, part), len(names) - 1)
            is_x, is_y = known[x] == part, names[y] == part
            for k in range(len(out)):
                i, j = ends[first + k] - ends[first], ends[first + k + 1] - ends[first]
                mine, other = x[i:j][is_x[i:j]], y[i:j][is_y[i:j]]
                short = mine[~long[mine]].tolist()
                mark[other] = 1
                if short:
                    out[k] = np.count_nonzero(mark[np.concatenate([near[start[m] : start[m + 1]] for m in short])])
                mark[other] = 0
                for m in mine[long[mine]].tolist():
                    row = near[start[m] : start[m + 1]]
                    out[k] += np.count_nonzero(row[np.minimum(np.searchsorted(row, other), len(row) - 1)] == other)
        yield pa.RecordBatch.from_arrays([pa.array(ids[first:]), pa.array(out)], names=["id", "closed"])


def wedges(edges: DataFrame) -> DataFrame:
    """(id, wedges, closed) of nodes with two out-neighbours or more over edges with sim > 0.

    A wedge is a pair of out-neighbours; it is closed if either lists the other. Lists are short (cut them with top_edges first).
    Wedges are not made: nodes are put into blocks of some BLOCK_LINKS links to larger nodes, each list goes once to every block that has
    one of its nodes, from that node on, and is held against the links there. So at most half the square of a list is sent, and one copy of it
    where neighbours have near ids.
    """
    spark = edges.sparkSession
    e = edges.where("sim > 0 and src != dst").select("src", "dst")
    kind, names = e.schema["src"].dataType, None
    if isinstance(kind, T.IntegralType):
        e = e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    else:
        nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("one", F.lit(1))
        names = table(cumulated(nodes, "node", "one").select("node", F.col("one_before").cast("long").alias("n")), "names")
        a, b = (names.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n")) for c in ("src", "dst"))
        e = e.join(a, "src").join(b, "dst").select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst"))
    lists = table(e.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("l")).where("size(l) > 1"), "lists")
    links = table(e.groupBy(F.least("src", "dst").alias("id")).agg(F.collect_set(F.greatest("src", "dst")).alias("l")), "links")
    starts = cumulated(links.select("id", F.size("l").cast("long").alias("n")), "id", "n").groupBy(F.floor(F.col("n_before") / BLOCK_LINKS).alias("block")).agg(F.min("id").alias("id"))
    starts = np.array(sorted(r["id"] for r in starts.collect()), np.int64)  # one for each block

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ends, flat = b.column(0).to_numpy(), b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            block = np.searchsorted(starts, flat, side="right") - 1
            to, who, at, upto = [], [], [], []
            for k in range(len(ids)):
                i, j = int(ends[k]), int(ends[k + 1])
                blocks, first = np.unique(block[i:j], return_index=True)
                first = first[blocks >= 0] + i
                first = first[first < j - 1]  # its last node makes no pair
                to.append(block[first])
                who += [ids[k]] * len(first)
                at += first.tolist()
                upto += [j] * len(first)
            sent = [flat[i:j] for i, j in zip(at, upto)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sent])]).astype(np.int32)
            values = pa.array(np.concatenate(sent) if sent else np.zeros(0, np.int64))
            columns = [pa.array(np.concatenate(to).astype(np.int32) if to else np.zeros(0, np.int32)), pa.array(np.ones(len(who), np.int8)), pa.array(np.array(who, np.int64)), pa.ListArray.from_arrays(pa.array(ends), values)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "kind", "id", "l"])

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = np.searchsorted(starts, b.column(0).to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(np.zeros(len(block), np.int8)), b.column(0), b.column(1)], names=["block", "kind", "id", "l"])

    ship(spark)
    sent = lists.select("id", "l").mapInArrow(route, "block int, kind byte, id long, l array<long>")
    own = links.mapInArrow(owned, "block int, kind byte, id long, l array<long>")
    blocks = own.union(sent).repartitionById(max(1, len(starts)), "block").sortWithinPartitions("kind").select("kind", "id", "l")
    most = LONG_LINKS
    closed = blocks.mapInArrow(lambda batches: _closed(batches, most), "id long, closed long").groupBy("id").agg(F.sum("closed").alias("closed"))
    n = F.size("l").cast("long")
    out = lists.select("id", (n * (n - 1) / 2).cast("long").alias("wedges")).join(closed, "id", "left").select("id", "wedges", F.coalesce("closed", F.lit(0)).cast("long").alias("closed"))
    if names is None:
        return out.withColumn("id", F.col("id").cast(kind))
    return out.withColumnRenamed("id", "n").join(names, "n").select(F.col("node").alias("id"), "wedges", "closed")


def clustering(edges: DataFrame, cap: int = 250) -> DataFrame:
    """Mean local clustering over nodes with a wedge, and transitivity over all wedges, of the `cap` strongest edges of each node."""
    return wedges(table(top_edges(edges.where("sim > 0"), 0.0, cap).select("src", "dst", "sim"), "capped")).agg(F.avg(F.col("closed") / F.col("wedges")).alias("mean_local"), (F.sum("closed") / F.sum("wedges")).alias("transitivity"), F.sum("wedges").alias("wedges"))


def top_nodes(degrees: DataFrame, entities: DataFrame, k: int = 20, largest_id_first: bool = False) -> DataFrame:
    """The k nodes of largest degree with their names (the id where there is none)."""
    best = degrees.orderBy(F.col("degree").desc(), F.col("id").desc() if largest_id_first else F.col("id")).limit(k)
    return best.join(entities.select("id", "name"), "id", "left").select("id", "degree", F.coalesce("name", F.col("id").cast("string")).alias("name"))


