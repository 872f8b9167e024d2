"""Paths between two entities.

Forward and reverse lists are cut each for itself, so a path is a run of forward-list edges followed by
a run of reverse-list edges. Both sweeps (from the start over forward lists, from the target over
reverse lists) go on until they are as deep as the best meeting found, which makes the result optimal.
Among optimal paths the one that follows forward lists longest is taken, then at every step the
strongest edge, then the smallest id.

A sweep is a loop of one job a level; each level is written as a part of one table, so plans stay small and
nothing of it is lost with an executor. With `local` a view of a bounded size is searched in memory instead
(see small.py) with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.values import cost
from ..store import Growing, observed
from .small import LOCAL_EDGES, UNIT, frame, small


@dataclass
class Graph:
    """Cut views of one edge table: forward lists, and reverse lists oriented from the owner."""

    forward: DataFrame
    reverse: DataFrame


class HopSweep:
    """Levels of a breadth-first search over a view, made one by one."""

    def __init__(self, view: DataFrame, start: DataFrame):
        self.view, self.depth = view.select("src", "dst").where("src != dst"), 0
        self.table = Growing(view.sparkSession, "levels")
        self.frontier, n = self.table.add(start.select("id", F.lit(0).alias("level")).distinct())
        self.sizes = [n]
        self.done = n == 0

    def visited(self) -> DataFrame:
        return self.table.all()

    def advance(self) -> bool:
        if self.done:
            return False
        reached = self.view.join(self.frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"))
        fresh = reached.join(self.visited().select("id"), "id", "left_anti").distinct().select("id", F.lit(self.depth + 1).alias("level"))
        self.frontier, n = self.table.add(fresh)
        if not n:
            self.done = True
            return False
        self.depth += 1
        self.sizes.append(n)
        return True


def hop_levels(view: DataFrame, start: DataFrame, most: int | None = None, local: bool = False) -> DataFrame:
    """(id, level) of every node within reach of start(id)."""
    held = small(view, local)
    if held is not None and start.count() <= LOCAL_EDGES:
        rows = list(held.levels([r["id"] for r in start.select("id").collect()], most).items())
        return frame(view.sparkSession, rows, ["id", "level"], [held.kind, pa.int32()])
    sweep = HopSweep(view, start)
    while (most is None or sweep.depth < most) and sweep.advance():
        pass
    return sweep.visited()


def profile(view: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(level, nodes, edges): of each level of a breadth-first search, its nodes and the list entries read to go on from it."""
    sweep = HopSweep(view, start)
    while (most is None or sweep.depth < most) and sweep.advance():
        pass
    levels = sweep.visited()
    read = levels.join(sweep.view.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    return read.groupBy("level").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))


#: A path's cost times this plus its number of hops: of equally cheap paths the shorter wins, and no step is free.
HOPS = 1 << 20


def step_cost(sim: Column) -> Column:
    return F.greatest(cost(sim), F.lit(0)) * F.lit(HOPS) + 1


def _steps(hops: bool):
    """step_cost or the plain cost, of a number."""
    units = lambda w: 0 if w != w else max(0, floor_half_up((1.0 - w) * UNIT))
    return (lambda w: units(w) * HOPS + 1) if hops else units


def floor_half_up(x: float) -> int:
    """What round() does in SQL: halves away from zero, judged on the shortest decimal form."""
    return int(Decimal(repr(x)).quantize(Decimal(1), ROUND_HALF_UP))


def distances(view: DataFrame, start: DataFrame, bound: int | None = None, nearest: int | None = None, stop_at=None, hops: bool = False, local: bool = False) -> DataFrame:
    """(id, c): least cost in billionths from start(id), by rounds of relaxation; with `hops` times HOPS plus hops.

    Only nodes whose distance fell last round are expanded. With `nearest`, nodes further than the
    nearest-th tentative distance are not expanded, as they cannot bring in a nearer one.
    """
    held = small(view, local)
    if held is not None and start.count() <= LOCAL_EDGES:
        rows = list(held.costs([r["id"] for r in start.select("id").collect()], _steps(hops)).items())
        return frame(view.sparkSession, rows, ["id", "c"], [held.kind, pa.int64()])
    edges = view.where("src != dst").select("src", "dst", (step_cost(F.col("sim")) if hops else F.greatest(cost(F.col("sim")), F.lit(0))).alias("w"))
    aims = F.lit(False) if stop_at is None else F.col("id") == F.lit(stop_at)

    def kept(rows: DataFrame) -> tuple[DataFrame, int, int | None]:
        """The distances so far, how many fell, and that of the aim."""
        out, seen = observed(rows, "distances", open=F.count_if(F.col("fresh")), at=F.min(F.when(aims, F.col("c"))))
        return out, seen["open"], seen["at"]

    state, open_, at = kept(start.select("id", F.lit(0).cast("long").alias("c"), F.lit(True).alias("fresh")).distinct())
    while open_:
        frontier, limit = state.where("fresh"), bound
        if nearest is not None:
            tail = state.orderBy("c").limit(nearest).agg(F.count("*").alias("n"), F.max("c").alias("c")).first()
            limit = tail["c"] if tail["n"] >= nearest else limit
        if at is not None and (limit is None or at < limit):
            limit = at
        if limit is not None:
            frontier = frontier.where(F.col("c") <= limit)
        reached = edges.join(frontier.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("c") + F.col("w")).alias("new"))
        joined = state.select("id", "c").join(reached, "id", "full_outer")
        better = F.col("new").isNotNull() & (F.col("c").isNull() | (F.col("new") < F.col("c")))
        state, open_, at = kept(joined.select("id", F.when(better, F.col("new")).otherwise(F.col("c")).alias("c"), better.alias("fresh")))
    return state.select("id", "c")


def _ids(spark: SparkSession, like: DataFrame, node) -> DataFrame:
    return spark.range(1).select(F.lit(node).cast(like.schema["src"].dataType).alias("id"))


def _has(graph: Graph, node) -> bool:
    """Whether the node is an end of any edge of the views."""
    same = (F.col("src") == F.lit(node)) | (F.col("dst") == F.lit(node))
    return not graph.forward.where(same).isEmpty() or not graph.reverse.where(same).isEmpty()


def _rows(spark: SparkSession, graph: Graph, steps: list[tuple]) -> DataFrame:
    kind = to_arrow_type(graph.forward.schema["src"].dataType)
    return frame(spark, [(k, i, None if s is None else float(s)) for k, (i, s) in enumerate(steps)], ["step", "id", "similarity"], [pa.int32(), kind, pa.float64()])


def _walk(view: DataFrame, known: DataFrame, node, at: int, weighted: bool) -> list[tuple]:
    """Nodes from `node` back to where known's value is 0: [(node, sim of the edge to the next)], strongest edge first."""
    out = []
    while at > 0:
        before = view.where((F.col("dst") == F.lit(node)) & (F.col("src") != F.lit(node))).join(known, F.col("src") == known["id"])
        want = (F.col("v") + step_cost(F.col("sim")) == at) if weighted else (F.col("v") == at - 1)
        row = before.where(want).orderBy(F.col("sim").desc(), "src").select("src", "sim", "v").first()
        out.append((node, row["sim"]))
        node, at = row["src"], row["v"]
    return [*out, (node, None)]


def _join_halves(front: list[tuple], back: list[tuple]) -> list[tuple]:
    """front: meeting node back to the start; back: meeting node on to the target; sims sit on the far end."""
    sims = [s for _, s in front]
    path = [(n, None) for n, _ in front[::-1]]
    path = [(n, sims[len(sims) - 1 - k] if k else None) for k, (n, _) in enumerate(path)]
    for k in range(1, len(back)):
        path.append((back[k][0], back[k - 1][1]))
    return path


def _small_path(graph: Graph, start, target, weighted: bool, local: bool) -> list[tuple] | None:
    """Steps of the path within views that are held in memory, [] without one; None if a view is too large."""
    ahead, behind = small(graph.forward, local), small(graph.reverse, local)
    if ahead is None or behind is None:
        return None
    if start == target:
        return [(start, None)] if start in ahead or start in behind else []
    step = _steps(True) if weighted else lambda w: 1
    front, back = (v.costs([n], step) if weighted else v.levels([n]) for v, n in ((ahead, start), (behind, target)))
    m = min(((c + back[n], -c, n) for n, c in front.items() if n in back), default=None)
    if m is None:
        return []
    return _join_halves(ahead.walk(front, m[2], -m[1], step), behind.walk(back, m[2], back[m[2]], step))


@dataclass
class Found:
    """The steps (step, id, similarity) of a path, and the ids that the search has seen."""

    path: DataFrame
    seen: DataFrame


def search(graph: Graph, start, target, weighted: bool = False, local: bool = False) -> Found:
    """A best path with the nodes visited on the way to it; no steps if there is none."""
    spark = graph.forward.sparkSession
    ends = _ids(spark, graph.forward, start)
    steps = _small_path(graph, start, target, weighted, local)
    if steps is not None:
        held = [small(v, True) for v in (graph.forward, graph.reverse)]
        seen = {n for v, x in zip(held, (start, target)) if x in v for n in v.levels([x])} if start != target else {start} if steps else set()
        return Found(_rows(spark, graph, steps), frame(spark, [(n,) for n in seen], ["id"], [held[0].kind]))
    if start == target:
        known = _has(graph, start)
        return Found(_rows(spark, graph, [(start, None)] if known else []), ends if known else ends.limit(0))
    return (_weighted if weighted else _hops)(graph, ends, start, target)


def _hops(graph: Graph, ends: DataFrame, start, target) -> Found:
    spark = graph.forward.sparkSession
    front, back = HopSweep(graph.forward, ends), HopSweep(graph.reverse, _ids(spark, graph.forward, target))
    best = None
    while best is None or min(front.depth, back.depth) < best:
        moved = [x.advance() for x in (front, back) if best is None or x.depth < best]
        if not any(moved):
            break
        meet = front.visited().join(back.visited().withColumnRenamed("level", "rest"), "id")
        row = meet.select((F.col("level") + F.col("rest")).alias("n")).agg(F.min("n")).first()
        best = row[0] if row[0] is not None else best
    seen = front.visited().select("id").union(back.visited().select("id")).distinct()
    if best is None:
        return Found(_rows(spark, graph, []), seen)
    meet = front.visited().join(back.visited().withColumnRenamed("level", "rest"), "id").where(F.col("level") + F.col("rest") == best)
    m = meet.orderBy(F.col("level").desc(), "id").first()
    a = _walk(graph.forward, front.visited().withColumnRenamed("level", "v"), m["id"], m["level"], False)
    b = _walk(graph.reverse, back.visited().withColumnRenamed("level", "v"), m["id"], m["rest"], False)
    return Found(_rows(spark, graph, _join_halves(a, b)), seen)


def _weighted(graph: Graph, ends: DataFrame, start, target) -> Found:
    spark = graph.forward.sparkSession
    front = distances(graph.forward, ends, stop_at=target, hops=True)
    direct = front.where(F.col("id") == F.lit(target)).agg(F.min("c")).first()[0]
    back = distances(graph.reverse, _ids(spark, graph.forward, target), bound=direct, hops=True)
    seen = front.select("id").union(back.select("id")).distinct()
    meet = front.join(back.withColumnRenamed("c", "rest"), "id").withColumn("total", F.col("c") + F.col("rest"))
    m = meet.orderBy("total", F.col("c").desc(), "id").first()
    if m is None:
        return Found(_rows(spark, graph, []), seen)
    a = _walk(graph.forward, front.withColumnRenamed("c", "v"), m["id"], m["c"], True)
    b = _walk(graph.reverse, back.withColumnRenamed("c", "v"), m["id"], m["rest"], True)
    return Found(_rows(spark, graph, _join_halves(a, b)), seen)


def hop_path(graph: Graph, start, target, local: bool = False) -> DataFrame:
    """(step, id, similarity) of a shortest path by hops; no rows if there is none."""
    return search(graph, start, target, False, local).path


def weighted_path(graph: Graph, start, target, local: bool = False) -> DataFrame:
    """(step, id, similarity) of a path of least total 1 - similarity, and of these with fewest hops; no rows if there is none."""
    return search(graph, start, target, True, local).path


def path_edges(path: DataFrame) -> DataFrame:
    """(src, dst, sim) of neighbouring steps; the path is short, so one task orders it."""
    rows = path.agg(F.array_sort(F.collect_list(F.struct("step", "id", "similarity"))).alias("p"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda k: F.struct(F.get("p", k - 1)["id"].alias("src"), F.get("p", k)["id"].alias("dst"), F.get("p", k)["similarity"].alias("sim")))
    return rows.select(F.explode(pairs).alias("e")).select("e.*").where("dst is not null")


def visited_count(front: DataFrame, back: DataFrame) -> DataFrame:
    return front.select("id").union(back.select("id")).distinct().agg(F.count("*").alias("visited"))
