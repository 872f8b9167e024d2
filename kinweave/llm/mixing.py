"""Mixing sources to target weights by temperature.

A source with share p of all tokens gets weight p**a / sum(p**a). The exponent a is found by
bisection: below 1 the mix is flatter than the sources are, above 1 steeper. With a target entropy it is the
one whose weights have that entropy; a limit on repetition (no source is read more often than that) leaves a
range of exponents around 1, to whose nearest end the former is moved, or whose smallest member (the
flattest mix) is taken if there is no target entropy. `met` says which of the two decided, or that
a target cannot be reached by any exponent (all sources equal, more tokens asked for than the limit allows):
the mix is then the proportional one.

Weights then become documents. The budget of a source is a whole number of tokens, met by whole passes
over it and a last partial pass, which takes blocks of the source in a permuted order and, in the block where the
budget ends, documents in permuted order until it is met. The end is found on (source, order, tokens) rows by
three aggregations, each over a thousandth of the rows of the last; texts are never shuffled or put in order.

Sources may be many (one each host): all their statistics are aggregations too, and a step of the
bisection looks at many exponents in one job. The driver sees only those sums.

Defined results: a null source is a source of its own; a null or empty text has no tokens, weighs
nothing and is read as often as whole passes say; rows with the same id and text are taken or left together; an empty
table gives an empty result; columns other than the named ones are carried along untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Rows (source, exponent) that one step of the bisection looks at, while that allows more than 15 exponents; at most 1023.
STEP_ROWS = 1 << 20
#: The steepest exponent tried.
STEEPEST = 2.0**20


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: list[float], a: float) -> list[float]:
    top = max((math.log(s) for s in shares if s > 0), default=0.0)
    raw = [math.exp(a * (math.log(s) - top)) if s > 0 else 0.0 for s in shares]
    total = sum(raw) or 1.0
    return [r / total for r in raw]


def _bisect(low: float, high: float, enough: Callable[[list[float]], list[bool]], fan: int) -> float:
    """The least exponent for which `enough` holds, given that it does for `high` and that it stays true from there on."""
    while high - low > 1e-15 * max(1.0, high):
        inner = [x for x in (low + (high - low) * k / (fan + 1) for k in range(1, fan + 1)) if low < x < high]
        if not inner:
            break
        first = next((k for k, ok in enumerate(enough(inner)) if ok), len(inner))
        low, high = (inner[first - 1] if first else low), (inner[first] if first < len(inner) else high)
    return high


def solve(sums: Callable[[list[float]], list[tuple[float, float]]], least: float, largest: float, budget: float, target_entropy: float | None, max_repeats: float | None, fan: int = 63) -> tuple[float, str]:
    """(exponent, what decided it). sums: of each exponent a, (log of the sum of x**a, entropy of the weights), where x are the
    sources' tokens over those of the largest; least, largest: tokens of the smallest and largest source that has any."""
    wanted, met = 1.0, "proportional"
    if target_entropy is not None:
        tries = [2.0**k for k in range(21)]
        found = sums([0.0, *tries])
        if found[0][1] <= target_entropy + 1e-12:
            wanted, met = 0.0, "entropy" if found[0][1] >= target_entropy - 1e-9 else "unreachable"
        elif (hit := next((k for k, (_, h) in enumerate(found[1:]) if h <= target_entropy), None)) is None:
            met = "unreachable"
        else:
            wanted, met = _bisect(0.0 if not hit else tries[hit - 1], tries[hit], lambda a: [h <= target_entropy for _, h in sums(a)], fan), "entropy"
    if max_repeats is not None:

        def within(a: list[float]) -> list[bool]:
            extreme = math.log(least / largest)  # of the source that is read most often
            return [math.log(budget / largest) + min(0.0, x - 1) * extreme - z <= math.log(max_repeats) + 1e-12 for x, (z, _) in zip(a, sums(a))]

        if budget <= 0:
            return wanted, met
        if not within([1.0])[0]:
            return 1.0, "unreachable"
        if target_entropy is None or wanted < 1.0:
            low = 0.0 if within([0.0])[0] else _bisect(0.0, 1.0, within, fan)
            if target_entropy is None or low > wanted:
                return low, "repeats"
        elif wanted > 1.0 and not within([wanted])[0]:
            return _bisect(1.0, wanted, lambda a: [not ok for ok in within(a)], fan), "repeats"
    return wanted, met


def fit_exponent(tokens: list[float], budget: float, target_entropy: float | None = None, max_repeats: float | None = None) -> tuple[float, str]:
    """`solve` for sources at hand."""
    some = [t for t in tokens if t > 0]
    if not some:
        return 1.0, "proportional"
    logs = [math.log(t / max(some)) for t in some]

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        out = []
        for a in exponents:
            x = [math.exp(a * y) for y in logs]
            z = sum(x)
            out.append((math.log(z), math.log(z) - a * sum(p * y for p, y in zip(x, logs)) / z))
        return out

    return solve(sums, min(some), max(some), budget, target_entropy, max_repeats)


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def weigh(sources: DataFrame, budget: int | None, target_entropy: float | None, entropy_share: float | None, max_repeats: float | None) -> DataFrame:
    """(s, tokens) of each source with weight, passes, rest (tokens of the partial pass), exponent and met."""
    all_ = sources.agg(F.sum("tokens").alias("total"), F.count_if(F.col("tokens") > 0).alias("n"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least"), F.max("tokens").alias("largest")).first()
    total, largest = int(all_["total"] or 0), float(all_["largest"] or 0)
    want_all = total if budget is None else int(budget)
    a, met, z = 1.0, "proportional", 0.0
    if total:
        if entropy_share is not None and target_entropy is None:
            target_entropy = entropy_share * math.log(all_["n"])
        logs = sources.where("tokens > 0").select(F.log(F.col("tokens") / F.lit(largest)).alias("y")).groupBy("y").agg(F.count("*").alias("n"))
        x = F.col("n") * F.exp(F.col("a") * F.col("y"))

        def sums(exponents: list[float]) -> list[tuple[float, float]]:
            each = logs.withColumn("a", F.explode(F.array(*map(F.lit, exponents)))).groupBy("a").agg(F.sum(x).alias("z"), F.sum(x * F.col("y")).alias("m"))
            got = {r["a"]: (math.log(r["z"]), math.log(r["z"]) - r["a"] * r["m"] / r["z"]) for r in each.collect()}  # one row for each exponent
            return [got[e] for e in exponents]

        a, met = solve(sums, float(all_["least"]), largest, want_all, target_entropy, max_repeats, max(15, min(1023, STEP_ROWS // all_["n"])))
        z = sums([a])[0][0]
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(largest)) - F.lit(z))).otherwise(0.0)
    want = F.col("tokens") if a == 1.0 and budget is None else F.round(F.col("weight") * F.lit(float(want_all))).cast("long")
    out = sources.withColumn("weight", weight).withColumn("want", want)
    passes = F.when(F.col("tokens") > 0, F.expr("want div tokens")).otherwise(1).cast("long")
    rest = F.when(F.col("tokens") > 0, F.expr("want % tokens")).otherwise(0).cast("long")
    return out.withColumns({"passes": passes, "rest": rest, "exponent": F.lit(a), "met": F.lit(met)}).drop("want")


def _end(rows: DataFrame) -> DataFrame:
    """Of (s, k, tokens, rest): for each s the key k in which the rest ends, in order of k, and what is left of it there."""
    sums = rows.groupBy("s", "k").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("left", F.col("rest") - before).where("left > 0").groupBy("s").agg(F.max("k").alias("k"), F.max_by("left", "k").alias("rest"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, target_entropy: float | None = None, entropy_share: float | None = 0.95, max_repeats: float | None = 4.0, blocks: int = 1024, seed: int = 7) -> DataFrame:
    """df's rows with __tokens, __weight, __exponent, __met, __copies (times the document is read) and __order.

    budget: tokens in all (None: as many as there are); entropy_share: the target entropy as a part
    of the largest possible one. __order permutes documents within the mix. Joins are with one row for each source:
    Spark broadcasts those while they are few.
    """
    order = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    source, text = F.col(f"`{source_col}`"), F.col(f"`{text_col}`").cast("string")
    block = lambda s, o: F.xxhash64(F.lit(seed), s, F.pmod(F.xxhash64(F.lit(seed + 1), o), F.lit(blocks)))
    rows = table(df.select(source.alias("s"), order.alias("o"), n_tokens(text).alias("tokens")), "mix-rows")
    sources = table(rows.groupBy("s").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    weights = table(weigh(sources, budget, target_entropy, entropy_share, max_repeats), "mix-weights")

    def meet(rows: DataFrame, ends: DataFrame, key: Column, *same: str) -> DataFrame:
        """Rows with the rest of their source, of those that agree with its end so far, and the key to look at next."""
        on = F.col("s").eqNullSafe(F.col("es"))
        for c in same:
            on &= F.col(c) == F.col(f"e{c}")
        return rows.join(ends.select(*(F.col(c).alias(f"e{c}") for c in ("s", *same)), "rest"), on).select("s", key.alias("k"), "tokens", "rest")

    placed = rows.withColumns({"b": block(F.col("s"), F.col("o")), "p": F.shiftright("o", 54)})
    sizes = placed.groupBy("s", "b").agg(F.sum("tokens").alias("tokens"))
    ends = _end(meet(sizes, weights.where("rest > 0").select("s", "rest"), F.col("b"))).withColumnRenamed("k", "b")
    parts = _end(meet(placed, ends, F.col("p"), "b")).withColumnRenamed("k", "p")
    parts = table(ends.select("s", "b").join(parts.withColumnRenamed("s", "ps"), F.col("s").eqNullSafe(F.col("ps"))).drop("ps"), "mix-ends")
    last = _end(meet(placed, parts, F.col("o"), "b", "p"))
    cuts = parts.drop("p", "rest").join(last.select(F.col("s").alias("ls"), F.col("k").alias("o")), F.col("s").eqNullSafe(F.col("ls"))).drop("ls")
    plan = weights.join(cuts.select(F.col("s").alias("cs"), "b", "o"), F.col("s").eqNullSafe(F.col("cs")), "left")
    plan = table(plan.select(F.col("s").alias("__s"), F.col("weight").alias("__weight"), "passes", F.col("b").alias("__b"), F.col("o").alias("__o"), F.col("exponent").alias("__exponent"), F.col("met").alias("__met")), "mix-plan")

    marked = df.withColumns({"__source": source, "__tokens": n_tokens(text), "__order": order}).withColumn("__block", block(F.col("__source"), F.col("__order")))
    joined = marked.join(plan, F.col("__source").eqNullSafe(F.col("__s")), "left")
    extra = (F.col("__block") < F.col("__b")) | ((F.col("__block") == F.col("__b")) & (F.col("__order") <= F.col("__o")))
    out = joined.withColumn("__copies", F.col("passes") + F.coalesce(extra, F.lit(False)).cast("long"))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), "__tokens", "__weight", "__exponent", "__met", "__copies", "__order")


def realise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as it is read."""
    return mixed.where("__copies > 0").withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*(F.col(f"`{c}`") for c in columns))
