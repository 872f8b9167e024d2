"""Quality rules by weak supervision.

Each rule votes good (+1) or bad (-1) on a document, or abstains (0). No rule rejects by itself:
expectation-maximisation over the votes of the whole corpus estimates how often each rule votes
either way on good and on bad documents, and the posterior probability of "good" decides.

EM needs only how often each vote pattern occurs. With m rules there are at most 3**m patterns,
whatever the number of documents, so one aggregation with map-side combine sees every document and
the driver gets a table of bounded size; the posteriors go back as an equally bounded map.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are
judged each by itself; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, schema_of, ship, slices, table

SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_distinct long, n_ends long, top_word long, n_digits long"
_NAMES = [x.split()[0] for x in MEASURES.split(", ")]
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_WIDE = re.compile("[^\x00-\x7f]")


def _among(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def _repeats(number: np.ndarray, kinds: int) -> int:
    """Words in windows of three that are found twice or more, given each word's number."""
    if len(number) < 4:
        return 0
    if kinds < 1 << 20:
        key = (number[:-2] * kinds + number[1:-1]) * kinds + number[2:]
    else:
        _, first = np.unique(number[:-1] * kinds + number[1:], return_inverse=True)
        key = first[:-1] * kinds + number[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    flags = np.zeros(len(number), bool)
    for k in range(3):
        flags[k : len(number) - 2 + k] |= twice
    return int(flags.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The figures of MEASURES for one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    n_upper, n_lower = _among(raw, _UPPER), _among(raw, _LOWER)
    if len(raw) != len(text):
        for c, n in Counter(_WIDE.findall(text)).items():
            n_upper += n * c.isupper()
            n_lower += n * c.islower()
    return (
        len(words),
        len(text) - _among(raw, WHITE),
        _among(raw, SYMBOLS),
        len(lines) - len(set(lines)),
        _repeats(number, len(known)),
        len(lines),
        n_upper,
        n_upper + n_lower,
        len(known),
        _among(raw, b".!?"),
        int(np.bincount(number).max()) if len(number) else 0,
        _among(raw, b"0123456789"),
    )


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of figures per document, in one pass without a shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = list(zip(*map(measure, b.column(1).to_pylist()))) or [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["__id", *_NAMES])

    picked = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    schema = schema_of(MEASURES)
    schema.fields.insert(0, picked.schema["__id"])
    schema.names.insert(0, "__id")
    return picked.mapInArrow(run, type(schema)(schema.fields))


def base_failed() -> Column:
    """The hard rules that come before any vote."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Vote of each rule as a Catalyst expression over MEASURES.

    A defect rule votes bad or abstains, as the lack of one defect proves nothing; every kind of
    defect is seen by two rules at least, so that EM can weigh one against the other. Only the two
    rules that look at the text as a whole vote good.
    """
    c = {n: F.col(n).cast("double") for n in _NAMES}
    words, letters, lines, chars = (F.greatest(c[n], F.lit(1.0)) for n in ("n_words", "n_letters", "n_lines", "word_chars"))
    never = F.lit(False)
    plain = (c["n_symbols"] <= 0.05 * words) & (c["n_upper"] <= 0.15 * letters) & (c["n_repeat_words"] <= 0.2 * words)
    return {
        "symbols_per_word": _vote(c["n_symbols"] > 0.2 * words, never),
        "symbols_per_char": _vote(c["n_symbols"] > 0.04 * chars, never),
        "capital_letters": _vote(c["n_upper"] > 0.5 * letters, never),
        "capital_chars": _vote(c["n_upper"] > 0.3 * chars, never),
        "repeated_windows": _vote(c["n_repeat_words"] > 0.35 * words, never),
        "few_words": _vote(c["n_distinct"] < 0.5 * F.sqrt(words), never),
        "one_word": _vote(c["top_word"] > 0.3 * words, never),
        "repeated_lines": _vote((c["n_dup_lines"] > 0.5 * lines) & (c["n_lines"] >= 6), never),
        "no_letters": _vote(c["n_letters"] < 0.5 * chars, never),
        "sentences": _vote(c["n_ends"] > 0.8 * words, plain & c["n_ends"].between(0.02 * words, 0.3 * words)),
        "word_length": _vote((c["word_chars"] < 2.5 * words) | (c["word_chars"] > 14 * words), plain & c["word_chars"].between(3 * words, 10 * words)),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, start: float = 0.9, floor: float = 0.6) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns (k x m of -1, 0, 1) with their counts.

    Naive Bayes in which an abstention says nothing. Returns the accuracy of each rule's bad and good
    votes (m x 2: how often such a vote is right), the share of good documents, and the posterior of
    each pattern. Accuracies start at `start` and never fall under `floor`, which keeps the two
    classes from swapping; without documents the start is returned.
    """
    m = patterns.shape[1] if patterns.ndim == 2 else 0
    right, prior = np.full((m, 2), start), 0.9
    cast = [patterns == v for v in (-1, 1)]

    def logit(p: np.ndarray | float) -> np.ndarray:
        return np.log(p) - np.log1p(-np.asarray(p))

    def posterior() -> np.ndarray:
        base = logit(prior)
        score = base + cast[0] @ (-logit(right[:, 0]) - base) + cast[1] @ (logit(right[:, 1]) - base)
        return 1.0 / (1.0 + np.exp(-np.clip(score, -500, 500)))

    post = posterior() if len(counts) else np.zeros(0)
    for _ in range(rounds if len(counts) else 0):
        for k, good in ((0, 1 - post), (1, post)):
            mass = counts @ cast[k]
            right[:, k] = np.clip((counts * good) @ cast[k] / np.maximum(mass, 1), floor, 0.999)
            right[mass == 0, k] = start
        prior = float(np.clip(np.average(post, weights=counts), 0.05, 0.95))
        new = posterior()
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return right, prior, post


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Measures, votes, posterior and verdict of every document, without its text.

    The figures of each document (some 100 bytes) are written to the shared folder, as both the
    fit and the verdicts need them and texts are to be read once only.
    """
    votes = rules()
    found = table(measures(df, id_col, text_col), "measures").withColumns({f"vote_{n}": v for n, v in votes.items()}).withColumn("base_failed", base_failed())
    names = [f"vote_{n}" for n in votes]
    key = F.concat_ws(",", *names)
    seen = found.groupBy(key.alias("pattern")).count().collect()  # 3**m rows at most
    patterns = np.array([[int(v) for v in r["pattern"].split(",")] for r in seen], int).reshape(-1, len(names))
    _, _, post = fit_votes(patterns, np.array([r["count"] for r in seen], float))
    spark = df.sparkSession
    known = spark.createDataFrame([(r["pattern"], float(p)) for r, p in zip(seen, post)], "pattern string, posterior double")
    out = found.withColumn("pattern", key).join(F.broadcast(known), "pattern", "left").drop("pattern")
    out = out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= threshold))
    return out.withColumnRenamed("__id", id_col)


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose own text is kept.

    The verdict is a function of the votes, so rows are judged where they are: the fitted posteriors
    come as a map of bounded size and no row is joined by its id.
    """
    ship(docs.sparkSession)
    found = quality_patterns(docs, text_col)
    good = sorted(p for p, post in found.items() if post >= threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = list(zip(*map(measure, b.column(b.schema.get_field_index("__text")).to_pylist()))) or [[]] * len(_NAMES)
            at = [i for i, n in enumerate(b.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in at), *(pa.array(c, pa.int64()) for c in cols)], names=[*(f"c{k}" for k in range(len(at))), *(f"m_{n}" for n in _NAMES)])

    columns = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    picked = docs.select(*columns, F.col(f"`{text_col}`").cast("string").alias("__text"))
    fields = [picked.schema[f"c{k}"] for k in range(len(docs.columns))]
    wide = picked.mapInArrow(run, type(picked.schema)([*fields, *schema_of(", ".join(f"m_{x}" for x in MEASURES.split(", "))).fields]))
    wide = wide.withColumns({n: F.col(f"m_{n}") for n in _NAMES})
    ok = ~base_failed() & F.concat_ws(",", *rules().values()).isin(good)
    return wide.where(ok).select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def quality_patterns(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Posterior of every vote pattern that occurs in docs."""
    key = F.concat_ws(",", *rules().values()).alias("pattern")
    seen = measures(docs.select(F.lit(0).alias("__zero"), F.col(f"`{text_col}`").alias("__whole")), "__zero", "__whole").groupBy(key).count().collect()
    patterns = np.array([[int(v) for v in r["pattern"].split(",")] for r in seen], int).reshape(-1, len(rules()))
    _, _, post = fit_votes(patterns, np.array([r["count"] for r in seen], float))
    return {r["pattern"]: float(p) for r, p in zip(seen, post)}
