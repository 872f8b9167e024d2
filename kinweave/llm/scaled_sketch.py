"""Document fingerprints: a threshold-scaled sketch.

Of all shingle hashes of a document (48 bits, over windows of `width` bytes of its UTF-8 text) those below
a fixed fraction 1 / `scale` of the hash space are kept. Sketches of any two documents are
samples by the same rule, so their union is the sketch of the union, and the share of the smaller sketch
found in the other estimates containment however unequal the documents are.

A text shorter than `width` is one shingle. Where fewer than `LEAST` hashes lie below the threshold, the
`LEAST` smallest are kept (marked "~", or "=" if those are all there are), so short texts stay comparable:
two sketches are compared below the largest hash up to which both are complete. Likeness is 0.0 if one of them has no
hash there.

Ids are integers. Defined results: null counts as the empty text, whose sketch is "=" (two empty sketches are alike, 1.0;
an empty one and another 0.0); repeated rows get equal fingerprints; rows with one id follow each
other in the descending order of their texts' hashes, and are numbered first, by ranges of id and hash, so that an id that many rows
share is no hot key; a null id comes last; an empty table gives an empty result; columns other than the named ones are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, numbered, prefix_hash, ship, span_hash, table, text_buffers

WIDTH = 20
SCALE = 16
LEAST = 64
_BITS = 48
#: Bytes of a document above which its shingles are hashed in several runs.
LONG_BYTES = 1 << 20
#: How far a sketch is complete: up to the threshold, up to its own largest hash, everywhere.
BELOW, SMALLEST, ALL = range(3)


def _cut(kept: np.ndarray, smallest: np.ndarray) -> tuple[np.ndarray, int]:
    """The sketch of a document from its distinct hashes below the threshold, and its `LEAST` + 1 smallest."""
    if len(kept) >= LEAST:
        return kept, BELOW
    return smallest[:LEAST], ALL if len(smallest) <= LEAST else SMALLEST


def _long(raw: np.ndarray, width: int, limit: np.uint64) -> tuple[np.ndarray, int]:
    """The sketch of one long document, in runs of windows."""
    kept, smallest = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for p in range(0, len(raw) - width + 1, LONG_BYTES):
        part = raw[p : p + LONG_BYTES + width - 1]
        prefix = prefix_hash(part)
        start = np.arange(len(part) - width + 1)
        h = mix64(span_hash(prefix, start, start + width)) >> np.uint64(64 - _BITS)
        kept = np.union1d(kept, h[h < limit])
        if len(kept) < LEAST:
            smallest = np.union1d(smallest, h)[: LEAST + 1]
    return _cut(kept, smallest)


def sketches(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, mark): sorted distinct hashes of each row, and how far they are complete."""
    n = len(offsets) - 1
    values, rows, mark = [], [], np.zeros(n, np.int64)
    limit = np.uint64((1 << _BITS) // scale)

    def distinct(v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((v, r))
        v, r = v[order], r[order]
        first = np.ones(len(v), bool)
        first[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        return v[first], r[first]

    for i, j in chunks(offsets):
        if j == i + 1 and offsets[j] - offsets[i] > LONG_BYTES:
            kept, mark[i] = _long(data[offsets[i] : offsets[j]], width, limit)
            values.append(kept)
            rows.append(np.full(len(kept), i))
            continue
        off = offsets[i : j + 1] - offsets[i]
        raw = data[offsets[i] : offsets[j]]
        size = np.diff(off)
        prefix = prefix_hash(raw)
        count = np.where(size >= width, size - width + 1, np.minimum(size, 1))
        row = np.repeat(np.arange(j - i), count)
        start = np.repeat(off[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        h = mix64(span_hash(prefix, start, start + np.minimum(width, size)[row])) >> np.uint64(64 - _BITS)
        low = h < limit
        v, r = distinct(h[low], row[low])
        few = np.bincount(r, minlength=j - i) < LEAST
        if few.any():
            mine = few[row]
            sv, sr = distinct(h[mine], row[mine])
            total = np.bincount(sr, minlength=j - i)
            place = np.arange(len(sv)) - np.repeat(np.cumsum(total) - total, total)
            sv, sr = sv[place < LEAST], sr[place < LEAST]
            mark[i:j] = np.where(few, np.where(total <= LEAST, ALL, SMALLEST), BELOW)
            v, r = np.concatenate([v[~few[r]], sv]), np.concatenate([r[~few[r]], sr])
            order = np.argsort(r, kind="stable")
            v, r = v[order], r[order]
        values.append(v)
        rows.append(r + i)
    v = np.concatenate(values) if values else np.zeros(0, np.uint64)
    r = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return v, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))]), mark


_MARKS = ["", "~", "="]


def strings(values: np.ndarray, offsets: np.ndarray, mark: np.ndarray) -> list[str]:
    """Twelve hex digits for each hash."""
    raw = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()
    return [_MARKS[m] + raw[12 * a : 12 * b] for a, b, m in zip(offsets[:-1].tolist(), offsets[1:].tolist(), mark.tolist())]


def parse(fingerprint: str) -> tuple[np.ndarray, int]:
    mark = max(0, _MARKS.index(fingerprint[:1])) if fingerprint[:1] in _MARKS else BELOW
    hexed = fingerprint[1:] if mark else fingerprint
    return np.array([int(hexed[i : i + 12], 16) for i in range(0, len(hexed), 12)], np.uint64), mark


def _reach(v: np.ndarray, mark: int, limit: int) -> int:
    """The hash below which a sketch is complete."""
    return limit if mark == BELOW else int(v[-1]) + 1 if mark == SMALLEST else 1 << _BITS


def merge(one: str, other: str, scale: int = SCALE) -> str:
    """The sketch of the union of two documents."""
    (a, m), (b, k) = parse(one), parse(other)
    limit = (1 << _BITS) // scale
    reach = min(_reach(a, m, limit), _reach(b, k, limit))
    v = np.union1d(a, b)
    v = v[v < np.uint64(reach)]
    kept = v[v < np.uint64(limit)]
    if reach == limit or len(kept) >= LEAST:
        v, mark = kept, BELOW
    else:
        v, mark = v[:LEAST], ALL if m == k == ALL and len(v) <= LEAST else SMALLEST
    return strings(v, np.array([0, len(v)]), np.array([mark]))[0]


def _alike(x: np.ndarray, m: int, y: np.ndarray, k: int, limit: int) -> float:
    """Share of the smaller of two sketches that the other holds, where both are complete."""
    if len(x) == len(y) and m == k and (x == y).all():
        return 1.0
    reach = np.uint64(min(_reach(x, m, limit), _reach(y, k, limit)))
    x, y = x[: np.searchsorted(x, reach)], y[: np.searchsorted(y, reach)]
    small = min(len(x), len(y))
    return len(np.intersect1d(x, y, assume_unique=True)) / small if small else 0.0


def containment(one: str, other: str, scale: int = SCALE) -> float:
    """Share of the smaller sketch that the other holds, 0 to 1."""
    return _alike(*parse(one), *parse(other), (1 << _BITS) // scale)


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to as many from the start of the next document."""
    h = len(text) // 2
    return text[: len(text) - h] + following[:h]


def _at_most(x: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts are <= x, looking at some 2 * sqrt(len(cuts)) of them."""
    if not cuts:
        return F.lit(0)
    size = max(1, int(len(cuts) ** 0.5))
    every, heads = F.lit(np.array(cuts, float)), F.lit(np.array(cuts[::size], float))
    count = lambda array: F.size(F.filter(array, lambda c: c <= x))
    k = count(heads)
    return F.when(k == 0, 0).otherwise((k - 1) * size + count(F.slice(every, F.greatest(k - 1, F.lit(0)) * size + 1, size)))


def in_order(df: DataFrame, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """(b, ghost, id, t): rows in ranges b of descending id; each range ends with its follower as a ghost.

    Ranges are cut at quantiles of the ids. The driver sees one id for each range; only the texts of
    the ranges' first rows are copied.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    cuts = sorted(set(rows.approxQuantile("id", [k / partitions for k in range(1, partitions)], 0.2 / partitions))) if partitions > 1 else []
    # range 0 holds the largest ids; null ids sort last, in the last range
    place = F.when(F.col("id").isNull(), len(cuts) + 1).otherwise(len(cuts) - _at_most(F.col("id").cast("double"), cuts))
    placed = rows.withColumn("b", place.cast("int"))
    first = sorted((r["b"], r["top"]) for r in placed.groupBy("b").agg(F.max("id").alias("top")).collect())
    if not first:
        return placed.select("b", F.lit(0).alias("ghost"), "id", "t")
    before = {top: first[k - 1][0] for k, (_, top) in enumerate(first)}
    to = spark.createDataFrame(list(before.items()), "id long, b int")
    ghosts = placed.drop("b").join(F.broadcast(to), placed["id"].eqNullSafe(to["id"])).select(to["b"], F.lit(1).alias("ghost"), placed["id"], "t")
    both = placed.select("b", F.lit(0).alias("ghost"), "id", "t").union(ghosts)
    return both.repartitionById(len(cuts) + 2, "b").sortWithinPartitions("b", "ghost", F.col("id").desc_nulls_last(), "t")


def fingerprint_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, scale: int = SCALE, partitions: int | None = None) -> DataFrame:
    """Each document's sketch and that of its edited text, with their likeness and that to the next document."""
    spark = df.sparkSession
    ship(spark)
    ids = df.select(F.col(f"`{id_col}`").cast("long").alias("id"))
    if ids.groupBy("id").count().where("count > 1").isEmpty():
        return _fingerprints(df, id_col, text_col, width, scale, partitions).withColumnRenamed("id", id_col)
    rows = table(numbered(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t")), "id", "t"), "numbered")
    out = _fingerprints(rows, "place", "t", width, scale, partitions).withColumnRenamed("id", "place")
    return rows.select("place", F.col("id").alias(id_col)).join(out, "place").drop("place")


def _fingerprints(df: DataFrame, id_col: str, text_col: str, width: int, scale: int, partitions: int | None) -> DataFrame:
    """For distinct ids."""
    partitions, limit = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << _BITS) // scale
    ordered = in_order(df, id_col, text_col, partitions)

    def block(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (b, ghost, id, text); each but the last is done, with the one after it as its next."""
        texts = [r[3] for r in rows]
        pairs = [k for k in range(len(rows) - 1) if rows[k][1] == 0 and rows[k + 1][0] == rows[k][0]]
        made = [edited(texts[k], texts[k + 1]) for k in pairs]
        v, o, g = sketches(*text_buffers(pa.array(texts, pa.large_string())), width, scale)
        ev, eo, eg = sketches(*text_buffers(pa.array(made, pa.large_string())), width, scale)
        own, others = strings(v, o, g), strings(ev, eo, eg)
        sketch = lambda k: (v[o[k] : o[k + 1]], g[k])
        near = [_alike(*sketch(k), ev[eo[i] : eo[i + 1]], eg[i], limit) for i, k in enumerate(pairs)]
        after = [_alike(*sketch(k), *sketch(k + 1), limit) for k in pairs]
        return pa.RecordBatch.from_arrays([
            pa.array([rows[k][2] for k in pairs], pa.int64()), pa.array([len(texts[k]) for k in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in made], pa.string()),
            pa.array([own[k] for k in pairs], pa.string()), pa.array(others, pa.string()),
            pa.array(near, pa.float64()), pa.array(after, pa.float64()),
        ], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # not yet done, waits for the row after it
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = list(zip(*(c.to_pylist() for c in part.columns)))
                yield block(([last] if last else []) + rows)
                last = rows[-1]

    return ordered.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
