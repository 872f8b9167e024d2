"""Line dedup with a sharded minimal perfect hash.

1. Every document yields the 128-bit hashes of its distinct line keys, counted first within the task
   and then by one hash aggregation, so a line in every document costs one row per task.
2. Hashes found in `min_docs` documents or more become an index: split into shards by hash, each
   shard a minimal perfect hash (levels of bit arrays with rank) over its hashes, and beside it an
   array of 64-bit fingerprints and one of counts, without the keys.
3. Documents probe the arrays: a line is in the index if its fingerprint stands where its hash points.

Rarer lines are never dropped, so the index has no entry for them: a probe that finds no fingerprint says so.

The index is broadcast only if its measured size is within `broadcast_bytes`. Beyond that, a run of documents sends the
distinct hashes of its lines to the tasks that hold their shards, which probe the same arrays and send the verdicts back.

Counts may be taken over groups of documents instead (`line_counts` with a `group_col`): where each group of copies counts once, a
line that stands only in copies of one document is not frequent.

Defined results: a null or empty text is one empty line, which has no key of one code point and stays;
repeated rows each count as a document; an empty table gives an empty result; columns other than the
two named ones are not looked at. If every line is dropped the kept text is empty.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ask_groups, mix64, schema_of, ship, slices, table

_LEVELS = 40
_GAMMA = 1.7


def key_of(line: bytes) -> bytes:
    """Stripped of ASCII white space, A-Z in lower case."""
    return line.strip(WHITE).lower()


def _hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


class PerfectHash:
    """Minimal perfect hash over distinct uint64 keys: about 4 bits a key, all lookups vectorised."""

    def __init__(self, keys: np.ndarray):
        self.words, self.sizes, left = [], [], keys
        for level in range(_LEVELS):
            if not len(left):
                break
            size = max(64, int(len(left) * _GAMMA) // 64 * 64 + 64)
            at = self._place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            self.words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            self.sizes.append(size)
            left = left[~alone[at]]
        self.rest = np.sort(left)  # practically always empty
        self._rank()

    def _rank(self) -> None:
        flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        self.flat = flat
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(flat), dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum([s // 64 for s in self.sizes], dtype=np.int64)]).astype(np.int64)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return int(self.before[-1]) + len(self.rest)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; some slot or -1 for a key that was not built in."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self._place(keys[open_], level, size)
            word, bit = self.starts[level] + (at >> 6), (at & 63).astype(np.uint64)
            w = self.flat[word]
            hit = (w >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(w[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.before[word[hit]] + below
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            k = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[k] == keys[open_]
            out[open_[same]] = self.before[-1] + k[same]
        return out


class Shard:
    """A perfect hash with a fingerprint and a count in each slot."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.hash = PerfectHash(keys)
        slot = self.hash.index(keys)
        self.prints, self.counts = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint32)
        self.prints[slot] = prints
        self.counts[slot] = np.minimum(counts, 0xFFFFFFFF)

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for one that isn't in the shard."""
        slot = self.hash.index(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == prints[ok]
        out = np.zeros(len(keys), np.int64)
        out[ok] = self.counts[slot[ok]]
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=np.array(self.hash.sizes, np.int64), flat=self.hash.flat, rest=self.hash.rest, prints=self.prints, counts=self.counts)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Shard:
        z = np.load(io.BytesIO(blob))
        new = object.__new__(cls)
        new.hash = object.__new__(PerfectHash)
        new.hash.sizes, new.hash.words, new.hash.rest = z["sizes"].tolist(), [z["flat"]], z["rest"]
        new.hash._rank()
        new.prints, new.counts = z["prints"], z["counts"]
        return new


class LineIndex:
    """Shards by the top bits of the first hash."""

    def __init__(self, bits: int, shards: dict[int, Shard]):
        self.bits, self.shards = bits, shards

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        home = _home(keys, self.bits)
        for s in np.unique(home):
            if s in self.shards:
                at = np.flatnonzero(home == s)
                out[at] = self.shards[s].count(keys[at], prints[at])
        return out


def line_counts(df: DataFrame, text_col: str = "text", min_chars: int = 1, flush: int = 200_000, group_col: str | None = None, group_of: Callable[[list], np.ndarray] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(h1, h2, n): 128-bit hash of each line key and the number of documents that hold it.

    With a `group_col` (of longs), the number of different values of it among them, each null being one of its own; `group_of`
    gives such values (uint64) for texts instead, and `groups` (g, root) puts values together further.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}

        def rows() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k, _ in seen), ">u8").reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([pa.array(h[:, 0].astype(np.uint64).view(np.int64)), pa.array(h[:, 1].astype(np.uint64).view(np.int64)), pa.array([g for _, g in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["h1", "h2", "g", "n"])
            seen.clear()
            return out

        held = 0
        for b in slices(batches, 256):
            texts = b.column(0).to_pylist()
            for text, g in zip(texts, b.column(1).to_pylist() if group_of is None else group_of(texts).view(np.int64).tolist()):
                for k in {key_of(x) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")}:
                    if len(k) >= min_chars and (min_chars <= 1 or len(k.decode("utf-8", "surrogatepass")) >= min_chars):
                        if (k, g) not in seen:
                            held += len(k)
                        seen[k, g] = seen.get((k, g), 0) + 1
                if len(seen) >= flush or held > 1 << 26:
                    yield rows()
                    held = 0
        if seen:
            yield rows()

    group = F.lit(None) if group_col is None else F.col(f"`{group_col}`")
    found = df.select(F.col(f"`{text_col}`").cast("string"), group.cast("long").alias("g")).mapInArrow(run, "h1 long, h2 long, g long, n long")
    if group_col is None and group_of is None:
        return found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    once = found.groupBy("h1", "h2", "g").agg(F.sum("n").alias("n"))
    if groups is not None:
        once = once.join(groups, "g", "left").groupBy("h1", "h2", F.coalesce("root", "g").alias("g")).agg(F.sum("n").alias("n"))
    return once.groupBy("h1", "h2").agg(F.sum(F.when(F.col("g").isNull(), F.col("n")).otherwise(1)).alias("n"))


def build_index(frequent: DataFrame, keys_per_shard: int = 1 << 16) -> tuple[DataFrame, int]:
    """The shards over a table of distinct (h1, h2, n), each built in a task of its own, and their bits."""
    n, bits = frequent.count(), 0
    while n > keys_per_shard << bits:
        bits += 1

    def build(group):
        import pandas as pd

        keys = group["h1"].to_numpy().view(np.uint64)
        return pd.DataFrame({"shard": group["shard"].iloc[:1].astype("int64"), "blob": [Shard(keys, group["h2"].to_numpy().view(np.uint64), group["n"].to_numpy()).dump()]})

    home = F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0).cast("long")
    return frequent.withColumn("shard", home).groupBy("shard").applyInPandas(build, "shard long, blob binary"), bits


def _key_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(key_of(x)) for x in lines), ">u8").reshape(-1, 2)
    return h[:, 0].astype(np.uint64), h[:, 1].astype(np.uint64)


def _home(keys: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each key."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def line_dedup(df: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, counts: DataFrame | None = None, broadcast_bytes: int = 64 << 20, keys_per_shard: int = 1 << 16, run_bytes: int = 4 << 20) -> DataFrame:
    """df with its text replaced by the lines that stay, and with n_lines and n_dropped (both long).

    A line goes if its key has `min_chars` code points and stands in `min_docs` documents, or has that count in `counts`
    (of `line_counts`). The two counts come under the names `__n_lines` and `__n_dropped`.
    """
    spark = df.sparkSession
    frequent = table((line_counts(df, text_col, min_chars) if counts is None else counts).where(F.col("n") >= min_docs), "lines")
    shards, bits = build_index(frequent, keys_per_shard)
    shards = table(shards, "line-index")
    size = shards.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("b")).first()["b"]
    columns, at = df.columns, df.columns.index(text_col)
    plain = df.select(*(F.col(f"`{c}`").cast("string") if k == at else F.col(f"`{c}`") for k, c in enumerate(columns))).toDF(*(f"c{k}" for k in range(len(columns))))
    made = _rows(at)
    schema = type(plain.schema)([*plain.schema.fields, *schema_of("__n_lines long, __n_dropped long").fields])
    if size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast([(r["shard"], bytes(r["blob"])) for r in shards.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = LineIndex(bits, {s: Shard.load(b) for s, b in sent.value})
            for b in slices(batches):
                lines = _lines(b.column(at))
                flat = [x for ls in lines for x in ls]
                yield made(b.columns, lines, index.count(*_key_hashes(flat)) > 0)

        out = plain.mapInArrow(run, schema)
    else:
        out = _by_shards(plain, at, shards, bits, made, schema, run_bytes)
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)), "__n_lines", "__n_dropped")


def _lines(texts: pa.Array) -> list[list[bytes]]:
    return [(t or "").encode("utf-8", "surrogatepass").split(b"\n") for t in texts.to_pylist()]


def _rows(at: int):
    """Documents without the lines that go."""

    def made(columns: list[pa.Array], lines: list[list[bytes]], drop: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum([len(ls) for ls in lines])
        texts, dropped = [], []
        for ls, e in zip(lines, ends):
            d = drop[e - len(ls) : e]
            texts.append((b"\n".join(x for x, gone in zip(ls, d) if not gone) if d.any() else b"\n".join(ls)).decode("utf-8", "surrogatepass"))
            dropped.append(int(d.sum()))
        arrays = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([len(ls) for ls in lines], pa.int64()), pa.array(dropped, pa.int64())], names=[*(f"c{k}" for k in range(len(columns))), "__n_lines", "__n_dropped"])

    return made


def _by_shards(plain: DataFrame, at: int, shards: DataFrame, bits: int, made, schema, run_bytes: int) -> DataFrame:
    """The way for an index that is too large to broadcast: the distinct line hashes of a run of documents go to the task of their shard, which probes its arrays."""

    def distinct(texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """(lines, which hash each has, distinct hashes in order, the shard of each)."""
        lines = _lines(texts)
        h = np.stack(_key_hashes([x for ls in lines for x in ls]), axis=1)
        kinds, inverse = np.unique(h, axis=0, return_inverse=True)
        return lines, inverse.reshape(-1), kinds, _home(np.ascontiguousarray(kinds[:, 0]), bits)

    def ask(texts: pa.Array) -> Iterator[tuple[int, bytes]]:
        _, _, kinds, home = distinct(texts)
        cuts = np.flatnonzero(np.diff(home, prepend=-1, append=-1)).tolist()
        for x, y in zip(cuts, cuts[1:]):
            yield int(home[x]), kinds[x:y].tobytes()

    held: dict = {}

    def answer(grp: int, blob: bytes | None, asked: list[bytes]) -> list[bytes]:
        if blob is None:
            return [bytes(len(x) // 16) for x in asked]
        if held.get("grp") != grp:
            held.update(grp=grp, shard=Shard.load(blob))
        h = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in asked]
        return [(held["shard"].count(np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1])) > 0).tobytes() for x in h]

    def finish(rid: pa.Array, columns: list[pa.Array], found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        lines, inverse, kinds, home = distinct(columns[at])
        drop = np.zeros(len(kinds), bool)
        for g, blob in found:
            drop[home == g] = np.frombuffer(blob, bool)
        return made(columns, lines, drop[inverse])

    return ask_groups(plain, at, shards.select(F.col("shard").alias("grp"), "blob"), ask, answer, finish, schema, run_bytes)
