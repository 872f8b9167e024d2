"""LM scoring with a log-frequency Bloom filter.

Counts are quantised on a logarithmic scale, q = 1 + floor(log_1.5 c), and an n-gram of level q enters
the filter as the q items (n-gram, 1) ... (n-gram, q). Probing level after level until one is missing gives
the level back: never too low, and one too high only as often as the filter errs. The filter holds
all tokens, all bigrams and, for each token, the number of its distinct followers: nothing is left out, and its size follows
their number. It comes in groups, to which a key belongs by its hash; a group has as many bits as its own items need.

The keys of bigrams go to their groups as they are counted: each task merges its own, and sends every group one sorted run of
keys, so that the task of a group adds them up and fills its bits at once.

As the filter grows with the training texts, no bound for a broadcast holds: a group is sent to one task instead, the distinct keys of each run of
documents go to their groups by a shuffle, and their levels come back by another. No key is hot: a run sends a key once.
Where the caller knows a bound, a filter of up to `broadcast_bits` is broadcast whole. Both ways give the same scores.

A bigram's key has 32 bits of the first token's hash above 32 bits of the pair's, so the followers of a token
are counted from the keys; two tokens that agree in those 32 bits have their followers counted together.

The model interpolates bigram and token by Witten-Bell:
P(w | v) = g(v) * c(v, w) / c(v) + (1 - g(v)) * (c(w) + 1) / (N + V + 1), g(v) = c(v) / (c(v) + T(v)),
where T(v) counts the distinct followers of v, g = 0 for a v without any, and all of c(v), T(v), c(w), c(v, w) are read from
the filter. A text is preceded by an end token, as if another text had just ended.

The base score needs exact counts. Those of the most frequent tokens come as a table of
bounded size; the other tokens of each document are joined with the counts, a join without hot keys, as each
of its tokens is rare in the training texts (those that they lack are scored without it).

Defined results: a null or empty text is one end token; a null id counts as the empty text when
held-out documents are picked; repeated rows are scored (and counted) each by itself; an empty
table gives an empty result; columns other than the two named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ask_groups, chunks, drop, mix64, prefix_hash, schema_of, ship, span_hash, table, text_buffers

END = np.uint64(0x5BD1E9955BD1E995)
_LOW = np.uint64(0xFFFFFFFF)
BASE = 1.5
PROBES = 5
BITS_PER_ITEM = 8
#: Tokens of the training texts for each group of the filter: bounds what the task of a group holds.
GROUP_TOKENS = 1 << 21
#: Items whose bits are looked up together.
PROBE_ITEMS = 1 << 17
#: Bytes of text of a run of documents that asks the groups together.
RUN_BYTES = 4 << 20
#: Bytes of a text above which its tokens are hashed in several runs.
LONG_BYTES = 1 << 20
#: Bytes from which a token has a hash of its own kind: in polynomials modulo 2**64, some words of 2048 bytes collide by construction.
LONG_TOKEN = 512
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def level(count: np.ndarray) -> np.ndarray:
    """1 + floor(log_1.5 count) for counts of 1 and more."""
    return (1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9)).astype(np.int64)


_LEAST = np.array([0] + [int(np.ceil(BASE ** (q - 1) - 1e-6)) for q in range(1, 120)], float)
#: The middle of the counts that have a level.
MIDDLE = np.array([0.0] + [(_LEAST[q] + max(_LEAST[q], _LEAST[q + 1] - 1)) / 2 for q in range(1, 119)])


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the tokens of each row, with the end token last; some megabyte of text is looked at at once."""
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in chunks(offsets):
        text, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j > i + 1 or len(text) <= LONG_BYTES:
            h, ends = _tokens(text, own)
            hashes.append(h)
            sizes.append(np.diff(ends))
            continue
        at, before, spaces = 0, len(hashes), np.flatnonzero(_SPACE[text])
        while at < len(text):  # a long text, cut at white space
            k = np.searchsorted(spaces, at + LONG_BYTES)
            stop = int(spaces[k]) if k < len(spaces) else len(text)
            hashes.append(_tokens(text[at:stop], np.array([0, stop - at]))[0][:-1])
            at = stop
        hashes.append(np.array([END]))
        sizes.append(np.array([sum(map(len, hashes[before:]))]))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    low = _LOWER[data]
    space = _SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    h = mix64(span_hash(prefix_hash(low), start, end) ^ ((end - start).astype(np.uint64) << np.uint64(40)))
    for k in np.flatnonzero(end - start >= LONG_TOKEN):
        h[k] = xxhash.xxh3_64_intdigest(low[start[k] : end[k]].tobytes())
    h[h == END] = np.uint64(1)
    row = np.searchsorted(offsets, start, side="right") - 1
    out = np.full(len(h) + n, END)
    out[np.arange(len(h)) + row] = h
    return out, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n) + 1)]).astype(np.int64)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Key of a bigram of token hashes; its upper half is that of the first token's hash."""
    return (first & ~_LOW) | (mix64(mix64(first + np.uint64(0x9E3779B97F4A7C15)) + second) & _LOW)


def follow_key(half: np.ndarray) -> np.ndarray:
    """Key of the number of followers of a token, of whose hash `half` is the upper half."""
    return mix64(half + np.uint64(0xC2B2AE3D27D4EB4F))


def item_of(key: np.ndarray) -> np.ndarray:
    """What the filter knows a key by: 48 bits of its hash."""
    return mix64(key ^ np.uint64(0xA5A5A5A5)) >> np.uint64(16)


def group_of(item: np.ndarray, groups: int) -> np.ndarray:
    """Groups are ranges of items."""
    return (((item >> np.uint64(16)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)


def _bits(item: np.ndarray, at: int, size: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the bits of (item, at) in a group of `size` bits."""
    a = mix64(item + np.uint64((at * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))
    b = mix64(a) | np.uint64(1)
    for _ in range(PROBES):
        yield ((a >> np.uint64(32)) * size) >> np.uint64(32)
        a = a + b


def fill(item: np.ndarray, levels: np.ndarray) -> bytes:
    """The bits of one group."""
    size = -(-max(64, int(levels.sum()) * BITS_PER_ITEM) // 8) * 8
    bits, at = np.zeros(size, bool), 1
    while len(item):
        for p in _bits(item, at, np.uint64(size)):
            bits[p.astype(np.int64)] = True
        at += 1
        some = levels >= at
        item, levels = item[some], levels[some]
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Groups of a filter, one after the other; one that isn't given holds nothing."""

    def __init__(self, groups: int, blobs: dict[int, bytes]):
        none = bytes(8)
        self.groups = groups
        self.data = np.frombuffer(b"".join(blobs.get(g, none) for g in range(groups)), np.uint8)
        self.sizes = np.array([len(blobs.get(g, none)) * 8 for g in range(groups)], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.uint64)

    def levels(self, item: np.ndarray) -> np.ndarray:
        """Level of each item, by probing until one is missing."""
        return _probe(self.data, item, self.starts[g := group_of(item, self.groups)], self.sizes[g])


def _probe(data: np.ndarray, item: np.ndarray, start, size) -> np.ndarray:
    """Levels of items in groups of `size` bits from bit `start` on, each an array or one for all; some at a time."""
    out = np.zeros(len(item), np.uint8)
    of = lambda x, at: x[at] if np.ndim(x) else x
    for i in range(0, len(item), PROBE_ITEMS):
        some = slice(i, i + PROBE_ITEMS)
        open_, x, first, width, at = np.arange(i, min(i + PROBE_ITEMS, len(item))), item[some], of(start, some), of(size, some), 1
        while len(open_) and at < len(MIDDLE):
            alive = np.ones(len(open_), np.uint8)
            for p in _bits(x, at, width):
                p += first
                alive &= data[(p >> np.uint64(3)).view(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)
            alive = np.flatnonzero(alive & 1)
            open_, x, first, width = open_[alive], x[alive], of(first, alive), of(width, alive)
            out[open_] = at
            at += 1
    return out


def _planes(a: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, all lowest bytes first: sorted values then compress well."""
    return a.view(np.uint8).reshape(len(a), a.itemsize)[:, :width].T.tobytes()


def _unplanes(blob: bytes, width: int, kind=np.uint64) -> np.ndarray:
    n = len(blob) // width
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(kind)


def _held_out(doc: str):
    return F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Chunk:
    """The tokens of some texts, and what their scores need from the filter: `single` for each token, `follow` for its followers, `both` for bigrams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        h, self.offsets = token_hashes(data, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.offsets))
        self.kinds, self.inverse = np.unique(h, return_inverse=True)
        self.before = before(self.inverse, self.offsets, np.searchsorted(self.kinds, END))
        self.both, self.back = np.unique(item_of(pair_key(self.kinds[self.before], h)), return_inverse=True)

    def scores(self, single: np.ndarray, follow: np.ndarray, both: np.ndarray, space: float) -> np.ndarray:
        """log10 of each text's probability, given the levels."""
        count, follow = MIDDLE[single], MIDDLE[follow]
        trust = np.where((count > 0) & (follow > 0), count / np.maximum(count + follow, 1), 0.0)[self.before]
        after = np.minimum(MIDDLE[both][self.back] / np.maximum(count[self.before], 1), 1.0)
        p = ((count + 1) / space)[self.inverse]
        return np.bincount(self.row, np.log10(trust * after + (1 - trust) * p), len(self.offsets) - 1)


def half_of(kind: np.ndarray) -> np.ndarray:
    """The half of a token's hash by which its followers are counted."""
    return kind >> np.uint64(32)


def token_items(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items of tokens and of their numbers of followers."""
    return item_of(kind), item_of(follow_key(half_of(kind)))


def before(h: np.ndarray, offsets: np.ndarray, end) -> np.ndarray:
    """Each token's predecessor; `end` for the first of a text."""
    out = np.concatenate([h[:1], h[:-1]])
    out[offsets[:-1]] = end
    return out


def _counted(df: DataFrame, keys, spec: str = "key long, n long", most: int = 1_500_000) -> DataFrame:
    """Rows (key, n) of a map with counts merged within each task; keys(data, offsets) gives uint64 keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, floor = 0, 0

        def rows(k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(k), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 17)].view(np.int64)), pa.array(n[i : i + (1 << 17)])], names=["key", "n"])

        for b in batches:
            data, offsets = text_buffers(b.column(0))
            for i, j in chunks(offsets):
                found = keys(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                k, n = np.unique(found, return_counts=True)
                held.append((k, n))
                size += len(k)
                if size > floor + 500_000:
                    held = [_merged(held)]
                    size = floor = len(held[0][0])
                    if size > most:
                        yield from rows(*held[0])
                        held, size, floor = [], 0, 0
        if held:
            yield from rows(*_merged(held))

    return df.select(F.col("t")).mapInArrow(run, spec)


def _new(k: np.ndarray) -> np.ndarray:
    """Where sorted values differ from the one before."""
    out = np.ones(len(k), bool)
    out[1:] = k[1:] != k[:-1]
    return out


def _distinct(k: np.ndarray) -> np.ndarray:
    """np.unique by a sort: without counts it hashes, which takes many times longer where most values differ."""
    k = np.sort(k)
    return k[_new(k)]


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(_new(k))
    return k[first], np.add.reduceat(n[order].astype(np.int64), first) if len(k) else np.zeros(0, np.int64)


def _runs(df: DataFrame, groups: int, most: int = 1_000_000) -> DataFrame:
    """(grp, keys, counts): the bigrams of each task, counted, as a sorted run for each group."""

    def rows(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        k, n = _merged(held)
        home = group_of(item_of(k), groups)
        order = np.argsort(home, kind="stable")
        k, n, home = k[order], n[order].astype(np.uint64), home[order]
        cuts = np.flatnonzero(np.diff(home, prepend=-1, append=-1))
        for i in range(0, len(cuts) - 1, 256):
            part = [(cuts[j], cuts[j + 1]) for j in range(i, min(i + 256, len(cuts) - 1))]
            yield pa.RecordBatch.from_arrays([pa.array([home[x] for x, _ in part], pa.int32()), pa.array([_planes(k[x:y], 8) for x, y in part], pa.binary()), pa.array([_planes(n[x:y], 8) for x, y in part], pa.binary())], names=["grp", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, floor = [], 0, 0
        for b in batches:
            data, offsets = text_buffers(b.column(0))
            for i, j in chunks(offsets):
                h, off = token_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append(np.unique(pair_key(before(h, off, END), h), return_counts=True))
                size += len(held[-1][0])
                if size > floor + 500_000:
                    held = [_merged(held)]
                    size = floor = len(held[0][0])
                    if size > most:
                        yield from rows(held)
                        held, size, floor = [], 0, 0
        yield from rows(held)

    return df.select("t").mapInArrow(run, "grp int, keys binary, counts binary")


def _filled(runs: DataFrame) -> DataFrame:
    """Of each group its bits (grp, blob), and of its bigrams' first tokens (half, n) with the number of distinct followers."""

    def made(grp: int, held: list) -> Iterator[pa.RecordBatch]:
        k, n = _merged(held)
        yield pa.RecordBatch.from_arrays([pa.array([grp], pa.int32()), pa.array([fill(item_of(k), level(n))], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=["grp", "blob", "half", "n"])
        half, n = np.unique(half_of(k), return_counts=True)
        for i in range(0, len(half), 1 << 17):
            x, y = half[i : i + (1 << 17)].view(np.int64), n[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.binary()), pa.array(x), pa.array(y)], names=["grp", "blob", "half", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, floor = None, [], 0, 0
        for b in batches:
            for i in range(b.num_rows):
                grp = b.column(0)[i].as_py()
                if grp != now:
                    if held:
                        yield from made(now, held)
                    now, held, size, floor = grp, [], 0, 0
                held.append((_unplanes(b.column(1)[i].as_py(), 8), _unplanes(b.column(2)[i].as_py(), 8)))
                size += len(held[-1][0])
                if size > floor + 2_000_000:
                    held = [_merged(held)]
                    size = floor = len(held[0][0])
        if held:
            yield from made(now, held)

    return runs.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "grp int, blob binary, half long, n long")


def _token_filter(single: DataFrame, follow: DataFrame, groups: int) -> DataFrame:
    """(grp, blob): the tokens and the numbers of their followers, a token and its followers in one group."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, follows = b.column(0).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)
            half = np.where(follows, key, half_of(key))
            yield pa.RecordBatch.from_arrays([pa.array(group_of(item_of(half), groups).astype(np.int32)), pa.array(item_of(np.where(follows, follow_key(key), key)).view(np.int64)), b.column(1)], names=["grp", "item", "level"])

    def build(group):
        import pandas as pd

        return pd.DataFrame({"grp": group["grp"].iloc[:1], "blob": [fill(group["item"].to_numpy().view(np.uint64), group["level"].to_numpy().astype(np.int64))]})

    entries = single.select("key", "level", F.lit(False).alias("follows")).union(follow.select("half", "level", F.lit(True)))
    return entries.mapInArrow(keyed, "grp int, item long, level int").groupBy("grp").applyInPandas(build, "grp int, blob binary")


class TokenFilter(Filter):
    def both_levels(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels of the counts of tokens and of their numbers of followers."""
        single, follow = token_items(kinds)
        g = group_of(item_of(half_of(kinds)), self.groups)
        return tuple(_probe(self.data, x, self.starts[g], self.sizes[g]) for x in (single, follow))


def _cut(histogram: list, most: int) -> int:
    """Least count to keep, given rows (level, items, keys), so that no more than `most` items stay."""
    total = 0
    for r in sorted(histogram, key=lambda r: -r["level"]):
        total += r["items"]
        if total > most:
            return r["level"] + 1
    return 1


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: int = 1 << 20, broadcast_bits: int = 0, group_tokens: int = GROUP_TOKENS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    `exact` bounds the table of exact counts; a filter of up to `broadcast_bits` is broadcast instead of being probed group by group.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    train = docs.where(~_held_out("id"))
    level_of = (F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(BASE))) + F.lit(1e-9)) + 1).cast("int")

    single = table(_counted(train, lambda data, offsets: token_hashes(data, offsets)[0]).groupBy("key").agg(F.sum("n").alias("n")).withColumn("level", level_of), "token-counts")
    by_level = single.groupBy("level").agg(F.count("*").alias("keys"), F.sum("n").alias("tokens")).collect()  # a row for each level
    total, kinds = sum(r["tokens"] for r in by_level), sum(r["keys"] for r in by_level)
    drop(spark)

    least = _cut([{"level": r["level"], "items": r["keys"]} for r in by_level], exact)
    got = single.where(F.col("level") >= least).select("key", "n").toArrow().combine_chunks()  # at most `exact` rows
    known_key = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(known_key)
    known_key, known_n = known_key[order], got["n"].to_numpy()[order]

    groups = homes = max(1, -(-total // group_tokens))  # what a group is asked then stays the same as texts grow
    filled = table(_filled(_runs(train, groups)), "bigram-filter")
    drop(spark)
    follow = filled.where("half is not null").groupBy("half").agg(F.sum("n").alias("n")).select("half", level_of.alias("level"))
    tokens = table(_token_filter(single, follow, homes), "token-filter")
    drop(spark)
    pairs = filled.where("grp is not null").select("grp", "blob")
    known = spark.sparkContext.broadcast((known_key, known_n))
    space = float(total + kinds + 1)

    def row(c: Chunk, levels: tuple, rid: pa.Array, ids: pa.Array, held: pa.Array) -> pa.RecordBatch:
        known_key, known_n = known.value
        n, kinds_, inverse = len(rid), c.kinds, c.inverse
        at = np.minimum(np.searchsorted(known_key, kinds_), max(0, len(known_key) - 1))
        hit = known_key[at] == kinds_ if len(known_key) else np.zeros(len(kinds_), bool)
        exact_n = np.where(hit, known_n[at] if len(known_key) else 0, 0)
        base = np.bincount(c.row, np.log10((exact_n + 1) / space)[inverse], n)
        sure = np.bincount(c.row, hit[inverse], n).astype(np.int64)
        # the tokens whose exact count is not at hand, so far taken for unseen: distinct ones of each row with their number
        rare = np.flatnonzero(~hit[inverse])
        pair, times = np.unique(c.row[rare] * len(kinds_) + inverse[rare], return_counts=True)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(pair // max(1, len(kinds_)), minlength=n))]).astype(np.int32)
        rares = kinds_[pair % max(1, len(kinds_))].view(np.int64)
        return pa.RecordBatch.from_arrays([
            rid, ids, held, pa.array(np.diff(c.offsets)), pa.array(sure), pa.array(base), pa.array(c.scores(*levels, space)),
            pa.ListArray.from_arrays(pa.array(cuts), pa.array(rares)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int64))),
        ], names=["rid", "id", "held_out", "n_tokens", "sure", "base", "score", "rare", "times"])

    picked = docs.withColumn("held_out", _held_out("id"))
    kind = type(picked.schema)
    schema = kind([*schema_of("rid long").fields, picked.schema["id"], *schema_of("held_out boolean, n_tokens long, sure long, base double, score double, rare array<long>, times array<long>").fields])
    if broadcast_bits and pairs.union(tokens).agg(F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("b")).first()["b"] * 8 <= broadcast_bits:
        loaded = lambda made, n, blobs: made(n, {r["grp"]: bytes(r["blob"]) for r in blobs.collect()})
        sent = spark.sparkContext.broadcast((loaded(TokenFilter, homes, tokens), loaded(Filter, groups, pairs)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rid = TaskContext.get().partitionId() << 40
            for b in batches:
                data, offsets = text_buffers(b.column(1))
                for i, j in chunks(offsets):
                    c = Chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    levels = (*sent.value[0].both_levels(c.kinds), sent.value[1].levels(c.both))
                    yield row(c, levels, pa.array(rid + np.arange(j - i)), b.column(0).slice(i, j - i), b.column(2).slice(i, j - i))
                    rid += j - i

        scored = table(picked.mapInArrow(run, schema), "scored")
    else:
        scored = _by_groups(picked, tokens, homes, pairs, groups, row, schema, run_bytes)
    drop(spark, filled, tokens)
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    joined = rare.join(single.where(F.col("level") < least).select("key", "n"), "key")
    more = joined.groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("found"))
    out = scored.drop("rare", "times").join(more, "rid", "left")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("sure") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def _by_groups(picked: DataFrame, tokens: DataFrame, homes: int, pairs: DataFrame, groups: int, row, schema, run_bytes: int) -> DataFrame:
    """Levels group by group. Groups of bigrams are numbered from 0, those of tokens after them."""

    def by_home(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        home = group_of(item_of(half_of(kinds)), homes)
        order = np.argsort(home, kind="stable")
        return order, home[order]

    def ask(text: pa.Array) -> Iterator[tuple[int, bytes]]:
        h, offsets = token_hashes(*text_buffers(text))
        kinds, both = _distinct(h), _distinct(item_of(pair_key(before(h, offsets, END), h)))
        order, home = by_home(kinds)
        for at, keys, first, width in ((group_of(both, groups), both, 0, 6), (home, kinds[order], groups, 8)):  # groups are ranges of items: bigrams lie by group
            cuts = np.flatnonzero(np.diff(at, prepend=-1, append=-1)).tolist()
            for x, y, g in zip(cuts, cuts[1:], at[cuts[:-1]].tolist()):
                yield first + g, _planes(keys[x:y], width)

    def answer(grp: int, bits: bytes | None, asked: list[bytes]) -> list[bytes]:
        data, width = np.frombuffer(bits or bytes(8), np.uint8), 6 if grp < groups else 8
        keys = np.concatenate([_unplanes(x, width) for x in asked])
        probe = lambda x: _probe(data, x, np.uint64(0), np.uint64(len(data) * 8))
        out = probe(keys) if grp < groups else np.stack([probe(x) for x in token_items(keys)], axis=1)
        cuts = np.cumsum([0, *(len(x) // width for x in asked)]).tolist()
        return [out[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]

    def finish(rid: pa.Array, part: list[pa.Array], found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        ids, text, held = part
        c = Chunk(*text_buffers(text))
        both = np.frombuffer(b"".join(x for g, x in found if g < groups), np.uint8)  # answers come by group, as the keys were asked
        tokens = np.zeros((2, len(c.kinds)), np.uint8)
        tokens[:, by_home(c.kinds)[0]] = np.frombuffer(b"".join(x for g, x in found if g >= groups), np.uint8).reshape(-1, 2).T
        return row(c, (*tokens, both), rid, ids, held)

    bits = pairs.union(tokens.select((F.col("grp") + groups).alias("grp"), "blob"))
    return ask_groups(picked, 1, bits, ask, answer, finish, schema, run_bytes)
