"""Packed binary graph files.

Adjacency: records of a 16-byte id, a little-endian u32 n and n pairs of 16-byte id and f32, one after
the other. Metadata: a header of four u32 offsets, then a name lookup (u32 n; u16 length, UTF-8, u16 k, k ids), entities
(u32 n; id, two u16-length strings) and two indexes (u32 n; id, u64 place).

A graph is a folder of part files. Spark reads them as binary files, in parallel, and decodes all records of a file in whole
arrays. Each part is made by one task and written by Spark itself, so it goes wherever Spark can write and a
retried task leaves no second copy. A part holds a bounded number of edges (but a list is never split); its last byte is a newline, which
readers take for a record that is cut short.
"""

from __future__ import annotations

import mmap
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import ship, table

_PAIR = np.dtype([("id", "V16"), ("sim", "<f4")])
#: Edges that one part file should hold, and those that are decoded at once.
PART_EDGES, BATCH_EDGES = 1_000_000, 1 << 18


def _name(raw: bytes) -> str:
    return str(uuid.UUID(bytes=raw))


def _dashed(x: Column) -> Column:
    return F.concat_ws("-", *(F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _hexed(ids: np.ndarray) -> pa.Array:
    """32 hex digits for each row of an (n, 16) byte array."""
    offsets = np.arange(len(ids) + 1, dtype=np.int32) * 32
    return pa.StringArray.from_buffers(len(ids), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids).tobytes().hex().encode()))


def records(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(offset, number of pairs) of each record; a record that is cut short ends the file."""
    at, starts, sizes = 0, [], []
    read = struct.Struct("<I").unpack_from
    while at + 20 <= len(data):
        (n,) = read(data, at + 16)
        if at + 20 + 20 * n > len(data):
            break
        starts.append(at)
        sizes.append(n)
        at += 20 + 20 * n
    return np.array(starts, np.int64), np.array(sizes, np.int64)


def decode_adjacency(data: bytes) -> Iterator[tuple[str, int, list[tuple[str, float]]]]:
    """(id, offset, pairs) of each record."""
    for at, n in zip(*(x.tolist() for x in records(data))):
        pairs = np.frombuffer(data, _PAIR, n, at + 20)
        yield _name(data[at : at + 16]), at, [(_name(p["id"].tobytes()), float(p["sim"])) for p in pairs]


def encode_record(owner: str, pairs: list[tuple[str, float]]) -> bytes:
    out = np.zeros(len(pairs), _PAIR)
    if pairs:
        out["id"] = np.frombuffer(b"".join(uuid.UUID(i).bytes for i, _ in pairs), "V16")
        out["sim"] = np.array([s for _, s in pairs], np.float32)
    return uuid.UUID(owner).bytes + struct.pack("<I", len(pairs)) + out.tobytes()


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, sim float, pos, file, offset); the offset is that of the owner's record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                raw = content.as_buffer()
                data = np.frombuffer(raw, np.uint8)
                start, size = records(memoryview(raw))
                ends = np.cumsum(size)
                i = 0
                while i < len(start):
                    j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_EDGES, side="right")))
                    at, n = start[i:j], size[i:j]
                    pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    pairs = data[(np.repeat(at, n) + 20 + 20 * pos)[:, None] + np.arange(20)]
                    owners = np.repeat(data[at[:, None] + np.arange(16)], n, axis=0)
                    sims = np.ascontiguousarray(pairs[:, 16:]).view("<f4").reshape(-1)
                    yield pa.RecordBatch.from_arrays([_hexed(owners), _hexed(pairs[:, :16]), pa.array(sims), pa.array(pos.astype(np.int32)), pa.array([name.as_py()] * len(pos), pa.string()), pa.array(np.repeat(at, n))], names=["src", "dst", "sim", "pos", "file", "offset"])
                    i = j

    ship(spark)
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = raw.mapInArrow(run, "src string, dst string, sim float, pos int, file string, offset long")
    return rows.withColumns({"src": _dashed(F.col("src")), "dst": _dashed(F.col("dst"))})


def _bytes16(x: str) -> Column:
    return F.unhex(F.replace(F.col(x), F.lit("-"), F.lit("")))


def write_adjacency(edges: DataFrame, folder: str, files: int | None = None) -> DataFrame:
    """Write edges (src, dst, sim[, pos]) as part files under a folder; returns (id, file, offset, connections).

    There are `files` of them, or more where these would hold over PART_EDGES edges each. Owners go to parts by their hash. Lists are streamed through the task of a part in order, so none is held as one row.
    """
    spark = edges.sparkSession
    ship(spark)
    order = F.col("pos") if "pos" in edges.columns else -F.col("sim")
    files = max(files or 1, -(-edges.count() // PART_EDGES))
    part = F.pmod(F.xxhash64("src"), F.lit(files)).cast("int")
    sized = edges.select("src", "dst", F.col("sim").cast("float").alias("sim"), order.alias("o"), part.alias("part")).withColumn("n", F.count("*").over(Window.partitionBy("src")))
    rows = sized.repartitionById(files, "part").sortWithinPartitions("src", "o", "dst").select(_bytes16("src").alias("src"), _bytes16("dst").alias("dst"), "sim", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last = [], None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            src, dst = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(n, 16) for k in (0, 1))
            fresh = np.ones(n, bool)
            fresh[1:] = (src[1:] != src[:-1]).any(axis=1)
            fresh[0] = last is None or src[0].tobytes() != last
            made = np.zeros((n + int(fresh.sum()), 20), np.uint8)
            at = np.arange(n) + np.cumsum(fresh)
            made[at, :16], made[at, 16:] = dst, b.column(2).to_numpy().astype("<f4").view(np.uint8).reshape(n, 4)
            made[at[fresh] - 1, :16] = src[fresh]
            made[at[fresh] - 1, 16:] = b.column(3).to_numpy()[fresh].astype("<u4").view(np.uint8).reshape(-1, 4)
            out.append(made.tobytes())
            last = src[-1].tobytes()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["content"])

    write_parts(rows.mapInArrow(run, "content binary"), folder)
    names = spark.read.format("binaryFile").load(folder).select("path")
    names = names.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.regexp_extract("path", "part-([0-9]+)-", 1).cast("int").alias("part"))
    lists = sized.groupBy("part", "src").agg(F.count("*").cast("int").alias("connections"))
    before = F.sum(F.col("connections") * 20 + 20).over(Window.partitionBy("part").orderBy("src").rowsBetween(Window.unboundedPreceding, -1))
    placed = lists.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
    return table(placed.join(names, "part").select(F.col("src").alias("id"), "file", "offset", "connections"), "packed-index")


def write_parts(rows: DataFrame, folder: str) -> None:
    """Rows (content binary), one for each part, as files of just these bytes and a newline, by way of Spark's own committer."""
    rows.select(F.col("content").cast("string").alias("value")).write.mode("overwrite").text(folder)


def connections_at(data: bytes, offset: int, owner: str) -> list[tuple[str, float]]:
    """Random access: the list at an offset; [] past the end, for another owner or for a cut record."""
    if offset < 0 or offset + 20 > len(data) or data[offset : offset + 16] != uuid.UUID(owner).bytes:
        return []
    (n,) = struct.unpack_from("<I", data, offset + 16)
    if offset + 20 + 20 * n > len(data):
        return []
    return [(_name(p["id"].tobytes()), float(p["sim"])) for p in np.frombuffer(data, _PAIR, n, offset + 20)]


def encode_metadata(entities: list[tuple[str, str, str]], lookup: list[tuple[str, list[str]]], forward: list[tuple[str, int]], reverse: list[tuple[str, int]]) -> bytes:
    def text(x: str) -> bytes:
        raw = x.encode()
        return struct.pack("<H", len(raw)) + raw

    def index(rows: list[tuple[str, int]]) -> bytes:
        return struct.pack("<I", len(rows)) + b"".join(uuid.UUID(i).bytes + struct.pack("<Q", o) for i, o in rows)

    parts = [
        struct.pack("<I", len(lookup)) + b"".join(text(n) + struct.pack("<H", len(ids)) + b"".join(uuid.UUID(i).bytes for i in ids) for n, ids in lookup),
        struct.pack("<I", len(entities)) + b"".join(uuid.UUID(i).bytes + text(n) + text(u) for i, n, u in entities),
        index(forward),
        index(reverse),
    ]
    starts = np.cumsum([16, *(len(p) for p in parts[:3])])
    return struct.pack("<4I", *starts.tolist()) + b"".join(parts)


def decode_metadata(data: bytes) -> dict[str, list[tuple]]:
    """The four sections: lookup (name, ids), entities (id, name, url), forward and reverse (id, offset)."""
    starts = struct.unpack_from("<4I", data, 0)

    def text(at: int) -> tuple[str, int]:
        (n,) = struct.unpack_from("<H", data, at)
        return data[at + 2 : at + 2 + n].decode(), at + 2 + n

    lookup, at = [], starts[0] + 4
    for _ in range(struct.unpack_from("<I", data, starts[0])[0]):
        name, at = text(at)
        (k,) = struct.unpack_from("<H", data, at)
        lookup.append((name, [_name(data[at + 2 + 16 * j : at + 18 + 16 * j]) for j in range(k)]))
        at += 2 + 16 * k
    entities, at = [], starts[1] + 4
    for _ in range(struct.unpack_from("<I", data, starts[1])[0]):
        ident = _name(data[at : at + 16])
        name, at = text(at + 16)
        url, at = text(at)
        entities.append((ident, name, url))
    index = np.dtype([("id", "V16"), ("at", "<u8")])
    out = {"lookup": lookup, "entities": entities}
    for key, s in (("forward", starts[2]), ("reverse", starts[3])):
        rows = np.frombuffer(data, index, struct.unpack_from("<I", data, s)[0], s + 4)
        out[key] = [(_name(r["id"].tobytes()), int(r["at"])) for r in rows]
    return out


def read_metadata(spark: SparkSession, path: str, section: str) -> DataFrame:
    """One section of metadata files as a DataFrame."""
    schema = {"lookup": "name string, ids array<string>", "entities": "id string, name string, url string", "forward": "id string, offset long", "reverse": "id string, offset long"}[section]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                yield pd.DataFrame(decode_metadata(bytes(content))[section], columns=names)

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def write_metadata(spark: SparkSession, folder: str, entities: DataFrame, lookup: DataFrame, forward: DataFrame, reverse: DataFrame) -> None:
    """A metadata file of entities (id, name, url), lookup (name, ids) and indexes (id, offset).

    Rows are encoded where they are; one task puts the file together, as its format is one file.
    """
    little = lambda x, width: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(x.cast("long")), 2 * width, "0"), 2 * k + 1, 2) for k in reversed(range(width)))))
    text = lambda c: F.concat(little(F.octet_length(F.coalesce(c, F.lit(""))), 2), F.encode(F.coalesce(c, F.lit("")), "UTF-8"))
    ident = lambda c: F.unhex(F.replace(c, F.lit("-"), F.lit("")))
    ids = F.unhex(F.array_join(F.transform("ids", lambda i: F.replace(i, F.lit("-"), F.lit(""))), ""))
    parts = [
        lookup.select(F.lit(0).alias("section"), F.col("name").alias("key"), F.concat(text(F.col("name")), little(F.size("ids"), 2), ids).alias("raw")),
        entities.select(F.lit(1), F.col("id"), F.concat(ident(F.col("id")), text(F.col("name")), text(F.col("url")))),
        forward.select(F.lit(2), F.col("id"), F.concat(ident(F.col("id")), little(F.col("offset"), 8))),
        reverse.select(F.lit(3), F.col("id"), F.concat(ident(F.col("id")), little(F.col("offset"), 8))),
    ]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).repartition(1).sortWithinPartitions("section", "key").select("section", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = [[], [], [], []], [0] * 4
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[k].append(raw)
                counts[k] += 1
        made = [struct.pack("<I", n) + b"".join(x) for n, x in zip(counts, held)]
        yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<4I", *np.cumsum([16, *map(len, made[:3])]).tolist()) + b"".join(made)], pa.binary())], names=["content"])

    ship(spark)
    write_parts(rows.mapInArrow(run, "content binary"), folder)


class Packed:
    """A part file on a local disk, mapped into memory: lists are read where they lie."""

    def __init__(self, path: str):
        with open(path.removeprefix("file://"), "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

    def connections(self, owner: str, offset: int) -> list[tuple[str, float]]:
        return connections_at(self.data, offset, owner)

    def close(self) -> None:
        self.data.close()


def lookup_lists(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(id, dst, sim, pos) of wanted(id, file, offset): lists by random access, those of one file in one task, which reads it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, asked in zip(b.column(0), b.column(1)):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                at, owner = asked.values.field("offset").to_numpy(), asked.values.field("id")
                uid = np.frombuffer(bytes.fromhex("".join(owner.to_pylist()).replace("-", "")), np.uint8).reshape(-1, 16)
                there = np.flatnonzero((at >= 0) & (at + 20 <= len(data)))
                there = there[(data[at[there][:, None] + np.arange(16)] == uid[there]).all(axis=1)]
                n = np.ascontiguousarray(data[at[there][:, None] + np.arange(16, 20)]).view("<u4").reshape(-1).astype(np.int64)
                whole = at[there] + 20 + 20 * n <= len(data)
                there, n = there[whole], n[whole]
                ends, i = np.cumsum(n), 0
                while i < len(there):
                    j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_EDGES, side="right")))
                    k, m = there[i:j], n[i:j]
                    pos = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                    pairs = data[(np.repeat(at[k], m) + 20 + 20 * pos)[:, None] + np.arange(20)]
                    sims = np.ascontiguousarray(pairs[:, 16:]).view("<f4").reshape(-1)
                    yield pa.RecordBatch.from_arrays([owner.take(pa.array(np.repeat(k, m))), _hexed(pairs[:, :16]), pa.array(sims), pa.array(pos.astype(np.int32))], names=["id", "dst", "sim", "pos"])
                    i = j

    ship(spark)
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    asked = wanted.groupBy("file").agg(F.collect_list(F.struct("id", F.col("offset").cast("long").alias("offset"))).alias("asked"))
    # a row for each file, so its bytes move once at most; as many tasks as files
    each = files.join(asked.hint("shuffle_hash"), "file").select("content", "asked")
    return each.mapInArrow(run, "id string, dst string, sim float, pos int").withColumn("dst", _dashed(F.col("dst")))
