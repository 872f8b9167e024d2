"""Shared plumbing of the corpus operators: shared-folder tables, Arrow batches and numpy hashes."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of keys that a group of `ask_groups` answers together.
ANSWER_BYTES = 8 << 20
WHITE = b" \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; where that is unset, in local mode only, in a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='kinweave-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    own = f"{at.rstrip('/')}/kinweave-{spark.sparkContext.applicationId}"
    if own not in _dirs:
        _dirs.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        atexit.register(_remove, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))
    return own


_dirs: set[str] = set()


def _remove(path, fs) -> None:
    """Clear an application's tables when its driver ends."""
    try:
        fs.delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.kept_at = at
    return out


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of `table` that nothing reads any more, and let Spark see that the shuffle files of queries that are over can go."""
    for t in tables:
        drop_table(t)
    gc.collect()
    for _ in range(2):  # the first lets go of what Python held, the second of the shuffles
        spark._jvm.System.gc()
        time.sleep(0.1)


def drop_table(t: DataFrame) -> None:
    """Delete a table of `table` that nothing reads any more."""
    spark = t.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(t.kept_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df with a number of its own for each row (place), in the order of ids (null first).

    Rows that share an id come by ranges of their texts' hashes, so that an id that many share is split. Write the result before it
    is read twice: rows with equal texts are put in any order.
    """
    keys = [F.col(id_col), F.xxhash64(text_col), F.rand(1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place + np.arange(b.num_rows)), *b.columns], names=["place", *b.schema.names])
            place += b.num_rows

    schema = type(df.schema)([*schema_of("place long").fields, *df.schema.fields])
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows with about `most` bytes of text; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that Python objects of few rows live at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def ask_groups(df: DataFrame, text: int, bits: DataFrame, ask, answer, finish, schema, run_bytes: int) -> DataFrame:
    """A written table of what documents make of an index of groups (grp, blob) that is too large to broadcast, without a row for each key.

    Documents get a number (rid) and a run (neighbours with some `run_bytes` of text) and are written. A task that reads part of a run
    sends to each group one blob of keys, marked with run and first rid; the task of the group, which holds its bits, sends a blob back;
    with those the part is finished. A hot key is asked once by each run. There are runs times groups of blobs, shorter ones as groups
    grow in number, so a group answers many together.

    ask(texts) -> (grp, blob) of each group asked; answer(grp, bits or None, blobs) -> as many blobs;
    finish(rids, columns, [(grp, blob)] by grp) -> rows of `schema`. text: which column of df is the text.
    """
    kind = type(df.schema)
    spec = kind([*schema_of("run long, rid long").fields, *df.schema.fields])
    n_cols = len(df.columns)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for b in batches:
            for i, j in chunks(text_buffers(b.column(text))[1], run_bytes):
                n = j - i
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rid)), pa.array(rid + np.arange(n)), *(c.slice(i, n) for c in b.columns)], names=["run", "rid", *b.schema.names])
                rid += n

    def parts(run: np.ndarray) -> list[tuple[int, int]]:
        cuts = [*np.flatnonzero(np.diff(run, prepend=run[:1] - 1)).tolist(), len(run)]
        return list(zip(cuts, cuts[1:]))

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            run, rid = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in parts(run):
                found = list(ask(b.column(text + 2).slice(i, j - i)))
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.int32()), pa.array(np.full(len(found), run[i])), pa.array(np.full(len(found), rid[i])), pa.array([x for _, x in found], pa.binary())], names=["grp", "run", "first", "blob"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(grp: int, bits: bytes | None, rows: list) -> pa.RecordBatch:
            runs, firsts, asked = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(firsts, pa.int64()), pa.array(np.full(len(rows), grp, np.int32)), pa.array(answer(grp, bits, list(asked)), pa.binary())], names=["run", "first", "grp", "blob"])

        now, held, rows, size = -1, None, [], 0
        for b in batches:
            grps, runs, firsts = (b.column(k).to_numpy().tolist() for k in range(3))
            for k in range(b.num_rows):
                if rows and (grps[k] != now or size >= ANSWER_BYTES):
                    yield made(now, held, rows)
                    rows, size = [], 0
                if grps[k] != now:
                    now, held = grps[k], None
                blob = b.column(3)[k].as_py()
                if runs[k] < 0:  # the bits of a group come before its keys; some have none
                    held = blob
                    continue
                rows.append((runs[k], firsts[k], blob))
                size += len(blob)
        if rows:
            yield made(now, held, rows)

    def finishes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list, found: list) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rows).combine_chunks()
            rid, *columns = (t.column(k).combine_chunks() for k in range(1, n_cols + 2))
            rid, *columns = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (rid, *columns))
            by: dict[int, list] = {}
            for f, g, blob in found:
                by.setdefault(f, []).append((g, blob))
            firsts = sorted(by)
            cuts = [0, *np.searchsorted(rid.to_numpy(), firsts[1:]).tolist(), len(rid)]
            for f, i, j in zip(firsts, cuts, cuts[1:]):
                yield finish(rid.slice(i, j - i), [c.slice(i, j - i) for c in columns], by[f])

        now, rows, found = None, [], []
        for b in batches:
            run, first, grp = (b.column(k).to_numpy() for k in (0, 1, n_cols + 3))
            for i, j in parts(run):
                if run[i] != now:
                    if rows:
                        yield from made(rows, found)
                    now, rows, found = run[i], [], []
                n = int(np.searchsorted(grp[i:j], 0))  # the documents come before the answers
                if n:
                    rows.append(b.slice(i, n))
                found += zip(first[i + n : j].tolist(), grp[i + n : j].tolist(), b.column(n_cols + 2).slice(i + n, j - i - n).to_pylist())
        if rows:
            yield from made(rows, found)

    docs = table(df.mapInArrow(number, spec), "runs")
    sides = bits.select(F.col("grp").cast("int"), F.lit(-1).cast("long").alias("run"), F.lit(-1).cast("long").alias("first"), "blob")
    asked = docs.mapInArrow(asks, "grp int, run long, first long, blob binary").union(sides).repartition("grp").sortWithinPartitions("grp", "run")
    found = table(asked.mapInArrow(answers, "run long, first long, grp int, blob binary"), "answers")
    drop(df.sparkSession)
    none = [F.lit(None).cast(f.dataType) for f in df.schema.fields]
    both = docs.select("*", F.lit(None).cast("binary").alias("__blob"), F.lit(-1).alias("__grp")).union(found.select("run", "first", *none, "blob", "grp"))
    out = table(both.repartition("run").sortWithinPartitions("run", "__grp", "rid").mapInArrow(finishes, schema), "finished")
    drop(df.sparkSession, docs, found)
    return out


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit of a uint64 array over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * base**i modulo 2**64, with a leading zero."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] that doesn't depend on where the span lies."""
    inverse = powers(len(prefix))[1]
    return (prefix[end] - prefix[start]) * inverse[start]


def schema_of(spec: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(spec)
