"""Tables in the folder that all executors share, where lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
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
    """df written as Parquet and read back."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def observed(df: DataFrame, name: str, **what: Column) -> tuple[DataFrame, dict]:
    """A table and aggregates over it, worked out by the job that writes it."""
    seen = Observation()
    out = table(df.observe(seen, *(c.alias(k) for k, c in what.items())), name)
    return out, seen.get


def counted(df: DataFrame, name: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """A table and how many of its rows there are (for which `what` holds), counted by the job that writes it."""
    out, seen = observed(df, name, n=F.count(F.lit(1)) if what is None else F.count_if(what))
    return out, int(seen["n"])


#: Rows of a shuffle that one task should get, and those for which one is enough.
TASK_ROWS, FEW_ROWS = 1 << 20, 1 << 16


def tasks(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: their number follows the rows, so that no task gets more of them with a larger input."""
    return max(1, -(-rows // TASK_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // FEW_ROWS)))


def widen(spark: SparkSession, rows: int) -> None:
    """Let shuffles over a table of so many rows have partitions enough; those of small tables are joined again as they run."""
    if -(-rows // TASK_ROWS) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", tasks(spark, rows))


class Growing:
    """A table that grows by whole parts. Each is written once; all are read as one relation, so plans stay as small as for one part."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n, self.schema = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, None

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The new part and its number of rows."""
        seen, at = Observation(), f"{self.at}/{self.n:06d}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(at)
        self.n, self.schema = self.n + 1, df.schema
        return self.spark.read.schema(df.schema).parquet(at), int(seen.get["n"])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.at)


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a one-row DataFrame, by a scalar subquery: no join."""
    one = row.select(F.struct(*(F.col(f"`{c}`") for c in row.columns)).alias("r"))
    return df.withColumn("__row", one.scalar()).select(*(F.col(f"`{c}`") for c in df.columns), "__row.*")


_built: dict[tuple[str, str, str], DataFrame] = {}


def built(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A graph table that is built once for each application and input folder, like a graph file on disk."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = table(make(), name)
    return _built[key]
