"""Where intermediate tables live, and how their size decides the join strategy.

A table that several plans reuse (the contest log, the daily ledger) is written once as
Parquet under the folder named by ``spark.checkpoint.dir``. That cuts lineage in a way
that survives lost executors, keeps column pruning for the readers, and gives an exact
row count from file footers, which is what the broadcast check below relies on.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 96 * 1024 * 1024
_ARRAY_ITEMS = 16
_ROWS_PER_PIECE = 1000


def start_session(app: str = "foretally", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the plans assume; on a cluster, submit-time settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, read from the session.

    A local session without one gets a new folder under /tmp, as in tests; a cluster must name a shared one.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def settle(df: DataFrame, label: str, even: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the written table.

    ``even`` is for base tables that many plans scan: one that came out in fewer pieces than
    there are cores is small, and is written again in a piece per core.
    """
    reader, path = _written(df, label)
    if even:
        cores = df.sparkSession.sparkContext.defaultParallelism
        if reader.rdd.getNumPartitions() < cores and reader.count() >= cores * _ROWS_PER_PIECE:
            reader, _ = _written(reader.repartition(cores), label)
            _delete(df.sparkSession, path)
    return reader


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return os.path.join(shared_folder(spark), "foretally", spark.sparkContext.applicationId)


_at_release: list[Callable[[str], None]] = []


def at_release(forget: Callable[[str], None]) -> None:
    """Call ``forget`` with the application's id when its tables are deleted: for those who keep readers of them."""
    _at_release.append(forget)


def release(spark: SparkSession) -> None:
    """Delete the application's intermediate tables; frames that read them can't be used any more."""
    _delete(spark, run_folder(spark))
    for forget in _at_release:
        forget(spark.sparkContext.applicationId)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = os.path.join(run_folder(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on a thin written table whose rows the next step multiplies.

    A table that already has a partition per core is left alone, so this shuffles small tables only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once an application, whatever folder they start in."""
    _shipped(spark.sparkContext.applicationId, spark)


@lru_cache(maxsize=8)
def _shipped(application: str, spark: SparkSession) -> None:
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "foretally-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as held:
        for path in sorted(root.rglob("*.py")):
            held.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))  # the driver serves it to the executors


def row_bytes(schema: T.StructType) -> int:
    """A generous in-memory width of one row, in bytes."""

    def width(kind: T.DataType) -> int:
        if isinstance(kind, T.StructType):
            return 16 + sum(width(field.dataType) for field in kind.fields)
        if isinstance(kind, T.ArrayType):
            return 16 + _ARRAY_ITEMS * width(kind.elementType)
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return 40
        return 8

    return 16 + sum(width(field.dataType) for field in schema.fields)


def fits_broadcast(schema: T.StructType, rows: int, limit: int | None = None) -> bool:
    return rows * row_bytes(schema) <= (BROADCAST_BYTES if limit is None else limit)


def attach(
    facts: DataFrame,
    state: DataFrame,
    on: list[str],
    state_rows: int,
    how: str = "inner",
    limit: int | None = None,
) -> DataFrame:
    """Join a state table (one row per key) to the facts.

    ``state_rows`` is an upper bound measured on a written table. Below the byte limit the
    state is broadcast and the facts do not move; above it the join shuffles both sides on
    the full key, where adaptive execution splits a partition that one hot key makes too big
    (safe, because the state side holds one row per key).
    """
    if fits_broadcast(state.schema, state_rows, limit):
        state = F.broadcast(state)
    return facts.join(state, on, how)
