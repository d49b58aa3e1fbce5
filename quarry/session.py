"""Session helpers: a local session, table reading, lineage cuts and size-checked joins."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is below this many bytes.
BROADCAST_LIMIT = 48 << 20
#: Bytes of text that a Python worker turns into objects at once.
PORTION = 2 << 20
#: Environment of the Python workers, which outlive their tasks: freed memory goes back to the system instead of staying with an idle worker.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20)}


def local_session(app: str = "quarry", cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package, wherever the driver was started, and give memory back."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    for k, v in WORKER_MEMORY.items():
        env.setdefault(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; set one of our own only where none is set and driver and executors are one process."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "quarry-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files: lost executors cost a re-read only."""
    importable(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def portions(batch: pa.RecordBatch, columns: list[str], limit: int = PORTION) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces whose texts in ``columns`` have ``limit`` bytes and one text more at most, so that a Python worker holds
    one piece as objects and not all of a batch, however large the texts are."""
    size = sum((pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype("int64") for c in columns), 16)
    part = size.cumsum() // limit if len(batch) else []
    start = 0
    for at in range(1, len(batch) + 1):
        if at == len(batch) or part[at] != part[start]:
            yield batch.slice(start, at - start)
            start = at


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def measured_bytes(df: DataFrame, per_row: int = 16) -> int:
    """Size of an already materialised ``df``: fixed cost per row plus the lengths of its binary and string columns."""
    cost = F.lit(per_row + 8 * len(df.columns)).cast("long")
    for c, kind in df.dtypes:
        if kind in ("binary", "string"):
            cost = cost + F.coalesce(F.octet_length(c), F.lit(0))
    return int(df.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0])


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Join; ``small`` (materialised) is broadcast if its measured size is under ``limit``, else both sides shuffle."""
    if measured_bytes(small) <= limit:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


__all__ = ["BROADCAST_LIMIT", "cut", "ensure_checkpoint_dir", "importable", "join_checked", "local_session", "measured_bytes", "portions", "shuffle_partitions", "table"]
