"""Tables, shared staging and size-checked joins used by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows (of a few dozen bytes each) up to which a counted table may be broadcast.
BROADCAST_ROWS = 400_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers started on this machine import the library from where the driver did.

    On a cluster the library reaches executors with ``--py-files`` or is installed there; a
    path that an executor lacks does no harm. Rows here are whole texts, so Arrow's default of 10,000 of them
    in a batch is lowered; a number the user has set stays.
    """
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "500")
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame, kind: str = "stage", codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. ``codec``: the session's if None."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if a count proves it has at most ``rows`` rows; else leave the join to a shuffle.

    ``df`` should be staged or cheap, as it is counted first.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_least(rows: int) -> int:
    """Rows beyond which a key is hot: at most a thousand keys can have more."""
    return max(4000, rows // 1000)


def join_counted(rows: DataFrame, sides: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined to ``sides`` (one row for each ``key``, ``n`` of its rows) with hot keys broadcast.

    ``total`` is the number of ``rows``; rows of a hot key stay where they are, all others move by their key. Both tables
    should be staged, as they are read twice.
    """
    often = F.broadcast(sides.filter(F.col(n) > hot_least(total)))
    seldom = sides.filter(F.col(n) <= hot_least(total))
    return rows.join(often, key).unionByName(rows.join(often.select(key), key, "left_anti").join(seldom, key))


def slices(batches, rows: int = 256):
    """Arrow batches cut small, so that a task holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # a worker lives on after the task


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One Arrow list per numpy array."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (xor-shift and multiply, in place on a copy)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x
