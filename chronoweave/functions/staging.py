"""Intermediate tables in the folder all executors share, and joins whose broadcast side was counted."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 100_000


#: Rows that one task sorts or hashes, at up to a kilobyte each.
ROWS_A_PART = 500_000


def parts_for(rows: DataFrame) -> int | None:
    """Partitions for tables of about as many rows as ``rows`` (a scan, whose count its files tell); none where the session's own number is enough.

    With them what a task sorts or hashes stays the same however large the table, and nothing is spilled.
    """
    n = -(-rows.count() // ROWS_A_PART)
    return n if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """``rows`` dealt by ``keys``, over ``parts`` partitions or as many as the session has."""
    return rows.repartition(parts, *keys) if parts else rows.repartition(*keys)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that loops keep short plans and lost executors cost little."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Written to the shared folder in buckets of ``key``, so that a loop that joins by it in each round moves the table once."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"t_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def numbered(rows: DataFrame, name: str = "row_no") -> DataFrame:
    """``rows`` (a scan, which gives the same rows in the same order again) numbered from 0: rows before its partition, plus its place there."""
    at = rows.withColumn("__at", F.monotonically_increasing_id()).withColumns({"__part": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND((1 << 33) - 1)})
    sizes = at.groupBy("__part").agg((F.max("__place") + 1).alias("n"))  # one row for each partition
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return at.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__place")).select(*rows.columns, name)


def ranked(rows: DataFrame, order: Sequence[str], group: Sequence[str] = (), rank: str = "rank", total: str | None = None, previous: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with their ``rank`` from 1 by ``order`` within ``group``, the group's size as ``total``, and the ``previous`` row's columns under new names.

    Rows are written in ranges of (group, order), so a group with most rows lies in many of them. A rank is the place in the
    range and the rows of the ranges before, less those of the groups before; only one row a range is ordered in one task. Equals of the whole
    order follow each other in any order.
    """
    keys = [*group, *order]
    laid = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    laid = laid.withColumns({"__part": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND((1 << 33) - 1)}).drop("__at")
    carried = F.struct(*[F.col(c).alias(f"g{k}") for k, c in enumerate(group)], *[F.col(c).alias(f"v{k}") for k, c in enumerate(previous or {})], F.lit(1).alias("one"))
    parts = laid.groupBy("__part").agg((F.max("__place") + 1).alias("n"), F.max_by(carried, "__place").alias("last"))  # one row for each range
    by_part = Window.orderBy("__part")
    parts = parts.select("__part", (F.sum("n").over(by_part) - F.col("n")).alias("__before"), F.lag("last").over(by_part).alias("__carried"))
    if previous:
        laid = laid.withColumn("__own", F.lag(carried).over(Window.partitionBy("__part").orderBy("__place")))
    out = laid.join(F.broadcast(parts), "__part").withColumn("__n", F.col("__before") + F.col("__place") + 1)
    if previous:
        prior = F.coalesce("__own", "__carried")
        same = F.lit(True)
        for k, c in enumerate(group):
            same &= prior[f"g{k}"].eqNullSafe(F.col(c))
        out = out.withColumns({name: F.when(same, prior[f"v{k}"]) for k, name in enumerate(previous.values())})
    if not group:
        size = [] if total is None else [F.lit(laid.count()).alias(total)]
        return out.select(*rows.columns, *(previous or {}).values(), F.col("__n").alias(rank), *size)
    firsts = laid.join(F.broadcast(parts), "__part").groupBy(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(group)]).agg(F.min(F.col("__before") + F.col("__place")).alias("__first"), F.count("*").alias("__total"))
    same = F.lit(True)
    for k, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"__g{k}"))
    return out.join(small(firsts), same).select(*rows.columns, *(previous or {}).values(), (F.col("__n") - F.col("__first")).alias(rank), *([] if total is None else [F.col("__total").alias(total)]))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if a count proves it small, unchanged otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
