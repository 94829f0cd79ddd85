"""Connected components by contraction: few rounds, no node's links in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of every id that has a link.

    ``links``: undirected, in two long columns; null ends, loops and repeats are ignored.
    Returns ``id, component_id``. In each round every node moves to the smallest node
    beside it (a partial ``min`` before the shuffle, so a hub costs one row a task), its
    parent's parent is taken, and links are renamed and made distinct. Each round at
    least halves the nodes that still have links; all rounds are written to the shared folder.
    """
    spark = links.sparkSession
    edges = staged(
        links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct(),
        "links",
    )
    labels = spark.createDataFrame([], "id long, component_id long")
    first = True
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "parents")
        jump = staged(
            up.join(up.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")),
            "parents",
        )
        if first:
            labels, first = jump.select(F.col("u").alias("id"), F.col("p").alias("component_id")), False
        else:
            labels = labels.join(jump.withColumnRenamed("u", "component_id"), "component_id", "left").select(
                "id", F.coalesce("p", "component_id").alias("component_id")
            )
            labels = staged(labels, "labels")
        edges = staged(
            edges.join(jump.select("u", F.col("p").alias("pu")), "u")
            .join(jump.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
            .filter("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct(),
            "links",
        )
    return labels
