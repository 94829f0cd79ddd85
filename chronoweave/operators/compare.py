"""Comparisons of projections, timelines and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import seconds
from ..functions.staging import ranked, small


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """``revision_id, assertion_id, change``: added, removed or unchanged, and whether the assertion has another revision."""
    b = before.select("revision_id", F.col("assertion_id").alias("b_assertion"), F.lit(1).alias("b"))
    a = after.select("revision_id", F.col("assertion_id").alias("a_assertion"), F.lit(1).alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("unchanged")
    rows = b.join(a, "revision_id", "full_outer").select("revision_id", F.coalesce("b_assertion", "a_assertion").alias("assertion_id"), change.alias("change"))
    per = Window.partitionBy("assertion_id")
    both = (F.count_if(F.col("change") == "added").over(per) > 0) & (F.count_if(F.col("change") == "removed").over(per) > 0)
    return rows.withColumn("assertion_changed", both & (F.col("change") != "unchanged"))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in exactly one of two tables."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).unionByName(y.exceptAll(x))


def union_ids(*tables: DataFrame) -> DataFrame:
    """Sorted distinct ids of several one-column tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.distinct()


def period_edges(edges: DataFrame, nodes: DataFrame, period: str) -> DataFrame:
    """Edges of a period with their ends' labels and a change label."""
    label = lambda side: nodes.select(F.col("node_id").alias(side), F.col("label").alias(f"{side}_label"))
    change = F.when(F.size("periods") > 1, "persistent").when(F.array_contains("periods", "after"), "appeared").otherwise("no longer observed")
    return edges.filter(F.array_contains("periods", period)).join(label("subject"), "subject").join(label("object"), "object").withColumn("change_label", change)


# How a relationship's status and periods are said.
STATUS_LABELS = {"appeared": "Appeared later", "no-longer-observed": "No longer observed", "uncertain": "Uncertain", "observed": "Observed in both"}
BOTH, AFTER, BEFORE = "Both periods", "After only", "Before only"


def semantic_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their ends' labels, ``period_label`` and ``change_label`` (by ``status``; null for another one)."""
    label = lambda side: nodes.select(F.col("node_id").alias(side), F.col("label").alias(f"{side}_label"))
    period = F.when(F.size("periods") == 2, BOTH).when(F.get("periods", F.lit(0)) == "after", AFTER).otherwise(BEFORE)
    change = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])[F.col("status")]
    return edges.join(label("subject"), "subject").join(label("object"), "object").withColumns({"period_label": period, "change_label": change})


def period_nodes(edges: DataFrame, nodes: DataFrame, period: str) -> DataFrame:
    """Nodes at an end of an edge of the period."""
    here = edges.filter(F.array_contains("periods", period))
    ends = here.select(F.col("subject").alias("node_id")).union(here.select("object")).distinct()
    return nodes.join(ends, "node_id", "left_semi")


def summary(edges: DataFrame) -> DataFrame:
    """Edges by change: appeared, no longer observed, persistent."""
    b, a = F.array_contains("periods", "before"), F.array_contains("periods", "after")
    return edges.agg(F.count_if(a & ~b).alias("appeared"), F.count_if(b & ~a).alias("no_longer_observed"), F.count_if(a & b).alias("persistent"))


def chronological(edges: DataFrame, at: str = "event_time") -> DataFrame:
    """Edges with ``ts`` (an unreadable time is the epoch), ordered by it, then id."""
    return edges.withColumn("ts", F.coalesce(F.expr(f"try_to_timestamp({at})").cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz"))).orderBy("ts", "edge_id")


def largest_gap_split(edges: DataFrame, group: str = "case_id", at: str = "ts", key: str = "edge_id") -> DataFrame:
    """``group, percent``: where the longest pause between consecutive edges lies (earliest of equals), within 10 and 90."""
    rows = ranked(edges.select(group, at, key), [at, key], [group], rank="i", total="n", previous={at: "prior"})
    gap = F.when(F.col("i") > 1, seconds(at) - seconds("prior"))
    best = rows.groupBy(group).agg(F.max("n").alias("n"), F.max(F.when(gap.isNotNull(), F.struct(gap.alias("gap"), (1 - F.col("i")).alias("i")))).alias("b"))
    at_percent = F.round(100 * (-F.col("b.i")) / F.col("n")).cast("int")
    return best.select(group, F.when(F.col("n") < 2, 50).otherwise(F.least(F.lit(90), F.greatest(F.lit(10), at_percent))).alias("percent"))


def two_way(edges: DataFrame, percent: int | Column, group: str = "case_id", at: str = "ts", key: str = "edge_id") -> DataFrame:
    """Edges with ``side`` before/after at a percentage of their count, at least one on either side where there are two."""
    rows = ranked(edges, [at, key], [group], rank="__i", total="__n")
    p = percent if isinstance(percent, Column) else F.lit(percent)
    bound = F.greatest(F.lit(1), F.least(F.col("__n") - 1, F.floor(F.col("__n") * p / 100 + 0.5)))
    return rows.withColumn("side", F.when(F.col("__i") <= bound, "before").otherwise("after")).drop("__i", "__n")


def equal_slices(edges: DataFrame, slices: int, group: str = "case_id", at: str = "ts", key: str = "edge_id") -> DataFrame:
    """Edges with ``slice`` from 0: chunks of ceil(n / slices), trailing empty ones missing."""
    rows = ranked(edges, [at, key], [group], rank="__i", total="__n")
    return rows.withColumn("slice", F.floor((F.col("__i") - 1) / F.ceil(F.col("__n") / slices))).drop("__i", "__n")


def by_median_event(edges: DataFrame, group: str = "case_id", at: str = "ts") -> DataFrame:
    """Edges with ``period``: up to the middle event's time is before, later is after."""
    rows = ranked(edges, [at], [group], rank="__i", total="__n")
    middle = rows.filter(F.col("__i") - 1 == F.floor(F.col("__n") / 2)).select(F.col(group).alias("__g"), F.col(at).alias("__middle"))  # one row a group
    joined = rows.join(small(middle), F.col(group).eqNullSafe(F.col("__g")), "left")
    return joined.withColumn("period", F.when(F.col(at) <= F.col("__middle"), "before").otherwise("after")).drop("__i", "__n", "__g", "__middle")


def visible_edges(edges: DataFrame, relations: list[str], infrastructure: bool) -> DataFrame:
    """Edges of the chosen relations; infrastructure only with its toggle on."""
    return edges.filter(F.col("relation").isin(relations) & (F.lit(infrastructure) | (F.col("relation") != "infrastructure")))


def visible_in_either(edges: DataFrame, nodes: DataFrame, before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose revision one of two windows holds, and the nodes at their ends."""
    ids = union_ids(before.select("revision_id"), after.select("revision_id"))
    shown = edges.join(ids, edges["edge_id"] == ids["revision_id"], "left_semi")
    ends = shown.select(F.col("subject").alias("node_id")).union(shown.select("object")).distinct()
    return shown, nodes.join(ends, "node_id", "left_semi")
