"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, staged

WORDS = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of a document's draw by which a leaf is counted before its cut is sought.
DIGITS = 3


def token_count(text: str):
    """Words of a text column (0 for null)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def weight_of(level: str, weights: Mapping[str, int]):
    """The level's weight by value, 1 where none is given."""
    out = F.lit(1)
    for value, w in weights.items():
        out = F.when(F.col(level) == value, w).otherwise(out)
    return out.cast("long")


def shared_out(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """``nodes`` (``parent..., name, w, cap, given``) with ``alloc``: each parent's ``given`` by weight, within ``cap``.

    Children are ordered by capacity per weight. One is full if its capacity is at most its
    share of what those before it leave; full ones take their capacity, and the others share
    the rest by weight, rounded down. So a child's shortage goes to its siblings first, and
    only what no sibling can hold is missing at the parent, whose own siblings had it in the
    same way one level up, where the subtree's capacity was the cap.
    """
    big = "decimal(38,0)"
    within = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = within.orderBy(F.col("cap") / F.col("w"), name)
    used = nodes.filter("w > 0")
    used = used.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "weight_left": F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    full = F.col("cap").cast(big) * F.col("weight_left") <= F.col("w").cast(big) * (F.col("given") - F.col("before"))
    used = used.withColumn("full", full)
    used = used.withColumns({"full_cap": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(within), F.lit(0)), "open_w": F.sum(F.when(~F.col("full"), F.col("w"))).over(within)})
    alloc = F.when(F.col("full"), F.col("cap")).otherwise(F.expr(f"cast(w as {big}) * (given - full_cap) div open_w"))
    return used.withColumn("alloc", alloc.cast("long")).drop("before", "weight_left", "full", "full_cap", "open_w")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], percent: int, epochs: int) -> DataFrame:
    """``leaves`` (levels and ``tokens``) with the ``alloc`` of each leaf, from ``percent`` of all tokens down the tree."""
    nodes = leaves.withColumn("cap", F.col("tokens") * epochs)
    above: DataFrame = leaves.agg(F.expr(f"coalesce(sum(tokens) * {percent} div 100, 0)").alias("given"))
    for depth in range(1, len(levels) + 1):
        path, parent = list(levels[:depth]), list(levels[: depth - 1])
        level = nodes.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(path[-1], weights.get(path[-1], {})))
        level = level.join(above, parent) if parent else level.crossJoin(F.broadcast(above))  # one row
        above = shared_out(level, parent, path[-1]).select(*path, F.col("alloc").alias("given"))
    return leaves.join(above.withColumnRenamed("given", "alloc"), list(levels)).select(*leaves.columns, "alloc")


def draw(seed: int, epoch, id_col: str):
    """Where an epoch's order puts a document: 32 hex digits that any engine can compute."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def cuts(rows: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], percent: int, epochs: int, seed: int, id_col: str) -> DataFrame:
    """One row per leaf: levels, ``full`` epochs taken whole, and ``cut``, the last draw taken from the next epoch.

    ``rows``: levels, the id and ``n_tokens``. A leaf's documents are first counted by the leading digits of
    their draws; only the one group in which the budget ends is ordered, so no leaf is sorted as a whole.
    """
    levels = list(levels)
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")
    plan = budgets(leaves, levels, weights, percent, epochs)
    plan = staged(plan.select(*levels, F.expr("alloc div tokens").alias("full"), F.expr("alloc % tokens").alias("rest")), "leaves")
    drawn = rows.join(maybe_broadcast(plan, 20_000), levels).withColumn("draw", draw(seed, F.col("full"), id_col)).withColumn("head", F.substring("draw", 1, DIGITS))
    counted = drawn.groupBy(*levels, "full", "rest", "head").agg(F.sum("n_tokens").alias("n"))
    run = Window.partitionBy(*levels).orderBy("head")
    edge = counted.withColumn("through", F.sum("n").over(run)).filter("through > rest and through - n <= rest")
    edge = edge.groupBy(*levels).agg(F.min(F.struct("head", (F.col("through") - F.col("n")).alias("before"))).alias("e")).select(*levels, "e.*")
    last = drawn.join(maybe_broadcast(staged(edge, "edges"), 20_000), [*levels, "head"])
    inside = Window.partitionBy(*levels).orderBy("draw")  # equal draws (repeated ids) count together
    last = last.withColumn("through", F.col("before") + F.sum("n_tokens").over(inside))
    found = last.groupBy(*levels).agg(F.coalesce(F.max(F.when(F.col("through") <= F.col("rest"), F.col("draw"))), F.max("head")).alias("cut"))
    return plan.join(found, levels, "left").select(*levels, "full", F.coalesce("cut", F.lit("")).alias("cut"))


def mixed(docs: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], percent: int = 80, epochs: int = 1, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", name: str = "epoch") -> DataFrame:
    """Rows of ``docs`` that the mix takes, once for each epoch that has them (column ``name``, from 0).

    ``percent`` of all tokens (words) go down the tree of ``levels`` (columns of ``docs``) by weight, at most ``epochs``
    times what a leaf has. In each epoch a leaf's documents stand in the order of their draws; whole
    epochs are taken, then the longest prefix whose tokens fit what is left.

    A null level is a node of its own (weight 1, empty name), a null text has no token, a leaf without tokens is
    not taken, null or repeated ids share a draw and are taken together. An empty table gives no rows.
    ``docs`` itself never moves: a leaf's plan is one small row, joined to it.
    """
    keys = [f"__mix_{x}" for x in levels]
    renamed = {f"__mix_{k}": v for k, v in weights.items()}
    named = docs.withColumns({k: F.coalesce(F.col(x).cast("string"), F.lit("")) for k, x in zip(keys, levels, strict=True)})
    rows = staged(named.select(*keys, F.col(id_col).alias("__mix_id"), token_count(text_col).alias("n_tokens")), "tokens")
    plan = staged(cuts(rows, keys, renamed, percent, epochs, seed, "__mix_id").withColumnsRenamed({"full": "__mix_full", "cut": "__mix_cut"}), "cuts")
    taken = named.join(maybe_broadcast(plan, 20_000), keys).withColumn("__mix_epoch", F.explode(F.expr("sequence(0, __mix_full)")))
    taken = taken.filter((F.col("__mix_epoch") < F.col("__mix_full")) | (draw(seed, F.col("__mix_epoch"), id_col) <= F.col("__mix_cut")))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], F.col("__mix_epoch").cast("long").alias(name))
