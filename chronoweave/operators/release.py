"""Dissemination: what leaves the engine, with redactions applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a redacted item, link and note, and the states of charts and packets.
MASK = "Redacted chart item"
LINK_MASK = "Redacted chart link"
NOTE_MASK = "Redacted analyst note"
BLOCKED, READY = "blocked-for-factual-claims", "ready"
FOR_REVIEW, NEEDS_REVIEW = "ready-for-review", "needs-review"


def chart_rows(items: DataFrame, notes: DataFrame, redactions: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """``id, label, type, role, notes, redacted, classification`` of distinct chart items, then of ``manual`` ones.

    ``items``: ``id`` and, where known, ``label, type, role``; ``manual``: the same with its own ``classification``. Labels of
    redacted ids are masked; notes are counted by ``item_id``.
    """
    has = lambda df, c, other: F.coalesce(F.col(c), other) if c in df.columns else other
    rows = items.select("id", has(items, "label", F.col("id")).alias("label"), has(items, "type", F.lit("unknown")).alias("type"), has(items, "role", F.lit("not assigned")).alias("role"), F.lit("source projection item").alias("classification"))
    rows = rows.groupBy("id").agg(*(F.min(c).alias(c) for c in ("label", "type", "role", "classification")))
    if manual is not None:
        rows = rows.unionByName(manual.select("id", "label", *(has(manual, c, F.lit(None).cast("string")).alias(c) for c in ("type", "role", "classification"))))
    counts = notes.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("notes"))
    gone = redactions.select("id").distinct().withColumn("__gone", F.lit(True))
    out = rows.join(counts, "id", "left").join(gone, "id", "left")
    hidden = F.coalesce("__gone", F.lit(False))
    return out.select("id", F.when(hidden, MASK).otherwise(F.col("label")).alias("label"), "type", "role", F.coalesce("notes", F.lit(0)).alias("notes"), hidden.alias("redacted"), "classification")


def _masked(rows: DataFrame, redactions: DataFrame, key: str, masks: dict[str, str | None]) -> tuple[DataFrame, Column]:
    """``rows`` with the given columns, where present, replaced at redacted keys, and the condition that a row is redacted."""
    gone = redactions.select(F.col("id").alias("__id")).distinct()
    hidden = F.col("__id").isNotNull()
    out = rows.join(gone, F.col(key) == F.col("__id"), "left")
    return out.select(*(F.when(hidden, F.lit(masks[c])).otherwise(F.col(c)).alias(c) if c in masks else F.col(c) for c in rows.columns), "__id"), hidden


def redacted_items(items: DataFrame, redactions: DataFrame) -> DataFrame:
    """Items with label, text, place and style of redacted ids masked, and the flag ``redacted``."""
    out, hidden = _masked(items, redactions, "id", {"label": MASK, "text": MASK, "x": None, "y": None, "style": "redacted"})
    return out.select(*items.columns, hidden.alias("redacted"))


def redacted_links(links: DataFrame, redactions: DataFrame) -> DataFrame:
    """Links with the label of redacted ids masked, and the flag ``redacted``; their style stays."""
    out, hidden = _masked(links, redactions, "id", {"label": LINK_MASK})
    return out.select(*links.columns, hidden.alias("redacted"))


def redacted_notes(notes: DataFrame, redactions: DataFrame) -> DataFrame:
    """Notes with the text of those on a redacted ``target_id`` masked."""
    return _masked(notes, redactions, "target_id", {"text": NOTE_MASK})[0].select(*notes.columns)


def redacted_path(steps: DataFrame, redactions: DataFrame) -> DataFrame:
    """Path steps without those at a redacted id."""
    return steps.join(redactions.select("id").distinct(), "id", "left_anti")


def unsupported_claims(items: DataFrame) -> DataFrame:
    """Per chart: drawn items and links whose ``evidence_status`` is not ``evidence`` (a missing one is not), and the chart's status."""
    n = F.count_if(~F.col("evidence_status").eqNullSafe("evidence"))
    return items.groupBy("chart_id").agg(n.alias("unsupported"), F.when(n > 0, BLOCKED).otherwise(READY).alias("status"))


def packet_status(charts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per case: for review if its charts' ``status`` is ready and no task is open (a task without status is)."""
    open_ = tasks.groupBy("case_id").agg(F.count_if(~F.col("status").eqNullSafe("done")).alias("open_tasks"))
    ready = F.bool_and(F.col("status").eqNullSafe(READY))
    out = charts.groupBy("case_id").agg(ready.alias("chart_ready")).join(open_, "case_id", "left")
    n = F.coalesce("open_tasks", F.lit(0))
    return out.select("case_id", F.when(F.col("chart_ready") & (n == 0), FOR_REVIEW).otherwise(NEEDS_REVIEW).alias("status"), n.alias("open_tasks"))
