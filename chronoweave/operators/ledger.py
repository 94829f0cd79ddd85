"""Publications, their exact dependencies, and what a correction makes stale."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import dealt, small, staged

PUBLICATION = "publication"


def correction_impacts(dependencies: DataFrame, corrections: DataFrame, hops: int | None = None) -> DataFrame:
    """``correction_id, publication_id, depth``: every publication reached from a corrected thing, at its least depth.

    ``dependencies``: ``publication_id, kind, target_id, target_version``; ``corrections``: ``correction_id, kind, target_id,
    target_version``. A publication that depends on the corrected version is at depth 0; one that depends on an impacted
    publication is one deeper. Each round is one join of the frontier with the dependencies and an
    anti-join with what is known, so cycles end; rounds are written to the shared folder.
    """
    deps = staged(dependencies.select("publication_id", "kind", "target_id", "target_version").distinct())
    first = deps.join(small(corrections), ["kind", "target_id", "target_version"]).select("correction_id", "publication_id").distinct()
    front = staged(first.withColumn("depth", F.lit(0)))
    seen = front
    links = deps.filter(F.col("kind") == PUBLICATION).select(F.col("target_id").alias("up"), "publication_id")
    for depth in count(1) if hops is None else range(1, hops):
        step = front.select("correction_id", F.col("publication_id").alias("up")).join(links, "up").select("correction_id", "publication_id").distinct()
        front = staged(step.join(seen.select("correction_id", "publication_id"), ["correction_id", "publication_id"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % 16 == 0:
            seen = staged(seen)
    return seen


def least_depth(impacts: DataFrame) -> DataFrame:
    """One row per (correction, publication), at the least depth."""
    return impacts.groupBy("correction_id", "publication_id").agg(F.min("depth").alias("depth"))


def new_impacts(impacts: DataFrame, stored: DataFrame) -> DataFrame:
    """Impacts that are not stored yet, to append; a repeat adds nothing."""
    keys = ["correction_id", "publication_id"]
    return least_depth(impacts).join(stored.select(*keys), keys, "left_anti")


def mark_stale(publications: DataFrame, impacts: DataFrame, reasons: DataFrame, parts: int | None = None) -> DataFrame:
    """Publications with ``stale_at`` and ``stale_reason``; the first mark stays. ``reasons``: ``correction_id, at, reason``.

    Few reasons are broadcast, as all that one correction impacts would else meet in one task; ``parts``: partitions to deal publications over.
    """
    told = impacts.join(small(reasons), "correction_id")
    if parts:
        publications, told = (dealt(df, "publication_id", parts=parts) for df in (publications, told))
    first = told.groupBy("publication_id").agg(F.min(F.struct("at", "correction_id", "reason")).alias("m"))
    new = first.select("publication_id", F.col("m.at").alias("__at"), F.col("m.reason").alias("__r"))
    out = publications.join(new, "publication_id", "left")
    kept = F.col("stale_at").isNotNull()
    return out.withColumns({"stale_reason": F.when(kept, F.col("stale_reason")).otherwise(F.col("__r")), "stale_at": F.coalesce("stale_at", "__at")}).drop("__at", "__r")


def generations(publications: DataFrame) -> DataFrame:
    """Publications with ``generation`` from 1 per (case, result key) in order of publication."""
    return publications.withColumn("generation", F.row_number().over(Window.partitionBy("case_id", "result_key").orderBy("published_at", "publication_id")))


def heads(publications: DataFrame) -> DataFrame:
    """The current publication of each (case, result key)."""
    return publications.groupBy("case_id", "result_key").agg(F.max_by("publication_id", "generation").alias("publication_id"), F.max("generation").alias("generation"))


def output_ordinals(outputs: DataFrame) -> DataFrame:
    """Outputs numbered from 1 within their publication by name, then id."""
    return outputs.withColumn("ordinal", F.row_number().over(Window.partitionBy("publication_id").orderBy("name", "output_id")))


def dependency_set(dependencies: DataFrame) -> DataFrame:
    """Distinct dependencies, for stable storage in order."""
    return dependencies.dropDuplicates().orderBy(*dependencies.columns)


def dependents(dependencies: DataFrame, targets: DataFrame) -> DataFrame:
    """Publications that depend directly on any of ``targets`` (``kind, target_id``)."""
    return dependencies.join(targets.distinct(), ["kind", "target_id"]).select("kind", "target_id", "publication_id").distinct()


def report_dependencies(*parts: DataFrame) -> DataFrame:
    """Union of (``report_id, context, target_id``) parts, distinct; a report over two contexts is an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if not out.groupBy("report_id").agg(F.countDistinct("context").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a report mixes contexts")
    return out.select("report_id", "target_id").distinct()


def undispatched(outbox: DataFrame) -> DataFrame:
    return outbox.filter("dispatched_at is null")


def dispatched(outbox: DataFrame, sent: DataFrame) -> DataFrame:
    """Outbox with dispatch times of ``sent`` (``event_id, at``); the first time stays."""
    first = sent.groupBy("event_id").agg(F.min("at").alias("__at"))
    return outbox.join(first, "event_id", "left").withColumn("dispatched_at", F.coalesce("dispatched_at", "__at")).drop("__at")


def first_requests(requests: DataFrame) -> DataFrame:
    """One request per (case, event): the earliest, by id among equals."""
    order = Window.partitionBy("case_id", "event_id").orderBy("at", "request_id")
    return requests.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def completeness(manifests: DataFrame, checks: list[str]) -> DataFrame:
    """``report_id, passed, failed``: whether all named boolean checks hold (null does not), and which do not."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in checks]))
    return manifests.select("report_id", (F.size(failed) == 0).alias("passed"), F.array_join(failed, ",").alias("failed"))
