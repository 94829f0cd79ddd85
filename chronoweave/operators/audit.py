"""Verification of audit chains, receipts and stored objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import reasons, text_of
from ..functions.staging import ranked

GENESIS = "0" * 64


def chain_hash(columns: Sequence[str], previous: str = "previous_hash") -> Column:
    """sha256 over the columns' texts and the previous hash, by a vertical bar; null is empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*columns, previous)]), 256)


def chain_faults(events: DataFrame, columns: Sequence[str], chain: str = "chain_name", sequence: str = "sequence") -> DataFrame:
    """``chain, sequence, faults`` of events whose hash, link or number is wrong.

    Events lie in ranges of (chain, sequence); hashes and links are verified inside them, and each range's first event against the last of
    the range before, so a chain of any length is verified in many tasks.
    """
    rows = events.withColumn("__ok", F.col("event_hash") == chain_hash(columns)).select(chain, sequence, "event_hash", "previous_hash", "__ok")
    rows = ranked(rows, [sequence, "event_hash"], [chain], rank="__i", previous={"event_hash": "__last", sequence: "__number"})
    why = reasons(
        (~F.col("__ok"), "hash_mismatch"),
        (F.col("previous_hash") != F.coalesce("__last", F.lit(GENESIS)), "broken_link"),
        (F.col("__number").isNotNull() & (F.col(sequence) != F.col("__number") + 1), "sequence_gap"),
    )
    return rows.select(chain, sequence, text_of(why).alias("faults")).filter("faults <> ''")


# What an assistant's record keeps, in this order; prompt and output only as digests.
RECORDED = ("actor_id", "purpose", "action", "policy_decision", "retrieved_source_ids", "model", "config_version", "user_decision", "saved", "prompt_hash", "output_hash")


def content_free_records(uses: DataFrame, previous: str = "previous_hash") -> DataFrame:
    """Uses of an assistant without ``prompt`` and ``output``, which only their digests stand for, and with ``record_hash`` over all that is kept.

    Kept columns that ``uses`` lacks are null; ``previous`` is the hash of the record before (null: the first of a chain).
    """
    digest = lambda c: F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("")), 256)
    rows = uses.withColumns({"prompt_hash": digest("prompt"), "output_hash": digest("output"), previous: F.coalesce(F.col(previous), F.lit(GENESIS))}).drop("prompt", "output")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in RECORDED if c not in rows.columns})
    return rows.withColumn("record_hash", chain_hash(RECORDED, previous))


def receipt_faults(receipts: DataFrame) -> DataFrame:
    """``stream, receipt_no, sequence, faults``: anchors must advance, and each receipt must name the one before it. Verified in ranges, as chains are."""
    rows = ranked(receipts.select("stream", "receipt_no", "sequence", "receipt_hash", "previous_receipt"), ["receipt_no"], ["stream"], rank="__i", previous={"sequence": "__s", "receipt_hash": "__h"})
    why = reasons((F.col("sequence") <= F.col("__s"), "sequence_not_advancing"), (F.col("__h").isNotNull() & ~F.col("previous_receipt").eqNullSafe(F.col("__h")), "broken_receipt_link"))
    return rows.select("stream", "receipt_no", "sequence", text_of(why).alias("faults")).filter("faults <> ''")


def object_faults(objects: DataFrame, manifest: DataFrame) -> DataFrame:
    """``object_id, faults`` of manifest rows without object, of another size, or of another digest.

    ``objects``: ``object_id, content``; content is hashed where it is read and never moves further.
    """
    seen = objects.select("object_id", F.sha2(F.col("content").cast("binary"), 256).alias("__d"), F.octet_length("content").alias("__n"))
    rows = manifest.join(seen, "object_id", "left")
    why = reasons((F.col("__d").isNull(), "missing"), (F.col("__n") != F.col("size"), "size_mismatch"), (F.col("__d") != F.col("digest"), "digest_mismatch"))
    return rows.select("object_id", text_of(why).alias("faults")).filter("faults <> ''")


def manifest_faults(manifests: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Manifests whose stored hash is not that of their other fields as sorted JSON."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))
    return manifests.filter(F.col("manifest_hash") != F.sha2(body, 256)).select("object_id")


def manifest_hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def unrebuildable_reports(dependencies: DataFrame, objects: DataFrame) -> DataFrame:
    """``report_id, lost``: reports with dependencies that are missing or differ."""
    have = objects.select("object_id", F.col("digest").alias("__d"))
    rows = dependencies.join(have, "object_id", "left").filter(F.col("__d").isNull() | (F.col("__d") != F.col("digest")))
    return rows.groupBy("report_id").agg(F.count("*").alias("lost"))


def report_dependency_faults(dependencies: DataFrame, objects: DataFrame) -> DataFrame:
    """``report_id, name, fault``: names used twice, objects that are missing or of another size or type."""
    twice = dependencies.groupBy("report_id", "name").agg(F.count("*").alias("n")).filter("n > 1").select("report_id", "name", F.lit("duplicate_name").alias("fault"))
    have = objects.select("object_id", F.col("size").alias("__n"), F.col("media_type").alias("__t"))
    rows = dependencies.join(have, "object_id", "left")
    fault = F.when(F.col("__n").isNull(), "missing_object").when(F.col("__n") != F.col("size"), "size_mismatch").when(F.col("__t") != F.col("media_type"), "type_mismatch")
    return twice.unionByName(rows.withColumn("fault", fault).filter("fault is not null").select("report_id", "name", "fault"))


def live_retention(markers: DataFrame, at: Column) -> DataFrame:
    """Markers in force at a time; a marker id with differing values is marked as a conflict."""
    seen = markers.groupBy("digest", "marker_id").agg(F.max("retain_until").alias("retain_until"), (F.countDistinct("retain_until") > 1).alias("conflict"))
    return seen.filter(F.col("retain_until") > at)
