"""Bitemporal reads of assertion revisions: what was valid, and what was known, at a given time.

A revision has ``valid_start/valid_end`` and ``recorded_start/recorded_end`` (half-open, null
end unbounded), ``assertion_class`` and, for observed events, ``event_at``. An observed event
holds at its instant only; all other classes hold over their valid interval.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import contains, overlaps, reasons, seconds, text_of
from ..functions.staging import small, staged

EVENT = "observed_event"
#: Days in a bucket of the batch as-of join, about the usual length of a valid interval.
BUCKET_DAYS = 64


def _at(when: datetime | str | Column) -> Column:
    return when if isinstance(when, Column) else F.lit(when).cast("timestamp_ntz")


def known(at: Column) -> Column:
    return contains("recorded_start", "recorded_end", at)


def valid(at: Column) -> Column:
    return contains("valid_start", "valid_end", at) & ((F.col("assertion_class") != EVENT) | (F.col("event_at") == at))


def point_asof(revisions: DataFrame, valid_at, known_at) -> DataFrame:
    """Revisions valid at one instant, as known at another."""
    return revisions.filter(valid(_at(valid_at)) & known(_at(known_at)))


def window_asof(revisions: DataFrame, start, end, known_at) -> DataFrame:
    """Revisions whose valid interval overlaps ``[start, end)``, as known at an instant."""
    return revisions.filter(overlaps("valid_start", "valid_end", _at(start), _at(end)) & known(_at(known_at)))


def batch_asof(revisions: DataFrame, queries: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """One row per (``query_id``, revision) for a table of point queries ``query_id, case_id, valid_at, known_at``.

    An observed event meets the questions at its very time. Any other revision is spread over the buckets of days that its valid
    interval touches, or, where that is open, its recorded interval (an interval open in both ends at the last
    question), and joined on (case, bucket), so that no pair outside a bucket is formed. The exact predicate decides in all. Few questions are
    broadcast, so that revisions stay where they are.
    """
    width = bucket_days * 86400
    bucket = lambda c: F.floor(seconds(c) / width)
    asked = queries.select("query_id", "case_id", F.col("valid_at").alias("__v"), F.col("known_at").alias("__k"))
    last = asked.agg(F.max(bucket("__v"))).first()[0]
    exact = valid(F.col("__v")) & known(F.col("__k"))
    events = revisions.filter(F.col("assertion_class") == EVENT).withColumn("__v", F.col("event_at")).join(small(asked), ["case_id", "__v"]).filter(exact)
    by_known = F.col("valid_end").isNull() & F.col("recorded_end").isNotNull()
    lo = F.when(by_known, bucket("recorded_start")).otherwise(bucket("valid_start"))
    hi = F.when(by_known, bucket("recorded_end")).otherwise(F.coalesce(F.least(bucket("valid_end"), F.lit(last)), F.lit(last)))
    spread = revisions.filter(F.col("assertion_class") != EVENT).withColumns({"__by": by_known, "__lo": lo, "__hi": hi}).filter("__lo <= __hi").withColumn("__b", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")
    dealt = asked.withColumn("__each", F.explode(F.array(F.struct(F.lit(False).alias("by"), bucket("__v").alias("b")), F.struct(F.lit(True).alias("by"), bucket("__k").alias("b")))))
    dealt = dealt.select("*", F.col("__each.by").alias("__by"), F.col("__each.b").alias("__b")).drop("__each")
    met = spread.join(small(dealt), ["case_id", "__by", "__b"]).filter(exact).drop("__by", "__b")
    return met.unionByName(events).drop("__v", "__k")


def batch_counts(revisions: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, n, least``: how many revisions answer each question of ``batch_asof``, and the least of their ids.

    A least text would sort all answers, so the least start of an id (7 bytes as a number) is found first, in a hash table of
    questions, and texts are compared among answers that begin with it.
    """
    head = F.conv(F.rpad(F.hex(F.substring(F.encode("revision_id", "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    rows = staged(revisions.select("revision_id", "case_id", "assertion_class", "event_at", "valid_start", "valid_end", "recorded_start", "recorded_end", head.alias("head")))
    found = batch_asof(rows, queries)
    sums = staged(found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("head").alias("__head")))
    first = found.join(small(sums.select("query_id", F.col("__head").alias("head"))), ["query_id", "head"]).groupBy("query_id").agg(F.min("revision_id").alias("least"))
    return sums.drop("__head").join(first, "query_id", "left")


def drop_superseded(revisions: DataFrame, known_at) -> DataFrame:
    """Revisions that no revision recorded by ``known_at`` supersedes."""
    later = revisions.filter(F.col("supersedes").isNotNull() & (F.col("recorded_start") <= _at(known_at))).select(F.col("supersedes").alias("revision_id"))
    return revisions.join(later.distinct(), "revision_id", "left_anti")


def recorded_end_from_successor(revisions: DataFrame) -> DataFrame:
    """``recorded_end`` derived anew: when the superseding revision was recorded."""
    successor = revisions.filter("supersedes is not null").groupBy(F.col("supersedes").alias("revision_id")).agg(F.min("recorded_start").alias("__end"))
    return revisions.drop("recorded_end").join(successor, "revision_id", "left").withColumnRenamed("__end", "recorded_end")


def with_dimensions(revisions: DataFrame, assertions: DataFrame, entities: DataFrame, cases: DataFrame, sources: DataFrame) -> DataFrame:
    """Revisions with assertion, subject, object, case and source columns; rows without one are dropped."""
    names = lambda side: entities.select(F.col("entity_id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"))
    return revisions.join(assertions, "assertion_id").join(names("subject"), "subject_id").join(names("object"), "object_id").join(cases, "case_id").join(sources, "source_id")


def history(revisions: DataFrame, assertion_id: str | None = None) -> DataFrame:
    """Revisions of one assertion (or all) in the order in which they became known."""
    rows = revisions if assertion_id is None else revisions.filter(F.col("assertion_id") == assertion_id)
    return rows.orderBy("assertion_id", "recorded_start", "revision_id")


def revision(revisions: DataFrame, revision_id: str) -> DataFrame:
    """The revision of an id; a missing one is an error."""
    found = revisions.filter(F.col("revision_id") == revision_id)
    if found.isEmpty():
        raise LookupError(f"no revision {revision_id}")
    return found


def refuse_future(snapshot: DataFrame, valid_at, known_at, shown: int = 10) -> DataFrame:
    """``snapshot`` unchanged, or an error that names rows outside its cutoffs."""
    bad = [r["revision_id"] for r in snapshot.filter(~(valid(_at(valid_at)) & known(_at(known_at)))).select("revision_id").orderBy("revision_id").limit(shown).collect()]
    if bad:
        raise ValueError(f"rows outside the cutoff: {', '.join(bad)}")
    return snapshot


def integrity_faults(revisions: DataFrame) -> DataFrame:
    """``revision_id, faults``: repeated ids, assertions across cases, overlap with the previous row, wrong predecessor."""
    per_id = Window.partitionBy("revision_id")
    per_assertion = Window.partitionBy("assertion_id")
    order = per_assertion.orderBy("recorded_start", "revision_id")
    last_end, last_id = F.lag("recorded_end").over(order), F.lag("revision_id").over(order)
    seen = revisions.withColumns(
        {"__n": F.count("*").over(per_id), "__lo": F.min("case_id").over(per_assertion), "__hi": F.max("case_id").over(per_assertion), "__end": last_end, "__id": last_id}
    )
    faults = reasons(
        (F.col("__n") > 1, "duplicate_revision"),
        (F.col("__lo") != F.col("__hi"), "assertion_crosses_cases"),
        (F.col("__id").isNotNull() & (F.col("__end").isNull() | (F.col("__end") > F.col("recorded_start"))), "recorded_overlap"),
        (F.col("supersedes").isNotNull() & ~F.col("supersedes").eqNullSafe(F.col("__id")), "wrong_predecessor"),
    )
    return seen.select("revision_id", text_of(faults).alias("faults")).filter("faults <> ''")


def chain_numbers(revisions: DataFrame) -> DataFrame:
    """``revision_id, revision_number`` along ``supersedes``, 1 for a first revision.

    Pointers double in each round, so a chain of n takes log2(n) joins. Revisions on or behind
    a cycle, behind an unknown id, or with a predecessor of another assertion have null.
    """
    base = revisions.select("revision_id", "assertion_id", "supersedes")
    parent = base.select(F.col("revision_id").alias("supersedes"), F.col("assertion_id").alias("__a"))
    rows = base.join(parent, "supersedes", "left").select(
        F.col("revision_id").alias("id"),
        F.when(F.col("__a") == F.col("assertion_id"), F.col("supersedes")).alias("up"),
        (F.col("supersedes").isNotNull() & ~F.coalesce(F.col("__a") == F.col("assertion_id"), F.lit(False))).alias("bad"),
        F.when(F.col("supersedes").isNull(), 0).otherwise(1).cast("long").alias("n"),
    )
    rows = staged(rows)
    for _ in range(math.ceil(math.log2(max(2, rows.count()))) + 1):
        if rows.filter("up is not null").isEmpty():
            break
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("n").alias("__n"), F.col("bad").alias("__bad"))
        rows = staged(
            rows.join(above, "up", "left").select(
                "id", F.col("__up").alias("up"), (F.col("bad") | F.coalesce("__bad", F.lit(False))).alias("bad"), (F.col("n") + F.coalesce("__n", F.lit(0))).alias("n")
            )
        )
    return rows.select(F.col("id").alias("revision_id"), F.when(F.col("up").isNull() & ~F.col("bad"), F.col("n") + 1).alias("revision_number"))


def provenance(snapshot: DataFrame, sources: DataFrame, group: str = "assertion_id") -> DataFrame:
    """Revision ids and (revision, source) structs behind each group."""
    pairs = snapshot.join(sources, "source_id").select(group, "revision_id", F.struct("revision_id", "source_id", "reliability").alias("s"))
    return pairs.groupBy(group).agg(F.array_sort(F.collect_set("revision_id")).alias("revision_ids"), F.array_sort(F.collect_list("s")).alias("sources"))


def iso_utc(at: str | Column) -> Column:
    """UTC text of a timestamp, ending in Z."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
