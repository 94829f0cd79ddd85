"""Governed reads: gates, label and field filters, grants. All are placed before any other operator in a plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MANDATORY = ("revision_id", "assertion_id", "subject_id", "object_id", "valid_start", "recorded_start", "handling_label")


def gate(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """Requests with ``denial``: the first of no manifest, other purpose, other case, other policy; null if allowed."""
    m = manifests.select("request_id", F.col("purpose").alias("__p"), F.col("case_id").alias("__c"), F.col("policy_version").alias("__v"))
    denial = (
        F.when(F.col("__p").isNull(), "no_manifest")
        .when(F.col("purpose") != F.col("__p"), "purpose_mismatch")
        .when(F.col("case_id") != F.col("__c"), "case_mismatch")
        .when(F.col("policy_version") != F.col("__v"), "policy_mismatch")
    )
    return requests.join(m, "request_id", "left").withColumn("denial", denial).drop("__p", "__c", "__v")


def may_read(labels: Sequence[str], fields: Sequence[str]) -> Column:
    """The row's label is allowed and none of its restricted fields is outside the allowed ones."""
    allowed = F.array(*[F.lit(x) for x in fields]) if fields else F.expr("cast(array() as array<string>)")
    return F.col("handling_label").isin(list(labels)) & (F.size(F.array_except("restrictions", allowed)) == 0)


def project(revisions: DataFrame, labels: Sequence[str], fields: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows the reader may see; with ``columns``, these and nothing else (mandatory ones must be among them)."""
    rows = revisions.filter(may_read(labels, fields))
    if columns is None:
        return rows
    missing = [c for c in MANDATORY if c not in columns]
    if missing:
        raise ValueError(f"mandatory fields not requested: {', '.join(missing)}")
    return rows.select(*columns)


def excluded(revisions: DataFrame, labels: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per case: rows in, rows left out by label, rows left out by fields alone."""
    label_ok = F.col("handling_label").isin(list(labels))
    ok = may_read(labels, fields)
    return revisions.groupBy("case_id").agg(F.count_if(ok).alias("visible"), F.count_if(~label_ok).alias("by_label"), F.count_if(label_ok & ~ok).alias("by_field"))


def inherited_labels(rows: DataFrame, group: str = "case_id") -> DataFrame:
    """Distinct labels of the rows behind a result, sorted."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set("handling_label")).alias("labels"))


def projection_digest(rows: DataFrame, group: str = "case_id") -> DataFrame:
    """Digest of the set of revisions in each group's projection: equal sets, equal digests.

    Four parts of the ids' hashes are added up, so sums combine before the shuffle and a group's ids never meet in one row.
    """
    ids = rows.select(group, "revision_id").distinct().withColumn("__h", F.sha2("revision_id", 256))
    sums = [F.sum(F.conv(F.substring("__h", at, 15), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 16, 31, 46)]
    return ids.groupBy(group).agg(F.sha2(F.concat_ws(",", F.count("revision_id").cast("string"), *sums), 256).alias("digest"))


def current_grants(requests: DataFrame, grants: DataFrame, revocations: DataFrame) -> DataFrame:
    """The grant that holds for each request at its ``at``: earliest expiry, then least id.

    A grant matches actor, case, policy and one of its purposes, was issued by then, has not
    expired, and was not revoked by then.
    """
    r = requests.select("request_id", "actor_id", "case_id", "policy_version", F.col("purpose").alias("__purpose"), F.col("at").alias("__at"))
    met = grants.join(r, ["actor_id", "case_id", "policy_version"]).filter("array_contains(purposes, __purpose) and issued_at <= __at and __at < expires_at")
    ended = revocations.select("grant_id", "revoked_at")
    gone = met.join(ended, "grant_id").filter("revoked_at <= __at").select("request_id", "grant_id")
    first = Window.partitionBy("request_id").orderBy("expires_at", "grant_id")
    live = met.join(gone, ["request_id", "grant_id"], "left_anti")
    return live.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "__purpose", "__at")


def least_privilege(requested: str | Column, granted: str | Column, policy: str | Column) -> Column:
    """What is requested, granted and in the policy, sorted."""
    return F.array_sort(F.array_intersect(F.array_intersect(requested, granted), policy))


def grant_denials(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Each (request, its named grant) with the first denial of five, null if the grant holds."""
    g = grants.select("grant_id", F.col("actor_id").alias("__a"), F.col("case_id").alias("__c"), "purposes", F.col("policy_version").alias("__v"), "issued_at", "expires_at")
    denial = (
        F.when(F.col("__a") != F.col("actor_id"), "other_actor")
        .when(F.col("__c") != F.col("case_id"), "other_case")
        .when(~F.array_contains("purposes", F.col("purpose")), "purpose_not_granted")
        .when(F.col("__v") != F.col("policy_version"), "policy_changed")
        .when((F.col("at") < F.col("issued_at")) | (F.col("at") >= F.col("expires_at")), "not_current")
    )
    return requests.join(g, "grant_id").withColumn("denial", denial).select("request_id", "grant_id", "denial")


def sessions(requests: DataFrame, grants: DataFrame, policy: DataFrame) -> DataFrame:
    """Effective session of each request: denied without a current explicit allow; labels and fields by least privilege.

    ``grants``: current grant per request (``request_id, labels, fields, expires_at``); ``policy``: decision per request
    (``request_id, decision, labels, fields, expires_at``). The session ends with the earlier of the two.
    """
    g = grants.select("request_id", F.col("labels").alias("__gl"), F.col("fields").alias("__gf"), F.col("expires_at").alias("__ge"))
    p = policy.select("request_id", "decision", F.col("labels").alias("__pl"), F.col("fields").alias("__pf"), F.col("expires_at").alias("__pe"))
    joined = requests.join(g, "request_id", "left").join(p, "request_id", "left")
    reason = F.when(F.col("__ge").isNull(), "no_grant").when(F.col("decision").isNull() | (F.col("decision") != "allow"), "not_allowed").when(F.least("__ge", "__pe") <= F.col("at"), "expired")
    ok = F.col("reason").isNull()
    return joined.withColumn("reason", reason).select(
        "request_id",
        "reason",
        F.when(ok, least_privilege("labels", "__gl", "__pl")).alias("labels"),
        F.when(ok, least_privilege("fields", "__gf", "__pf")).alias("fields"),
        F.when(ok, F.least("__ge", "__pe")).alias("expires_at"),
    )


def in_authorized_cases(rows: DataFrame, authorized: DataFrame, actor: str | None, purpose: str | None) -> DataFrame:
    """Rows of cases that (actor, purpose) may see; nothing without either."""
    if not actor or not purpose:
        return rows.limit(0)
    mine = authorized.filter((F.col("actor_id") == actor) & (F.col("purpose") == purpose)).select("case_id").distinct()
    return rows.join(mine, "case_id", "left_semi")


def retrieval_grants(requests: DataFrame) -> DataFrame:
    """Requests with ``authorized`` and the ids to return: all of ``requested``, or none if one is outside ``allowed``."""
    outside = F.array_except("requested", "allowed")
    ok = F.size(outside) == 0
    return requests.withColumns({"authorized": ok, "outside": outside, "returned": F.when(ok, F.col("requested")).otherwise(F.expr("cast(array() as array<string>)"))})
