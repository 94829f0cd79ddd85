"""Queries over revisions, grants and their comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as c
from ..operators import governed as g
from ..operators import temporal as t
from ..functions.expressions import text_of
from ..functions.staging import small
from ..sources import rules
from .registry import query
from .views import view

KNOWN, VALID = "1998-03-01 00:00:00", "1998-01-15 00:00:00"
BEFORE, AFTER = ("1997-10-01 00:00:00", "1998-01-01 00:00:00"), ("1998-01-01 00:00:00", "1998-04-01 00:00:00")
LABELS, FIELDS = ["open", "internal"], ["device"]

_KNOWN = f"recorded_start <= timestamp '{KNOWN}' and (recorded_end is null or timestamp '{KNOWN}' < recorded_end)"
_VALID = f"valid_start <= timestamp '{VALID}' and (valid_end is null or timestamp '{VALID}' < valid_end) and (assertion_class <> 'observed_event' or event_at = timestamp '{VALID}')"
_MAY = "handling_label in ('open', 'internal') and len(list_filter(restrictions, lambda x: x <> 'device')) = 0"


def _window(lo: str, hi: str) -> str:
    return f"(valid_end is null or timestamp '{lo}' < valid_end) and valid_start < timestamp '{hi}' and {_KNOWN}"


@query(f"select revision_id, assertion_id, valid_start, recorded_start from revisions where {_VALID} and {_KNOWN}", "revisions")
def t1_point_asof(spark: SparkSession, sf: str) -> DataFrame:
    return t.point_asof(view(spark, sf, "revisions"), VALID, KNOWN).select("revision_id", "assertion_id", "valid_start", "recorded_start")


@query(f"select revision_id, assertion_id from revisions where {_window(*AFTER)}", "revisions")
def t2_window_asof(spark: SparkSession, sf: str) -> DataFrame:
    return t.window_asof(view(spark, sf, "revisions"), *AFTER, KNOWN).select("revision_id", "assertion_id")


_ASKED = "select 'q-' || cast(o_orderkey as varchar) as query_id, 'case-' || cast(o_custkey % 4 as varchar) as case_id, o_orderdate as valid_at, o_orderdate + to_days(30) as known_at from orders"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """One question per day and case."""
    o = view(spark, sf, "orders").select(F.expr("'case-' || cast(o_custkey % 4 as string)").alias("case_id"), F.col("o_orderdate").alias("valid_at")).distinct()
    return o.select(F.concat_ws("@", "case_id", F.col("valid_at").cast("string")).alias("query_id"), "case_id", "valid_at", F.expr("valid_at + make_dt_interval(30)").alias("known_at"))


@query(
    """select q.case_id || '@' || strftime(q.valid_at, '%Y-%m-%d %H:%M:%S') as query_id, count(*) as n, min(revision_id) as least from revisions r
    join (select distinct 'case-' || cast(o_custkey % 4 as varchar) as case_id, o_orderdate as valid_at from orders) q on r.case_id = q.case_id
    and valid_start <= valid_at and (valid_end is null or valid_at < valid_end) and (assertion_class <> 'observed_event' or event_at = valid_at)
    and recorded_start <= valid_at + to_days(30) and (recorded_end is null or valid_at + to_days(30) < recorded_end) group by 1""",
    "revisions",
)
def t3_batch_asof(spark: SparkSession, sf: str) -> DataFrame:
    return t.batch_counts(view(spark, sf, "revisions"), _asked(spark, sf))


@query(f"select revision_id from revisions r where not exists (select 1 from revisions s where s.supersedes = r.revision_id and s.recorded_start <= timestamp '{KNOWN}')", "revisions")
def t4_known_successor(spark: SparkSession, sf: str) -> DataFrame:
    return t.drop_superseded(view(spark, sf, "revisions"), KNOWN).select("revision_id")


@query("select r.revision_id, min(s.recorded_start) as recorded_end from revisions r left join revisions s on s.supersedes = r.revision_id group by 1", "revisions")
def t5_recorded_end(spark: SparkSession, sf: str) -> DataFrame:
    return t.recorded_end_from_successor(view(spark, sf, "revisions")).select("revision_id", "recorded_end")


@query(
    "select r.revision_id, c_name as subject_label, n_name as object_label, a.predicate as first_predicate from revisions r join customer on r.subject_id = 'c-' || cast(c_custkey as varchar) "
    "join nation on r.object_id = 'n-' || cast(n_nationkey as varchar) join (select assertion_id, min(predicate) as predicate from revisions group by 1) a on a.assertion_id = r.assertion_id",
    "revisions",
)
def t6_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    r = view(spark, sf, "revisions")
    names = view(spark, sf, "customer").selectExpr("'c-' || c_custkey as entity_id", "c_name as label").unionByName(view(spark, sf, "nation").selectExpr("'n-' || n_nationkey as entity_id", "n_name as label"))
    cases, sources = small(r.select("case_id").distinct()), small(r.select("source_id").distinct())
    assertions = r.groupBy("assertion_id").agg(F.min("predicate").alias("first_predicate"))
    return t.with_dimensions(r, assertions, names, cases, sources).select("revision_id", "subject_label", "object_label", "first_predicate")


@query("select assertion_id, revision_id, row_number() over (partition by assertion_id order by recorded_start, revision_id) as n from revisions", "revisions")
def t7_history(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = t.history(view(spark, sf, "revisions"))
    return rows.select("assertion_id", "revision_id", F.row_number().over(Window.partitionBy("assertion_id").orderBy("recorded_start", "revision_id")).alias("n"))


@query("select * exclude (restrictions) from revisions where revision_id = (select min(revision_id) from revisions)", "revisions")
def t8_lookup(spark: SparkSession, sf: str) -> DataFrame:
    r = view(spark, sf, "revisions")
    return t.revision(r, r.agg(F.min("revision_id")).first()[0]).drop("restrictions")


@query(f"select case_id, count(*) as n from revisions where {_VALID} and {_KNOWN} group by 1", "revisions")
def t9_leakage_guard(spark: SparkSession, sf: str) -> DataFrame:
    snapshot = t.point_asof(view(spark, sf, "revisions"), VALID, KNOWN)
    return t.refuse_future(snapshot, VALID, KNOWN).groupBy("case_id").agg(F.count("*").alias("n"))


@query(
    "select revision_id, 'wrong_predecessor' as faults from (select revision_id, supersedes, lag(revision_id) over (partition by assertion_id order by recorded_start, revision_id) as last from revisions) x "
    "where supersedes is not null and supersedes is distinct from last",
    "revisions",
)
def t10_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return t.integrity_faults(view(spark, sf, "revisions"))


@query(
    ", chain as (select revision_id, 1 as revision_number from revisions where supersedes is null union all select r.revision_id, revision_number + 1 from revisions r join chain c on r.supersedes = c.revision_id) "
    "select r.revision_id, revision_number from revisions r left join chain using (revision_id)",
    "revisions",
)
def t11_chain_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return t.chain_numbers(view(spark, sf, "revisions"))


@query("select assertion_id, array_to_string(list_sort(list(distinct revision_id)), ',') as revision_ids, count(*) as n_sources from revisions group by 1", "revisions")
def t12_provenance(spark: SparkSession, sf: str) -> DataFrame:
    r = view(spark, sf, "revisions")
    sources = r.select("source_id").distinct().withColumn("reliability", F.lit("B"))
    p = t.provenance(r, sources)
    return p.select("assertion_id", text_of("revision_ids").alias("revision_ids"), F.size("sources").alias("n_sources"))


@query("select revision_id, strftime(recorded_start, '%Y-%m-%dT%H:%M:%SZ') as recorded from revisions", "revisions")
def t13_iso_text(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "revisions").select("revision_id", t.iso_utc("recorded_start").alias("recorded"))


# Governed reads.
@query(
    "select request_id, case when grant_id is null then 'no_manifest' when purpose <> p then 'purpose_mismatch' when q.policy_version <> v then 'policy_mismatch' end as denial from requests q left join "
    "(select 'q-' || substr(actor_id, 3) as rid, min(grant_id) as grant_id, 'review' as p, min(policy_version) as v from grants group by 1) m on m.rid = q.request_id",
    "requests",
    "grants",
)
def p1_gate(spark: SparkSession, sf: str) -> DataFrame:
    m = view(spark, sf, "grants").groupBy(F.expr("'q-' || substr(actor_id, 3)").alias("request_id")).agg(F.lit("review").alias("purpose"), F.min("policy_version").alias("policy_version"), F.min("case_id").alias("case_id"))
    return g.gate(view(spark, sf, "requests"), m).select("request_id", "denial")


@query(f"select revision_id, handling_label from revisions where {_MAY}", "revisions")
def p2_label_and_fields(spark: SparkSession, sf: str) -> DataFrame:
    return g.project(view(spark, sf, "revisions"), LABELS, FIELDS).select("revision_id", "handling_label")


@query(f"select revision_id, assertion_id, subject_id, object_id, valid_start, recorded_start, handling_label from revisions where {_MAY}", "revisions")
def p3_columns(spark: SparkSession, sf: str) -> DataFrame:
    return g.project(view(spark, sf, "revisions"), LABELS, FIELDS, g.MANDATORY)


@query(f"select case_id, array_to_string(list_sort(list(distinct handling_label)), ',') as labels, count(*) filter (where {_MAY}) as visible from revisions group by 1", "revisions")
def p4_label_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    r = view(spark, sf, "revisions")
    seen = g.excluded(r, LABELS, FIELDS).select("case_id", "visible")
    return g.inherited_labels(r).select("case_id", text_of("labels").alias("labels")).join(seen, "case_id")


@query(
    """, ids as (select case_id, revision_id, sha256(revision_id) as h from (select distinct case_id, revision_id from revisions) x),
    sums as (select case_id, count(*) as n, """ + ", ".join(f"sum(cast('0x' || substr(h, {at}, 15) as bigint)) as s{at}" for at in (1, 16, 31, 46)) + """ from ids group by 1)
    select case_id, sha256(concat_ws(',', n, s1, s16, s31, s46)) as digest from sums""",
    "revisions",
)
def p5_digest(spark: SparkSession, sf: str) -> DataFrame:
    return g.projection_digest(view(spark, sf, "revisions"))


_LIVE = """select q.request_id, gr.grant_id from requests q join grants gr using (actor_id, case_id, policy_version)
    where list_contains(purposes, purpose) and issued_at <= asked_at and asked_at < expires_at
    and not exists (select 1 from revocations v where v.grant_id = gr.grant_id and revoked_at <= asked_at)
    qualify row_number() over (partition by q.request_id order by expires_at, gr.grant_id) = 1"""


@query(_LIVE, "requests", "revocations")
def p6_current_grants(spark: SparkSession, sf: str) -> DataFrame:
    return g.current_grants(view(spark, sf, "requests"), view(spark, sf, "grants"), view(spark, sf, "revocations")).select("request_id", "grant_id")


@query("select grant_id, array_to_string(list_sort(list_filter(labels, lambda x: x in ('open', 'internal'))), ',') as labels from grants", "grants")
def p7_least_privilege(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.array(F.lit("internal"), F.lit("open"))
    return view(spark, sf, "grants").select("grant_id", text_of(g.least_privilege(wanted, "labels", wanted)).alias("labels"))


@query(
    "select request_id, grant_id, case when not list_contains(purposes, purpose) then 'purpose_not_granted' when gr.policy_version <> q.policy_version then 'policy_changed' "
    "when asked_at < issued_at or asked_at >= expires_at then 'not_current' end as denial from requests q join grants gr on gr.actor_id = q.actor_id",
    "requests",
    "grants",
)
def p8_grant_denials(spark: SparkSession, sf: str) -> DataFrame:
    grants = view(spark, sf, "grants")
    named = grants.select("grant_id", "actor_id")
    return g.grant_denials(view(spark, sf, "requests").join(named, "actor_id"), grants)


@query(f"select r.case_id, count(*) as n from revisions r where r.case_id in (select case_id from requests where actor_id = 'u-1' and purpose = 'review') group by 1", "revisions", "requests")
def p9_case_scope(spark: SparkSession, sf: str) -> DataFrame:
    return g.in_authorized_cases(view(spark, sf, "revisions"), view(spark, sf, "requests"), "u-1", "review").groupBy("case_id").agg(F.count("*").alias("n"))


@query("select grant_id, len(list_filter(labels, lambda x: x not in ('open', 'internal'))) = 0 as authorized from grants", "grants")
def p10_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "grants").select("grant_id", F.col("labels").alias("requested"), F.array(F.lit("open"), F.lit("internal")).alias("allowed"))
    return g.retrieval_grants(rows).select("grant_id", "authorized")


@query(
    f"select q.request_id, case when l.grant_id is null then 'no_grant' when q.purpose = 'audit' then 'not_allowed' end as reason, case when l.grant_id is not null and q.purpose <> 'audit' then least(expires_at, asked_at + to_days(30)) end as expires_at "
    f"from requests q left join ({_LIVE}) l using (request_id) left join grants gr on gr.grant_id = l.grant_id",
    "requests",
    "revocations",
)
def p11_sessions(spark: SparkSession, sf: str) -> DataFrame:
    q = view(spark, sf, "requests")
    live = g.current_grants(q, view(spark, sf, "grants"), view(spark, sf, "revocations"))
    policy = q.select("request_id", F.when(F.col("purpose") == "audit", "deny").otherwise("allow").alias("decision"), "labels", "fields", F.expr("at + make_dt_interval(30)").alias("expires_at"))
    return g.sessions(q, live, policy).select("request_id", "reason", "expires_at")


# Comparisons.
def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = g.project(view(spark, sf, "revisions"), LABELS, FIELDS)
    return t.window_asof(rows, *BEFORE, KNOWN), t.window_asof(rows, *AFTER, KNOWN)


_TWO = f", b as (select * from revisions where {_MAY} and {_window(*BEFORE)}), a as (select * from revisions where {_MAY} and {_window(*AFTER)}) "
_CHANGE = (
    _TWO
    + "select *, change <> 'unchanged' and max(case when change = 'added' then 1 else 0 end) over w = 1 and max(case when change = 'removed' then 1 else 0 end) over w = 1 as assertion_changed from ("
    "select coalesce(b.revision_id, a.revision_id) as revision_id, coalesce(b.assertion_id, a.assertion_id) as assertion_id, case when b.revision_id is null then 'added' when a.revision_id is null then 'removed' else 'unchanged' end as change "
    "from b full join a on a.revision_id = b.revision_id) x window w as (partition by assertion_id)"
)


@query(_CHANGE, "revisions")
def c1_window_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Governed windows before and after, as known at one instant, compared."""
    return c.compare(*_two(spark, sf))


@query(_TWO + "(select revision_id from b except select revision_id from a) union all (select revision_id from a except select revision_id from b)", "revisions")
def c2_symmetric_difference(spark: SparkSession, sf: str) -> DataFrame:
    return c.symmetric_difference(*_two(spark, sf), "revision_id")


@query(_TWO + "select revision_id from a union select revision_id from b", "revisions")
def c3_union_ids(spark: SparkSession, sf: str) -> DataFrame:
    b, a = _two(spark, sf)
    return c.union_ids(b.select("revision_id"), a.select("revision_id"))


@query(
    "select edge_id, s.label as subject_label, o.label as object_label, case when len(periods) > 1 then 'persistent' else 'appeared' end as change_label from edges e join nodes s on s.node_id = e.subject join nodes o on o.node_id = e.object where list_contains(periods, 'after')",
    "nodes",
    "edges",
)
def c4_period_model(spark: SparkSession, sf: str) -> DataFrame:
    return c.period_edges(view(spark, sf, "edges"), view(spark, sf, "nodes"), "after").select("edge_id", "subject_label", "object_label", "change_label")


@query("select node_id, type from nodes where node_id in (select subject from edges where list_contains(periods, 'before') union select object from edges where list_contains(periods, 'before'))", "nodes", "edges")
def c4_period_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return c.period_nodes(view(spark, sf, "edges"), view(spark, sf, "nodes"), "before").select("node_id", "type")


@query(
    "select count(*) filter (where list_contains(periods, 'after') and len(periods) = 1) as appeared, count(*) filter (where list_contains(periods, 'before') and len(periods) = 1) as no_longer_observed, count(*) filter (where len(periods) = 2) as persistent from edges",
    "edges",
)
def c5_summary(spark: SparkSession, sf: str) -> DataFrame:
    return c.summary(view(spark, sf, "edges"))


@query("select edge_id, row_number() over (partition by case_id order by ts, edge_id) as n from edges", "edges")
def c6_chronological(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = view(spark, sf, "edges").withColumn("event_time", F.col("ts").cast("string"))
    return c.chronological(rows).select("edge_id", F.row_number().over(Window.partitionBy("case_id").orderBy("ts", "edge_id")).alias("n"))


@query(
    "select case_id, cast(least(90, greatest(10, round(100 * i / n))) as integer) as percent from (select *, row_number() over (partition by case_id order by gap desc, i) as r from (select case_id, row_number() over w as i, "
    "epoch(lead(ts) over w) - epoch(ts) as gap, count(*) over (partition by case_id) as n from edges window w as (partition by case_id order by ts, edge_id)) x where gap is not null) y where r = 1",
    "edges",
)
def c7_largest_gap(spark: SparkSession, sf: str) -> DataFrame:
    return c.largest_gap_split(view(spark, sf, "edges"))


@query(
    "select edge_id, case when row_number() over (partition by case_id order by ts, edge_id) <= floor(count(*) over (partition by case_id) * 40 / 100 + 0.5) then 'before' else 'after' end as side from edges", "edges"
)
def c8_two_way(spark: SparkSession, sf: str) -> DataFrame:
    return c.two_way(view(spark, sf, "edges"), 40).select("edge_id", "side")


@query("select edge_id, cast(floor((row_number() over (partition by case_id order by ts, edge_id) - 1) / ceil(count(*) over (partition by case_id) / 7)) as bigint) as slice from edges", "edges")
def c9_equal_slices(spark: SparkSession, sf: str) -> DataFrame:
    return c.equal_slices(view(spark, sf, "edges"), 7).select("edge_id", "slice")


@query(
    "select edge_id, case when ts <= m then 'before' else 'after' end as period from edges join (select case_id, list_sort(list(ts))[cast(floor(count(*) / 2) as bigint) + 1] as m from edges group by 1) x using (case_id)", "edges"
)
def c10_median_event(spark: SparkSession, sf: str) -> DataFrame:
    return c.by_median_event(view(spark, sf, "edges")).select("edge_id", "period")


@query(
    "select edge_id, s.label as subject_label, o.label as object_label, case when len(periods) = 2 then 'Both periods' when periods[1] = 'after' then 'After only' else 'Before only' end as period_label, case e.status when 'F' then 'Appeared later' when 'O' then 'Observed in both' end as change_label from edges e join nodes s on s.node_id = subject join nodes o on o.node_id = object",
    "nodes",
    "edges",
)
def c11_semantic_rows(spark: SparkSession, sf: str) -> DataFrame:
    edges = view(spark, sf, "edges").withColumn("status", F.expr("case status when 'F' then 'appeared' when 'O' then 'observed' else 'other' end"))
    return c.semantic_rows(edges, view(spark, sf, "nodes")).select("edge_id", "subject_label", "object_label", "period_label", "change_label")


@query("select edge_id, relation from edges where relation in ('transfers', 'infrastructure') and relation <> 'infrastructure'", "edges")
def c12_visibility(spark: SparkSession, sf: str) -> DataFrame:
    return c.visible_edges(view(spark, sf, "edges"), ["transfers", "infrastructure"], False).select("edge_id", "relation")


@query(_TWO + "select edge_id from edges where revision_id in (select revision_id from a union select revision_id from b)", "revisions", "edges")
def c13_visible_in_either(spark: SparkSession, sf: str) -> DataFrame:
    edges = view(spark, sf, "edges")
    shown, _ = c.visible_in_either(edges.withColumn("old", F.col("edge_id")).withColumn("edge_id", F.col("revision_id")), view(spark, sf, "nodes"), *_two(spark, sf))
    return shown.select(F.col("old").alias("edge_id"))


@query("select revision_id, 'event outside valid interval' as reasons from revisions where event_at < valid_start or event_at >= valid_end", "revisions")
def v20_domain_constraints(spark: SparkSession, sf: str) -> DataFrame:
    return rules.revision_faults(view(spark, sf, "revisions")).select("revision_id", text_of("reasons").alias("reasons"))
