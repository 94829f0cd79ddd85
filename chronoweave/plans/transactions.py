"""Queries over transactions: validation and account indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import text_of
from ..functions.staging import staged
from ..operators import graph, risk
from ..sources import rules
from .registry import query
from .views import parts, view

GRAIN = ["month"]


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as an uncleaned upload: texts with faults of every kind."""
    t = view(spark, sf, "transactions")
    return t.select(
        "row_no",
        "id",
        F.expr("case row_no % 13 when 0 then date_format(at, 'yyyy-MM-dd HH:mm:ss') when 1 then 'soon Z' else date_format(at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") end").alias("at"),
        F.expr("case when row_no % 17 = 0 then '' when row_no % 19 = 0 then 'x' else origin end").alias("origin"),
        F.expr("case when row_no % 23 = 0 then origin else destination end").alias("destination"),
        F.expr("case when row_no % 29 = 0 then 'many' when row_no % 31 = 0 then '-5' else format_string('%.0f', amount) end").alias("amount"),
        F.expr("case when row_no % 37 = 0 then 'doge' when row_no % 41 = 0 then '' when amount = 0 then 'n/a' else ' usd ' end").alias("currency"),
        F.expr("case row_no % 5 when 0 then 'CR' when 1 then 'out' when 2 then 'sideways' else '' end").alias("direction"),
        F.expr("case when row_no % 43 = 0 then ' ' else type end").alias("type"),
        "description",
    )


MAPPING = {k: k for k in ("id", "at", "origin", "destination", "amount", "currency", "direction", "type", "description")}

_RAW = """, raw as (select row_no, id,
        case row_no % 13 when 0 then null when 1 then null else at_time end as at_time, row_no % 13 <> 0 as zoned,
        case when row_no % 17 = 0 then '' when row_no % 19 = 0 then 'x' else origin end as origin0, case when row_no % 23 = 0 then origin else destination end as destination0, origin, destination,
        case when row_no % 29 = 0 then null when row_no % 31 = 0 then -5.0 else amount end as amount0, amount,
        case when row_no % 37 = 0 then 'DOGE' when row_no % 41 = 0 then '' when amount = 0 then 'N/A' else 'USD' end as currency,
        case row_no % 5 when 0 then 'credit' when 1 then 'outbound' when 2 then 'sideways' else '' end as direction, case when row_no % 43 = 0 then '' else type end as type,
        row_number() over (partition by id order by row_no) > 1 as again from transactions),
    judged as (select row_no + 2 as row_number, id, currency, direction, amount0, type, array_to_string(list_filter([
        case when at_time is null then 'Invalid timestamp or missing explicit timezone' end, case when amount0 is null then 'Invalid amount' end, case when currency = '' then 'Missing currency' end,
        case when currency = 'DOGE' then 'Unsupported currency: DOGE' end, case when origin0 = '' then 'Missing origin' end, case when origin0 = 'x' then 'Invalid origin identity' end,
        case when origin0 <> '' and origin0 = destination0 and amount0 is distinct from 0 then 'Origin and destination are identical for money movement' end,
        case when direction = 'sideways' then 'Unsupported direction: sideways' end, case when amount0 = 0 and currency <> 'N/A' then 'Zero-amount context rows must use N/A currency' end,
        case when amount0 < 0 then 'Amount cannot be negative' end, case when type = '' then 'Missing transaction type' end, case when again then 'Duplicate transaction id' end],
        lambda x: x is not null), ',') as reasons from raw) """


@query(_RAW + "select row_number, id, currency, direction, amount0 as amount, reasons from judged", "transactions")
def v_validated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every row with its canonical values and all reasons against it."""
    rows = rules.validated(_raw(spark, sf), MAPPING)
    return rows.select("row_number", "id", "currency", "direction", "amount", text_of("reasons").alias("reasons"))


@query(_RAW + "select count(*) as total, count(*) filter (where reasons = '') as accepted, count(*) filter (where reasons <> '') as rejected, round(100.0 * count(*) filter (where reasons = '') / greatest(1, count(*))) as coverage from judged", "transactions")
def v18_import_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rules.import_summary(rules.validated(_raw(spark, sf), MAPPING))


@query(_RAW + "select id, currency, type from judged where reasons = ''", "transactions")
def v13_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return rules.accepted(rules.validated(_raw(spark, sf), MAPPING)).select("id", "currency", "type")


@query("select 'unknown_object' as fault, object as id from edges where object not in (select node_id from nodes where type = 'account') group by object", "nodes", "edges")
def v19_interchange(spark: SparkSession, sf: str) -> DataFrame:
    return rules.interchange_faults(view(spark, sf, "edges"), view(spark, sf, "nodes").filter("type = 'account'"))


_SIDES = """, sides as (select destination as account, 'in' as side, origin as other, id, at_time, amount, type, description, row_no, month from transactions
    union all select origin, 'out', destination, id, at_time, amount, type, description, row_no, month from transactions),
    flows as (select account, month, count(distinct case when amount > 0 and side = 'in' then other end) as origins, count(distinct case when amount > 0 and side = 'out' then other end) as destinations,
        coalesce(sum(case when amount > 0 and side = 'in' then amount end), 0) as inbound, coalesce(sum(case when amount > 0 and side = 'out' then amount end), 0) as outbound,
        count(*) filter (where amount > 0) as money_rows, count(*) filter (where amount > 0 and amount % 50 = 0) as round_rows, count(*) filter (where amount = 0) as context_rows,
        count(distinct case when amount > 0 and other <> account then other end) as counterparties from sides group by account, month),
    fast as (select i.account, i.month, min(abs(epoch(o.at_time) - epoch(i.at_time))) / 3600.0 as fastest_hours from sides i join sides o on i.account = o.account and i.month = o.month
        where i.side = 'in' and o.side = 'out' and i.amount > 0 and o.amount > 0 group by 1, 2),
    contrary as (select account, month, bool_or(regexp_matches(t, 'payroll|salary|wage')) as r0, bool_or(regexp_matches(t, 'payment processor|processor|merchant|omnibus')) as r1,
        bool_or(regexp_matches(t, 'refund|chargeback|reversal')) as r2, bool_or(regexp_matches(t, 'batch|bulk|settlement')) as r3,
        bool_and(amount = 0 or regexp_matches(d, 'login|device|ip|shared infrastructure|branch')) as r4
        from (select *, lower(type || ' ' || description || ' ' || account || ' ' || other) as t, lower(type || ' ' || description) as d from sides) x group by 1, 2),
    scored as (select f.*, case when inbound > 0 then outbound / inbound else 0 end as ratio, fastest_hours, not (r0 or r1 or r2 or r3 or r4) as free, cast(r0 as integer) + cast(r1 as integer) + cast(r2 as integer) + cast(r3 as integer) + cast(r4 as integer) as n_contrary
        from flows f left join fast using (account, month) join contrary using (account, month)),
    final as (select *, case when free then 18 * (cast(origins >= 2 as integer) + cast(destinations >= 2 as integer) + cast(ratio >= 0.75 as integer) + coalesce(cast(fastest_hours <= 3 as integer), 0) + cast(round_rows > 0 as integer)) else 0 end as score from scored) """


@query(_SIDES + "select account, month, origins, destinations, round(inbound, 2) as inbound, round(outbound, 2) as outbound, money_rows, round_rows, context_rows, counterparties from flows", "transactions")
def f1_account_flows(spark: SparkSession, sf: str) -> DataFrame:
    f = risk.flows(view(spark, sf, "payments"), GRAIN, parts=parts(spark, sf))
    return f.select("account", "month", "origins", "destinations", F.round("inbound", 2).alias("inbound"), F.round("outbound", 2).alias("outbound"), "money_rows", "round_rows", "context_rows", "counterparties")


@query(_SIDES + "select account, month, round(fastest_hours, 6) as fastest_hours from (select distinct account, month from sides where amount > 0) s left join fast using (account, month)", "transactions")
def f2_fastest_pass_through(spark: SparkSession, sf: str) -> DataFrame:
    return risk.fastest_pass_through(view(spark, sf, "payments"), GRAIN).withColumn("fastest_hours", F.round("fastest_hours", 6))


@query(_SIDES + "select account, month, score, case when score >= 70 then 'review-priority' when score >= 45 then 'watch' else 'background' end as status, n_contrary from final", "transactions")
def f4_account_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators, hard negatives, score and status per account and month."""
    s = risk.score_accounts(view(spark, sf, "payments"), GRAIN, parts=parts(spark, sf))
    return s.select("account", "month", "score", "status", F.size("contrary").alias("n_contrary"))


@query(
    _SIDES + ", marked as (select distinct account, month from sides where amount > 90000) select account, month, least(100, case when score > 0 then score / 18 * 16 else 0 end + case when m.account is null then 0 else 20 end) as score from final left join marked m using (account, month)",
    "transactions",
)
def f5_flagged_scores(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "payments").withColumn("flagged", F.col("amount") > 90000)
    return risk.score_accounts(t, GRAIN, points=16, bonus="flagged", parts=parts(spark, sf)).select("account", "month", F.col("score").cast("double").alias("score"))


@query(_SIDES + "select account, array_to_string(list(id order by side, row_no), ',') as dependencies from sides where amount > 0 group by 1", "transactions")
def f7_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return risk.dependencies(view(spark, sf, "transactions"))


@query(_SIDES + "select account || '@' || month as account, score from final order by score desc, account || '@' || month limit 20", "transactions")
def f8_top_accounts(spark: SparkSession, sf: str) -> DataFrame:
    s = risk.score_accounts(view(spark, sf, "payments"), GRAIN, parts=parts(spark, sf)).withColumn("account", F.concat_ws("@", "account", "month"))
    return risk.top_accounts(s, 20).select("account", "score")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "payments")
    return t.withColumns({"expected_account_id": F.col("origin"), "expected_review_priority": F.expr("case description when 'urgent' then true when 'goods' then false end")})


@query("select origin as account, bool_or(description = 'urgent') as positive from transactions where description in ('urgent', 'goods') group by 1", "transactions")
def f9_labels(spark: SparkSession, sf: str) -> DataFrame:
    return risk.labelled(_labelled(spark, sf))


@query(
    """, t as (select *, 'all' as m from transactions), sides as (select destination as account, 'in' as side, origin as other, amount, type, description, at_time from t union all select origin, 'out', destination, amount, type, description, at_time from t),
    x as (select account, bool_or(regexp_matches(lower(type || ' ' || description || ' ' || account || ' ' || other), 'refund')) or bool_and(amount = 0 or regexp_matches(lower(type || ' ' || description), 'login|device|ip')) as contrary,
        count(distinct case when amount > 0 and side = 'in' then other end) as o, count(distinct case when amount > 0 and side = 'out' then other end) as d,
        coalesce(sum(case when amount > 0 and side = 'in' then amount end), 0) as i, coalesce(sum(case when amount > 0 and side = 'out' then amount end), 0) as u, bool_or(amount > 0 and amount % 50 = 0) as r from sides group by 1),
    near as (select a.account, min(abs(epoch(b.at_time) - epoch(a.at_time))) / 3600.0 as h from sides a join sides b on a.account = b.account where a.side = 'in' and b.side = 'out' and a.amount > 0 and b.amount > 0 group by 1),
    s as (select account, contrary, case when contrary then 0 else 18 * (cast(o >= 2 as integer) + cast(d >= 2 as integer) + cast(case when i > 0 then u / i else 0 end >= 0.75 as integer) + coalesce(cast(h <= 3 as integer), 0) + cast(r as integer)) end as score from x left join near using (account)),
    l as (select origin as account, bool_or(description = 'urgent') as positive from transactions where description in ('urgent', 'goods') group by 1),
    top as (select account from s order by score desc, account limit 3)
    select count(*) filter (where positive and account in (from top)) / 3.0 as precision_at_budget, count(*) filter (where not positive and account in (from top)) as false_positives,
        count(*) filter (where not positive and score >= 70) as flagged_hard_negatives, count(*) filter (where score = 0 and contrary) / cast((select count(*) from l) as double) as abstention_rate,
        count(*) filter (where score > 0 or contrary) / cast(count(*) as double) as explanation_coverage, (select count(*) from l) as labelled, (select count(*) from l where positive) as positives, 3 as budget
    from s left join l using (account)""",
    "transactions",
)
def f10_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    t = _labelled(spark, sf)
    return risk.benchmark(staged(risk.score_accounts(t, parts=parts(spark, sf)).drop("budget")), staged(risk.labelled(t)))


@query("select max(at_time) as known_at, arg_min(at_time, row_no) as first_row_at, count(*) as rows from transactions", "transactions")
def f11_event_range(spark: SparkSession, sf: str) -> DataFrame:
    return risk.event_range(view(spark, sf, "transactions"))


_FEATURES = """select account, month, cast(origins as double) as inbound_origins, cast(destinations as double) as outbound_destinations, round(least(1.5, ratio), 6) as pass_through_ratio,
    cast(coalesce(fastest_hours, 999) <= 3 as integer)::double as rapid_pass_through, round(case when money_rows > 0 then round_rows / money_rows else 0 end, 6) as round_amount_share,
    cast(context_rows > 0 as integer)::double as infrastructure_touch, cast(counterparties as double) as bridge_centrality from scored"""


@query(_SIDES + _FEATURES, "transactions")
def f12_features(spark: SparkSession, sf: str) -> DataFrame:
    f = risk.features(view(spark, sf, "payments"), GRAIN, parts=parts(spark, sf))
    return f.withColumns({c: F.round(c, 6) for c in ("pass_through_ratio", "round_amount_share")})


SUPPRESSORS = (("payroll|salary", "payroll or salary hub pattern"), ("refund|reversal|chargeback", "refund or reversal pattern"), ("processor|merchant|settlement", "legitimate processor pattern"), ("batch", "bank batch timing pattern"))


@query(
    _SIDES + f", feat as ({_FEATURES}), raw as (select *, 18 * cast(inbound_origins >= 2 as integer) + 18 * cast(outbound_destinations >= 2 as integer) + 18 * cast(pass_through_ratio >= 0.75 as integer) + 18 * cast(rapid_pass_through > 0 as integer) "
    "+ 10 * cast(round_amount_share >= 0.5 as integer) + 10 * cast(infrastructure_touch > 0 as integer) + 8 * cast(bridge_centrality >= 4 as integer) as raw from feat) "
    "select account, month, raw, greatest(0, least(100, raw - 22)) as score from raw",
    "transactions",
)
def f13_anomaly_scores(spark: SparkSession, sf: str) -> DataFrame:
    return risk.anomaly_scores(view(spark, sf, "payments"), SUPPRESSORS, GRAIN, parts=parts(spark, sf)).select("account", "month", "raw", "score")


_WHOLE = _FEATURES.replace("round(least(1.5, ratio), 6)", "least(1.5, ratio)").replace("round(case when money_rows > 0 then round_rows / money_rows else 0 end, 6)", "case when money_rows > 0 then round_rows / money_rows else 0 end")


@query(
    _SIDES + f", feat as ({_WHOLE}) select account, month, " + ", ".join(f"round(({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1), 5) as {c}" for c in risk.FEATURES) + " from feat",
    "transactions",
)
def f14_standardized(spark: SparkSession, sf: str) -> DataFrame:
    f = risk.standardized(staged(risk.features(view(spark, sf, "payments"), GRAIN, parts=parts(spark, sf))))  # read twice
    return f.select("account", "month", *[F.round(c, 5).alias(c) for c in risk.FEATURES])


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """Features and review label of each account and month, from one table of facts, written once for all that reads it."""
    s = risk.score_accounts(view(spark, sf, "payments"), GRAIN, parts=parts(spark, sf)).withColumn("label", (F.col("score") >= 54).cast("double"))
    return staged(risk.features_of(s, ["account", "month", "label"]))


@query()
def f15_review_model(spark: SparkSession, sf: str) -> DataFrame:
    """A logistic model of the review label; held-out behaviour is tested in the test suite."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = _reviewed(spark, sf)
    model = risk.review_model(rows)
    scored = model.transform(VectorAssembler(inputCols=list(risk.FEATURES), outputCol="features").transform(risk.standardized(rows)))
    p = vector_to_array("probability")[1]
    return scored.select("account", "month", "label", p.alias("p"), F.when(p >= 0.67, "review-priority").when(p >= 0.40, "watch").otherwise("background").alias("status"))


@query()
def f16_contributions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _reviewed(spark, sf)
    weights = dict(zip(risk.FEATURES, [float(x) for x in risk.review_model(rows).coefficients], strict=True))
    return risk.contributions(risk.standardized(rows), weights).select("account", "month", "contributions")


@query(
    _SIDES + "select count(*) filter (where score >= 54 and origins >= 2) as tp, count(*) filter (where score >= 54 and origins < 2) as fp, count(*) filter (where score < 54 and origins >= 2) as fn, count(*) filter (where score < 54 and origins < 2) as tn, "
    "count(*) filter (where score >= 54 and origins >= 2) / cast(greatest(1, count(*) filter (where score >= 54)) as double) as precision, count(*) filter (where score >= 54 and origins >= 2) / cast(greatest(1, count(*) filter (where origins >= 2)) as double) as recall from final",
    "transactions",
)
def f17_confusion(spark: SparkSession, sf: str) -> DataFrame:
    s = risk.score_accounts(view(spark, sf, "payments"), GRAIN, parts=parts(spark, sf))
    return risk.confusion(s, F.col("score") >= 54, F.col("origins") >= 2)


@query(
    "select node_id, 'account' as type, 'Acct ' || substr(node_id, 6) as label from (select origin as node_id from transactions union select destination from transactions) x", "transactions"
)
def g1_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.nodes_of(view(spark, sf, "transactions"))


@query("select id, row_no, case when amount = 0 or regexp_matches(type, 'login|device|ip|infrastructure') then 'infrastructure' when regexp_matches(type, 'cash|withdraw|atm|wallet') then 'cashout' else 'transfers' end as relation from transactions", "transactions")
def g2_edge_classes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "transactions").select("id", "row_no", graph.edge_class().alias("relation"))


@query("select account, count(distinct other) as degree from (select origin as account, destination as other from transactions union all select destination, origin from transactions) x where account <> other group by 1", "transactions")
def g12_degrees(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "transactions").select(F.col("origin").alias("subject"), F.col("destination").alias("object"), F.col("id").alias("edge_id"))
    return graph.degrees(e).withColumnRenamed("node_id", "account")
