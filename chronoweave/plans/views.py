"""Domain tables derived from the driver's tables, by one recipe for both engines."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.staging import dealt, parts_for, staged


@dataclass(frozen=True)
class Dialect:
    """The few expressions that Spark and DuckDB write differently."""

    duck: bool

    def days(self, n: str) -> str:
        return f"to_days(cast({n} as integer))" if self.duck else f"make_dt_interval(cast({n} as int))"

    def hours(self, n: str) -> str:
        return f"to_hours(cast({n} as integer))" if self.duck else f"make_dt_interval(0, cast({n} as int))"

    def array(self, *items: str) -> str:
        if not items:
            return "[]::varchar[]" if self.duck else "cast(array() as array<string>)"
        return f"[{', '.join(items)}]" if self.duck else f"array({', '.join(items)})"

    def seconds(self, at: str) -> str:
        return f"cast(epoch({at}) as bigint)" if self.duck else f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {at})"

    def half(self, a: str, b: int) -> str:
        return f"({a} // {b})" if self.duck else f"({a} div {b})"

    def json_int(self, column: str, key: str) -> str:
        return f"cast(json_extract({column}, '$.{key}') as bigint)" if self.duck else f"cast(get_json_object({column}, '$.{key}') as bigint)"


SPARK, DUCK = Dialect(False), Dialect(True)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "documents", "conversations")


def _revisions(d: Dialect) -> str:
    label = "case substr(o_orderpriority, 1, 1) when '1' then 'restricted' when '2' then 'internal' else 'open' end"
    fields = f"case o_orderkey % 3 when 0 then {d.array()} when 1 then {d.array(chr(39) + 'device' + chr(39))} else {d.array(chr(39) + 'amount' + chr(39), chr(39) + 'device' + chr(39))} end"
    start = f"o_orderdate + {d.days('o_orderkey % 30')}"
    return f"""
    select *, case when assertion_class = 'observed_event' then valid_start end as event_at from (
        select 'r-' || cast(o_orderkey as varchar(20)) as revision_id, 'a-' || cast(o_custkey as varchar(20)) as assertion_id,
            'case-' || cast(o_custkey % 4 as varchar(20)) as case_id, 'c-' || cast(o_custkey as varchar(20)) as subject_id,
            'n-' || cast(c_nationkey as varchar(20)) as object_id, 's-' || cast(o_orderkey % 25 as varchar(20)) as source_id, o_orderstatus as predicate,
            case o_orderkey % 5 when 0 then 'observed_event' when 1 then 'reported_relationship' when 2 then 'inferred_relationship' when 3 then 'state' else 'hypothesis' end as assertion_class,
            {label} as handling_label, {fields} as restrictions, cast(o_orderkey % 100 as double) / 100 as confidence,
            o_orderdate as valid_start, case when o_orderkey % 11 <> 0 then o_orderdate + {d.days('60')} end as valid_end,
            {start} as recorded_start, lead({start}) over w as recorded_end, lag('r-' || cast(o_orderkey as varchar(20))) over w as supersedes
        from {{orders}} join {{customer}} on o_custkey = c_custkey
        window w as (partition by o_custkey order by {start}, o_orderkey)) x
    where recorded_end is null or recorded_end > recorded_start"""


_ENDS = """'acct-' || cast(o_custkey as varchar(20)) as origin, 'acct-' || cast(l_suppkey as varchar(20)) as destination, 'account' as origin_kind, 'account' as destination_kind,
        case when l_linenumber = 7 then 0.0 else round(l_extendedprice) end as amount,
        case l_returnflag when 'A' then 'transfer' when 'N' then 'cash withdrawal' else 'device login' end as type,
        case o_orderpriority when '1-URGENT' then case when l_quantity > 45 then 'refund' else 'urgent' end when '2-HIGH' then 'goods' else 'plain' end as description,
        """


def _payments(d: Dialect) -> str:
    """Transactions without their numbers, which take a pass of their own."""
    return f"""
    select 't-' || cast(l_orderkey as varchar(20)) || '-' || cast(l_linenumber as varchar(20)) as id, l_shipdate as at_time,
        {_ENDS}substr(cast(l_shipdate as varchar(30)), 1, 7) as month
    from {{lineitem}} l join {{orders}} on l_orderkey = o_orderkey"""


def _transactions(d: Dialect) -> str:
    """Rows are numbered within ranges of order keys, after those of the ranges before."""
    half = d.half("l_orderkey", 500)
    semi = "semi join" if d.duck else "left semi join"
    return f"""
    select 't-' || cast(l_orderkey as varchar(20)) || '-' || cast(l_linenumber as varchar(20)) as id, l_shipdate as at_time,
        {_ENDS}row_number() over (partition by range order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) + before as row_no,
        substr(cast(l_shipdate as varchar(30)), 1, 7) as month
    from (select *, {half} as range from {{lineitem}}) l join {{orders}} on l_orderkey = o_orderkey
    join (select range, cast(sum(n) over (order by range) - n as bigint) as before from (select {half} as range, count(*) as n from {{lineitem}} {semi} {{orders}} on l_orderkey = o_orderkey group by 1) c) b using (range)"""


def _edges(d: Dialect) -> str:
    return f"""
    select 'e-' || cast(o_orderkey as varchar(20)) as edge_id, 'r-' || cast(o_orderkey as varchar(20)) as revision_id, 'case-' || cast(o_custkey % 4 as varchar(20)) as case_id,
        'o-' || cast(o_orderkey as varchar(20)) as subject, 'g-' || substr(cast(o_orderdate as varchar(30)), 1, 10) || '-' || cast(c_nationkey as varchar(20)) as object,
        case o_orderstatus when 'F' then 'transfers' when 'O' then 'cashout' else 'infrastructure' end as relation, o_orderstatus as status, o_orderdate as ts,
        case o_orderkey % 3 when 0 then {d.array("'before'")} when 1 then {d.array("'after'")} else {d.array("'before'", "'after'")} end as periods,
        cast(o_orderkey % 100 as double) / 100 as confidence, case when o_orderkey % 50 <> 0 then 's-' || cast(o_orderkey % 25 as varchar(20)) end as source_id
    from {{orders}} join {{customer}} on o_custkey = c_custkey"""


def _nodes(d: Dialect) -> str:
    return """
    select subject as node_id, 'account' as type, 'Order ' || substr(subject, 3) as label from {edges}
    union select object, 'place', 'Group ' || substr(object, 3) from {edges}"""


def _memberships(d: Dialect) -> str:
    half = f"cast((extract(year from o_orderdate) - 1995) * 2 + case when extract(month from o_orderdate) > 6 then 1 else 0 end as int)"
    return f"""
    select distinct s as snapshot_index, n_name || case when s % 3 = 0 then '-' || cast(o_custkey % 2 as varchar(20)) else '' end as label,
        'c-' || cast(o_custkey as varchar(20)) as member, case when s % 5 = 4 then 0.6 else 0.9 end as confidence
    from (select {half} as s, o_custkey from {{orders}} where o_orderdate >= timestamp '1995-01-01 00:00:00') x
    join {{customer}} on o_custkey = c_custkey join {{nation}} on c_nationkey = n_nationkey"""


def _evidence(d: Dialect) -> str:
    return f"""
    select 'i-' || cast(o_custkey as varchar(20)) as item_id, 'd-' || cast(l_orderkey as varchar(20)) as record_id, l_linenumber as version,
        timestamp '2000-01-01 00:00:00' as as_of, min(o_orderdate) as observed_at, min(l_shipdate) as recorded_at,
        case when l_orderkey % 7 <> 0 then min(l_discount) * 10 end as quality, case when l_orderkey % 5 <> 0 then min(l_tax) * 10 end as corroboration,
        min(l_quantity) / 50 as change, case when l_linenumber % 4 <> 0 then max(l_discount) * 10 end as coverage
    from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey group by o_custkey, l_orderkey, l_linenumber"""


def _publications(d: Dialect) -> str:
    return f"""
    select 'p-' || cast(o_orderkey as varchar(20)) as publication_id, 'case-' || cast(o_custkey % 4 as varchar(20)) as case_id, 'k-' || cast(o_custkey as varchar(20)) as result_key,
        o_orderdate as published_at, o_orderkey as k from {{orders}}"""


def _dependencies(d: Dialect) -> str:
    return f"""
    select 'p-' || cast(o_orderkey as varchar(20)) as publication_id, case when o_orderkey > 0 then 'publication' else 'revision' end as kind,
        case when o_orderkey > 0 then 'p-' || cast({d.half('o_orderkey', 2)} as varchar(20)) else 'r-0' end as target_id, 1 as target_version from {{orders}}"""


def _predictions(d: Dialect) -> str:
    return "select d.doc_id as id, least(1.0, d.n_chars / 10000.0e0) as score, cast(l.quality as double) as label from {documents} d join {labels} l on d.doc_id = l.doc_id"


def _parts(d: Dialect) -> str:
    return "select 'part-' || cast(p_partkey as varchar(20)) as node_id, p_type as type, p_name as label from {part}"


def _grants(d: Dialect) -> str:
    return f"""
    select 'gr-' || cast(o_orderkey as varchar(20)) as grant_id, 'u-' || cast(o_custkey as varchar(20)) as actor_id, 'case-' || cast(o_custkey % 4 as varchar(20)) as case_id,
        {d.array("'review'", "case when o_orderkey % 2 = 0 then 'audit' else 'export' end")} as purposes, case when o_orderkey % 10 = 0 then 'v1' else 'v2' end as policy_version,
        o_orderdate as issued_at, o_orderdate + {d.days('400')} as expires_at, {d.array("'open'", "case when o_orderkey % 3 = 0 then 'internal' else 'restricted' end")} as labels,
        {d.array("'device'")} as fields from {{orders}}"""


def _requests(d: Dialect) -> str:
    return f"""
    select 'q-' || cast(c_custkey as varchar(20)) as request_id, 'u-' || cast(c_custkey as varchar(20)) as actor_id, 'case-' || cast(c_custkey % 4 as varchar(20)) as case_id,
        case when c_custkey % 3 = 0 then 'audit' else 'review' end as purpose, 'v2' as policy_version, timestamp '1998-06-01 00:00:00' as asked_at,
        {d.array("'open'", "'internal'")} as labels, {d.array("'amount'", "'device'")} as fields from {{customer}}"""


def _revocations(d: Dialect) -> str:
    return f"select grant_id, issued_at + {d.days('100')} as revoked_at from {{grants}} where policy_version = 'v2' and substr(grant_id, length(grant_id), 1) = '4'"


RECIPES = {
    "revisions": _revisions,
    "transactions": _transactions,
    "edges": _edges,
    "nodes": _nodes,
    "memberships": _memberships,
    "evidence": _evidence,
    "publications": _publications,
    "dependencies": _dependencies,
    "predictions": _predictions,
    "parts": _parts,
    "grants": _grants,
    "requests": _requests,
    "revocations": _revocations,
}


def _used(recipe: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", recipe)))


#: Tables that hold another's columns without those that take a pass of their own.
PARTS = {"payments": ("transactions", _payments)}

#: Domain tables that were written once, by folder of the driver's tables and name.
STAGED: dict[tuple[str, str], DataFrame] = {}


def stage(spark: SparkSession, sf_dir: str) -> None:
    """Write every domain table to the shared folder; later queries of this session read it instead of deriving it again."""
    for name in RECIPES:
        STAGED[sf_dir, name] = staged(view(spark, sf_dir, name))


#: Keys by which large tables are dealt for their join.
KEYED = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def parts(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> int | None:
    """Partitions for tables with a row for each of a driver's table, where there are more than the session's number suits."""
    return parts_for(view(spark, sf_dir, name))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table, or one of the driver's, as a DataFrame."""
    if (sf_dir, name) in STAGED and STAGED[sf_dir, name].sparkSession is spark:
        return STAGED[sf_dir, name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in PARTS and (sf_dir, PARTS[name][0]) in STAGED:
        return view(spark, sf_dir, PARTS[name][0])
    recipe = (PARTS[name][1] if name in PARTS else RECIPES[name])(SPARK)
    tables = {t: view(spark, sf_dir, t) for t in _used(recipe)}
    if "lineitem" in tables and (n := parts(spark, sf_dir)):
        tables = {t: dealt(df, KEYED[t], parts=n) for t, df in tables.items()}
    out = spark.sql(recipe.replace("varchar(20)", "string").replace("varchar(30)", "string"), **tables)
    return out.withColumnRenamed("at_time", "at").withColumnRenamed("asked_at", "at")


def duck(sql: str, *names: str) -> str:
    """DuckDB text of ``sql`` with the domain tables it names (in order of use) as common table expressions."""
    todo, order = list(names), []
    while todo:
        n = todo.pop(0)
        if n in RECIPES:
            order = [n, *[x for x in order if x != n]]
            todo += [x for x in _used(RECIPES[n](DUCK)) if x in RECIPES]
    parts = [f"{n} as ({re.sub(r'[{](\w+)[}]', r'\1', RECIPES[n](DUCK))})" for n in order]
    return f"with recursive {', '.join(parts)} {sql}" if parts else sql
