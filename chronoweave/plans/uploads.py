"""Queries over files: tables written as uploads or interchange files to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import text_of
from ..functions.staging import shared_dir
from ..sources import ingest, rules
from .registry import query
from .views import view


def _path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _csv(spark: SparkSession, sf: str) -> str:
    """Transactions as a CSV upload under headers as users write them, with quotes, commas and blanks."""
    path = _path(spark, "csv")
    t = view(spark, sf, "transactions")
    rows = t.select(
        F.col("id").alias(" Transaction ID "),
        F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Date-Time"),
        F.col("origin").alias("From Account"),
        F.col("destination").alias("To"),
        F.col("amount").cast("long").cast("string").alias("Amount"),
        F.lit("usd").alias("CCY"),
        F.concat(F.lit('say "hi", '), F.col("description"), F.lit(" ")).alias("Memo"),
        F.col("type").alias("Category"),
        F.when(F.col("amount") > 0, F.col("month")).alias("Other Reference"),
    )
    rows.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


_ISO = "strftime(at_time, '%Y-%m-%dT%H:%M:%SZ')"


@query(f"select id as transaction_id, {_ISO} as date_time, cast(cast(amount as bigint) as varchar) as amount, 'say \"hi\", ' || description as memo, case when amount > 0 then month else '' end as other_reference from transactions", "transactions")
def a1_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A1, A5: quoted fields, doubled quotes, blanks around texts, empty fields, headers made alike."""
    return ingest.read_csv(spark, _csv(spark, sf)).select("transaction_id", "date_time", "amount", "memo", "other_reference")


def _per_file(rows: DataFrame, build, path: str) -> None:
    """One JSON text for each group of about 4,000 ``rows`` (``k``), each a file of its own."""
    groups = rows.withColumn("__file", F.expr("pmod(k, greatest(1, 1 + n div 4000))")).groupBy("__file").agg(build.alias("value"))
    groups.write.partitionBy("__file").text(path)


def _counted(rows: DataFrame, k) -> DataFrame:
    return rows.withColumns({"k": k, "n": F.lit(rows.count())})


@query("select 't-' || cast(o_orderkey as varchar) as id, 'c-' || cast(o_custkey as varchar) as who_id, o_orderstatus as who_place_kind, o_orderpriority || ',' || o_orderstatus as tags, '[{\"n\":\"' || cast(o_orderkey % 7 as varchar) || '\"}]' as lines, case when o_orderkey % 3 = 0 then '' else 'x' end as note from orders")
def a2_json_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A2, A3: records below ``transactions``, nested fields as ``outer_inner``, lists of texts by commas, other lists as JSON, nulls as empty texts."""
    o = view(spark, sf, "orders")
    record = F.struct(
        F.expr("'t-' || o_orderkey").alias("id"),
        F.struct(F.expr("'c-' || o_custkey").alias("id"), F.struct(F.col("o_orderstatus").alias("kind")).alias("place")).alias("who"),
        F.array("o_orderpriority", "o_orderstatus").alias("tags"),
        F.array(F.struct((F.col("o_orderkey") % 7).alias("n"))).alias("lines"),
        F.when(F.col("o_orderkey") % 3 != 0, "x").alias("note"),
    )
    path = _path(spark, "json")
    _per_file(_counted(o, F.col("o_orderkey")), F.to_json(F.struct(F.collect_list(record).alias("transactions"))), path)
    return ingest.read_json(spark, path).select("id", "who_id", "who_place_kind", "tags", "lines", "note")


@query("select count(*) as n, cast(0 as bigint) as least, count(*) - 1 as most, count(*) as numbers from transactions", "transactions")
def a4_format_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of an upload numbered from 0 without gaps, in any number of partitions."""
    rows = ingest.read_transactions(spark, _csv(spark, sf), "csv")
    return rows.agg(F.count("*").alias("n"), F.min("row_no").alias("least"), F.max("row_no").alias("most"), F.count_distinct("row_no").alias("numbers"))


@query(f"select id, origin, destination, amount, 'USD' as currency, description as type, at_time as at, case when amount = 0 then 'Zero-amount context rows must use N/A currency' when origin = destination then 'Origin and destination are identical for money movement' else '' end as reasons from transactions", "transactions")
def a6_mapped_upload(spark: SparkSession, sf: str) -> DataFrame:
    """Fields found by their headers, one of them overridden, and the rows validated (which of equal ids stands first is left to the files)."""
    rows = ingest.read_transactions(spark, _csv(spark, sf), "csv").withColumn("narrative_type", F.trim(F.replace(F.col("memo"), F.lit('say "hi", '), F.lit(""))))
    mapping = ingest.infer_mapping([c for c in rows.columns if c != "row_no"], {"type": "narrative_type", "currency": "no such column"})
    out = rules.validated(rows, mapping)
    return out.select("id", "origin", "destination", "amount", "currency", "type", F.col("at").cast("timestamp_ntz").alias("at"), text_of(F.array_remove("reasons", "Duplicate transaction id")).alias("reasons"))


@query("select revision_id, assertion_id, subject_id, object_id, source_id, assertion_class, handling_label, array_to_string(restrictions, ',') as restrictions, valid_start, valid_end, recorded_start, recorded_end, event_at, supersedes, recorded_start as acquired_at from revisions", "revisions")
def a8_interchange_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Relationships and temporal corrections of interchange files as one table of revisions."""
    r = view(spark, sf, "revisions")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    names = {"revisionId": "revision_id", "assertionId": "assertion_id", "subject": "subject_id", "object": "object_id", "sourceId": "source_id", "assertionClass": "assertion_class", "handlingLabel": "handling_label", "fieldRestrictions": "restrictions", "supersedesRevisionId": "supersedes"}
    times = {"validStart": "valid_start", "validEnd": "valid_end", "recordedStart": "recorded_start", "recordedEnd": "recorded_end", "eventAt": "event_at"}
    record = F.struct(*(F.col(c).alias(k) for k, c in names.items()), *(iso(c).alias(k) for k, c in times.items()))
    new = F.col("supersedes").isNull()
    both = F.struct(F.array_compact(F.collect_list(F.when(new, record))).alias("relationships"), F.array_compact(F.collect_list(F.when(~new, record))).alias("temporalCorrections"))
    path = _path(spark, "interchange")
    _per_file(_counted(r, F.crc32("revision_id")), F.to_json(both), path)
    return ingest.read_interchange(spark, path).withColumn("restrictions", text_of("restrictions"))


@query("select snapshot_index, label, member, confidence from memberships", "memberships")
def a9_scenario_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Memberships of lineage scenarios; a snapshot's number is its place in the file, a confidence left out is 1."""
    m = _counted(view(spark, sf, "memberships"), F.crc32("member")).withColumn("__part", F.expr("pmod(k, greatest(1, 1 + n div 4000))"))
    last = m.agg(F.max("snapshot_index")).first()[0]
    community = F.struct("label", F.col("confidence"), "members")
    each = m.groupBy("__part", "snapshot_index", "label", "confidence").agg(F.collect_list("member").alias("members"))
    shots = each.groupBy("__part", "snapshot_index").agg(F.collect_list(community).alias("communities"))
    by_place = F.map_from_entries(F.collect_list(F.struct("snapshot_index", "communities")))
    found = shots.groupBy("__part").agg(by_place.alias("m"))
    places = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.struct(F.coalesce(F.col("m")[i], F.expr("cast(array() as array<struct<label:string,confidence:double,members:array<string>>>)")).alias("communities")))
    text = F.to_json(F.struct(F.struct(places.alias("s")).alias("lineageScenarios")))
    path = _path(spark, "scenario")
    found.select("__part", text.alias("value")).write.partitionBy("__part").text(path)
    return ingest.read_scenario(spark, path, "s")


_ODD = """, odd as (select row_no + 2 as row_number, case row_no % 4 when 0 then '' when 1 then '+02:00' else 'Z' end as timezone,
        case row_no % 7 when 0 then 'device' when 1 then 'place' when 2 then 'person' when 3 then 'organization' when 4 then 'person' when 5 then 'ip' else 'account' end as origin_kind,
        case row_no % 5 when 0 then true when 1 then false when 2 then true when 3 then false end as expected_review_priority,
        case row_no % 6 when 1 then 12.5 when 2 then 31.0 when 5 then 1500.0 end as amount, origin = destination as itself from transactions)
    select row_number, 'row-' || cast(row_number as varchar) as id, timezone, origin_kind, 'account' as destination_kind, expected_review_priority, amount,
        'Missing required mapped fields: id, currency, type' || case when timezone = '' then ',Invalid timestamp or missing explicit timezone' else '' end || case when amount is null then ',Invalid amount' else '' end || ',Missing currency' || case when itself then ',Origin and destination are identical for money movement' else '' end || ',Missing transaction type' as reasons from odd"""


@query(_ODD, "transactions")
def v12_unmapped_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Required fields without a column, numbers by row, kinds, labels and zones of every form, white space of every kind."""
    t = view(spark, sf, "transactions")
    raw = t.select(
        "row_no",
        F.concat(F.lit("\t"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.expr("case row_no % 4 when 0 then '' when 1 then '+02:00' else 'Z' end"), F.lit("\n")).alias("at"),
        F.concat(F.lit("\xa0"), "origin").alias("origin"),
        F.concat("destination", F.lit("\t")).alias("destination"),
        F.expr("case row_no % 7 when 0 then ' My Device 7' when 1 then 'shipping' when 2 then 'P-12' when 3 then 'Organization' when 4 then 'victim x' when 5 then 'IP' else '' end").alias("ok"),
        F.expr("case row_no % 5 when 0 then ' YES' when 1 then 'negative' when 2 then 'Review-Priority' when 3 then '0' else 'maybe' end").alias("label"),
        F.expr("case row_no % 6 when 0 then '12d' when 1 then '\t12.5 ' when 2 then '0x1F' when 3 then 'Infinity' when 4 then '1 2' else '1,5e2,' end").alias("amount"),
    )
    mapping = {"at": "at", "origin": "origin", "destination": "destination", "amount": "amount", "origin_kind": "ok", "expected_review_priority": "label"}
    rows = rules.validated(raw, mapping)
    return rows.select("row_number", "id", "timezone", "origin_kind", "destination_kind", "expected_review_priority", "amount", text_of("reasons").alias("reasons"))


@query("select event_id as id, '/a/b/c/d/e/f/g/Date-of-Birth' as path from events where event_id % 6 = 0 union all select event_id, unnest(['/list/RACE', '/Sex ']) from events where event_id % 6 = 1")
def v21_protected_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of protected attributes at any depth, in objects and lists, whatever stands between their words."""
    deep = '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"Date-of-Birth":"x"}}}}}}}}'
    listed, clean = '{"list":[[{"RACE":1,"ok":2}],[[]]],"Sex ":"f"}', '{"agenda":{"racecar":[1,"race"]}}'
    props = F.expr(f"case event_id % 6 when 0 then '{deep}' when 1 then '{listed}' when 2 then '{clean}' when 3 then 'no json' else props end").alias("props")
    return rules.protected_attributes(view(spark, sf, "events").select("event_id", props), "event_id", "props")
