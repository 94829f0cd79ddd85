"""Row validation of transaction imports: every row keeps all reasons against it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import WHITE, reasons
from ..functions.staging import staged

# Fixed values of the import contract.
REQUIRED = ("id", "at", "origin", "destination", "amount", "currency", "type")
CURRENCIES = ("USD", "EUR", "GBP", "PEN", "MXN", "COP", "BRL", "CAD", "N/A")
DIRECTIONS = ("", "inbound", "outbound", "credit", "debit", "context", "transfer")
KINDS = ("person", "account", "device", "ip", "place", "organization")
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._:-]{1,63}$"
ZONE_PATTERN = r"(?i)(z|[+-][0-9]{2}:?[0-9]{2})$"
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "1", "review-priority", "positive"), ("false", "no", "0", "background", "negative")


NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def clean(column: str) -> Column:
    return F.btrim(F.coalesce(F.col(column), F.lit("")), F.lit(WHITE))


def zoned_time(column: str) -> Column:
    """The UTC instant of a text that ends in Z or an offset; null without one or if unreadable."""
    return F.when(clean(column).rlike(ZONE_PATTERN), F.try_to_timestamp(clean(column)))


def amount(column: str) -> Column:
    """Commas stripped; an empty text is 0; decimal digits with an optional exponent, or hex, octal or binary ones after 0x, 0o, 0b; null if no finite number."""
    text = F.btrim(F.replace(F.coalesce(F.col(column), F.lit("")), F.lit(","), F.lit("")), F.lit(WHITE))
    value = F.when(text == "", 0.0).when(text.rlike(NUMBER), text.try_cast("double"))
    for letter, base, digits in (("x", 16, "0-9a-f"), ("o", 8, "0-7"), ("b", 2, "01")):
        value = value.when(text.rlike(f"(?i)^0{letter}[{digits}]+$"), F.conv(F.substring(text, 3, 64), base, 10).try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def direction(column: str) -> Column:
    d = F.lower(clean(column))
    return F.when(d.isin("cr", "credit"), "credit").when(d.isin("dr", "debit"), "debit").when(d.isin("in", "incoming", "inbound"), "inbound").when(d.isin("out", "outgoing", "outbound"), "outbound").otherwise(d)


def kind(column: str, fallback: str) -> Column:
    """Kind of an entity by its own word, else by what the word, or the id where there is none, contains."""
    k = F.lower(F.when(clean(column) != "", clean(column)).otherwise(clean(fallback)))
    person = k.contains("person") | k.startswith("p-") | k.startswith("victim")
    return F.when(k.isin(*KINDS), k).when(k.contains("device"), "device").when(k.contains("ip"), "place").when(person, "person").otherwise("account")


def truth(column: str) -> Column:
    t = F.lower(clean(column))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def zone(column: str) -> Column:
    return F.upper(F.regexp_extract(clean(column), ZONE_PATTERN, 1))


def validated(raw: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Canonical columns, ``row_number`` and ``reasons`` for every raw row (``row_no`` from 0 in file order).

    ``mapping``: canonical field to column. A repeated id counts against all but its first row, whether that was accepted or not.
    Rows whose ``reasons`` are empty are the accepted ones.
    """
    rows = raw.select("row_no", *[F.col(mapping[k]).cast("string").alias(k) if k in mapping else F.lit(None).cast("string").alias(k) for k in (*REQUIRED, "origin_kind", "destination_kind", "direction", "description", "expected_account_id", "expected_review_priority")])
    missing = [k for k in REQUIRED if k not in mapping]
    rows = rows.withColumn("row_number", F.col("row_no") + 2)
    rows = rows.select(
        "row_number",
        "row_no",
        F.when(F.lit("id" in mapping), clean("id")).otherwise(F.concat(F.lit("row-"), F.col("row_number").cast("string"))).alias("id"),
        zoned_time("at").alias("at"),
        zone("at").alias("timezone"),
        clean("origin").alias("origin"),
        clean("destination").alias("destination"),
        kind("origin_kind", "origin").alias("origin_kind"),
        kind("destination_kind", "destination").alias("destination_kind"),
        F.when(F.lit("amount" in mapping), amount("amount")).alias("amount"),
        F.upper(clean("currency")).alias("currency"),
        direction("direction").alias("direction"),
        clean("type").alias("type"),
        clean("description").alias("description"),
        clean("expected_account_id").alias("expected_account_id"),
        truth("expected_review_priority").alias("expected_review_priority"),
    )
    repeated = F.row_number().over(Window.partitionBy("id").orderBy("row_no")) > 1
    rows = rows.withColumn("__again", repeated)
    c = F.col
    # The reasons' texts and their order.
    why = reasons(
        (F.lit(bool(missing)), "Missing required mapped fields: " + ", ".join(missing)),
        (c("at").isNull(), "Invalid timestamp or missing explicit timezone"),
        (c("amount").isNull(), "Invalid amount"),
        (c("currency") == "", "Missing currency"),
        ((c("currency") != "") & ~c("currency").isin(*CURRENCIES), F.concat(F.lit("Unsupported currency: "), c("currency"))),
        (c("origin") == "", "Missing origin"),
        (c("destination") == "", "Missing destination"),
        ((c("origin") != "") & ~c("origin").rlike(ID_PATTERN), "Invalid origin identity"),
        ((c("destination") != "") & ~c("destination").rlike(ID_PATTERN), "Invalid destination identity"),
        ((c("origin") != "") & (c("origin") == c("destination")) & ~c("amount").eqNullSafe(0.0), "Origin and destination are identical for money movement"),
        (~c("direction").isin(*DIRECTIONS), F.concat(F.lit("Unsupported direction: "), c("direction"))),
        ((c("amount") == 0) & (c("currency") != "N/A"), "Zero-amount context rows must use N/A currency"),
        (c("amount") < 0, "Amount cannot be negative"),
        (c("type") == "", "Missing transaction type"),
        (c("id") == "", "Missing transaction id"),
        ((c("id") != "") & ~c("id").rlike(ID_PATTERN), "Invalid transaction id"),
        (c("__again"), "Duplicate transaction id"),
    )
    return rows.withColumn("reasons", why).drop("__again")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("reasons") == 0)


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("reasons") > 0)


def import_summary(rows: DataFrame) -> DataFrame:
    """One row: total, accepted, rejected and the accepted share in percent."""
    ok = F.size("reasons") == 0
    sums = rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))
    return sums.withColumn("coverage", F.round(100.0 * F.col("accepted") / F.greatest(F.lit(1), F.col("total"))))


def interchange_faults(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``fault, id``: repeated relationship or revision ids, and ends that no node has."""
    twice = lambda key, name: edges.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("fault"), "id")
    ids = nodes.select(F.col("node_id").alias("id")).distinct()
    lost = lambda key, name: edges.select(F.col(key).alias("id")).distinct().join(ids, "id", "left_anti").select(F.lit(name).alias("fault"), "id")
    return twice("edge_id", "duplicate_relationship").unionByName(twice("revision_id", "duplicate_revision")).unionByName(lost("subject", "unknown_subject")).unionByName(lost("object", "unknown_object"))


def revision_faults(revisions: DataFrame) -> DataFrame:
    """``revision_id, reasons`` of revisions that break a domain constraint."""
    c = F.col
    why = reasons(
        (~c("confidence").between(0, 1), "confidence outside 0..1"),
        (c("valid_end") <= c("valid_start"), "empty valid interval"),
        (c("recorded_end") <= c("recorded_start"), "empty recorded interval"),
        ((c("assertion_class") == "observed_event") & c("event_at").isNull(), "observed event without time"),
        (c("event_at").isNotNull() & ((c("event_at") < c("valid_start")) | (c("event_at") >= c("valid_end"))), "event outside valid interval"),
    )
    return revisions.select("revision_id", why.alias("reasons")).filter(F.size("reasons") > 0)


# Attributes that may never reach a score, and other names for them.
PROTECTED = (
    "age", "birthdate", "citizenship", "color", "disability", "ethnicity", "familial_status", "gender", "gender_identity",
    "genetic_information", "marital_status", "national_origin", "pregnancy", "race", "religion", "sex", "sexual_orientation", "veteran_status",
)
PROTECTED_ALIASES = ("date_of_birth", "dob", "native_language", "place_of_birth")


def protected_attributes(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id, path`` of every key, at any nesting, whose normalized name is a protected attribute; must be empty.

    A level's values are written as texts and the next level starts from them, until no row holds an object or array.
    """
    level = rows.select(F.col(id_col).alias("id"), F.lit("").alias("at"), F.col(json_col).alias("j"))
    found = None
    while True:
        level = level.withColumn("v", F.try_parse_json("j"))
        level = level.withColumn("o", F.expr("try_variant_get(v, '$', 'map<string, variant>')")).withColumn("l", F.expr("try_variant_get(v, '$', 'array<variant>')"))
        keyed = level.select("id", "at", F.explode("o").alias("k", "x")).select("id", F.concat_ws("/", "at", "k").alias("at"), "k", F.col("x").alias("v"))
        inside = level.select("id", "at", F.explode("l").alias("v"))
        name = F.regexp_replace(F.regexp_replace(F.lower("k"), "[^a-z0-9]+", "_"), "^_|_$", "")
        down = keyed.select("id", "at", name.isin(*PROTECTED, *PROTECTED_ALIASES).alias("hit"), "v").unionByName(inside.select("id", "at", F.lit(False).alias("hit"), "v"))
        down = staged(down.select("id", "at", "hit", F.to_json("v").alias("j")))
        hit = down.filter("hit").select("id", F.col("at").alias("path"))
        found = hit if found is None else found.unionByName(hit)
        level = down.filter("j like '{%' or j like '[%'").select("id", "at", "j")
        if level.isEmpty():
            return found.distinct()
