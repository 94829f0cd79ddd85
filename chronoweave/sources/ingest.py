"""Readers of uploads and interchange files, and writers that repeat safely."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import WHITE
from ..functions.staging import numbered

# Names under which uploads give each field.
ALIASES = {
    "id": ("transaction_id", "transactionid", "tx_id", "id", "reference"),
    "at": ("timestamp", "datetime", "date_time", "transaction_time", "date", "time", "at"),
    "origin": ("origin_id", "origin", "source", "source_id", "from", "from_account", "account_origin", "person_origin_id"),
    "origin_kind": ("origin_kind", "origin_type", "source_type", "from_type"),
    "destination": ("destination_id", "destination", "target", "target_id", "to", "to_account", "account_destination", "person_destination_id"),
    "destination_kind": ("destination_kind", "destination_type", "target_type", "to_type"),
    "amount": ("amount", "value", "transaction_amount"),
    "currency": ("currency", "ccy"),
    "direction": ("direction", "flow_direction", "debit_credit", "dr_cr"),
    "type": ("type", "transaction_type", "description_type", "category"),
    "description": ("description", "memo", "narrative", "details", "concept"),
    "expected_account_id": ("expected_account_id", "label_account_id", "ground_truth_account_id"),
    "expected_review_priority": ("expected_review_priority", "label_review_priority", "ground_truth_review_priority"),
}


def header(name: str) -> str:
    """Trimmed, lower case, blanks and hyphens as underscores."""
    import re

    return re.sub(r"[\s-]+", "_", (name or "").strip().lower())


def named(df: DataFrame) -> DataFrame:
    return df.toDF(*[header(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed text; short rows are padded with empty text; blank lines are dropped."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue=None, inferSchema=False)
    rows = named(raw)
    return rows.select(*[F.btrim(F.coalesce(F.col(c), F.lit("")), F.lit(WHITE)).alias(c) for c in rows.columns])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of an array or of ``{"transactions": [...]}``, flattened, all columns as text; an unreadable file is one row of ``_corrupt_record``."""
    raw = spark.read.json(path, multiLine=True, primitivesAsString=True, columnNameOfCorruptRecord="_corrupt_record")
    if "transactions" in raw.columns:
        raw = raw.select(F.explode("transactions").alias("x")).select("x.*")
    return named(flattened(raw)).na.fill("")


def flattened(df: DataFrame) -> DataFrame:
    """Nested fields as ``outer_inner`` columns; arrays as text; null as empty text."""

    def leaves(schema: T.StructType, prefix: str, path: str) -> list[Column]:
        out = []
        for f in schema.fields:
            name, at = f"{prefix}{f.name}", f"{path}`{f.name}`"
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, f"{name}_", f"{at}.")
            elif isinstance(f.dataType, T.ArrayType):
                simple = isinstance(f.dataType.elementType, T.StringType)
                out.append(F.coalesce(F.array_join(at, ",") if simple else F.to_json(F.col(at)), F.lit("")).alias(name))
            else:
                out.append(F.coalesce(F.col(at).cast("string"), F.lit("")).alias(name))
        return out

    return df.select(*leaves(df.schema, "", ""))


def read_transactions(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:  # noqa: A002
    """Rows of an upload with ``row_no`` from 0 in file order (one file: a split file has no order of its own)."""
    rows = read_json(spark, path) if format == "json" else read_csv(spark, path)
    return numbered(rows)


def infer_mapping(headers: Sequence[str], overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """Field to column: an override that exists, else the first header in file order among the field's names."""
    found = {}
    for field, names in ALIASES.items():
        first = next((h for h in headers if header(h) in names), None)
        wanted = (overrides or {}).get(field)
        chosen = wanted if wanted in headers else first
        if chosen:
            found[field] = chosen
    return found


def read_interchange(spark: SparkSession, path: str) -> DataFrame:
    """Revisions of an interchange file: its relationships and temporal corrections; a source is acquired when the row was recorded."""
    raw = spark.read.json(path, multiLine=True)
    rows = raw.select(F.explode("relationships").alias("x")).select("x.*")
    if "temporalCorrections" in raw.columns:
        rows = rows.unionByName(raw.select(F.explode("temporalCorrections").alias("x")).select("x.*"), allowMissingColumns=True)
    at = lambda c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz") if c in rows.columns else F.lit(None).cast("timestamp_ntz")
    text = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    return rows.select(
        text("revisionId").alias("revision_id"),
        text("assertionId").alias("assertion_id"),
        text("subject").alias("subject_id"),
        text("object").alias("object_id"),
        text("sourceId").alias("source_id"),
        text("assertionClass").alias("assertion_class"),
        text("handlingLabel").alias("handling_label"),
        (F.coalesce("fieldRestrictions", F.expr("cast(array() as array<string>)")) if "fieldRestrictions" in rows.columns else F.expr("cast(array() as array<string>)")).alias("restrictions"),
        at("validStart").alias("valid_start"),
        at("validEnd").alias("valid_end"),
        at("recordedStart").alias("recorded_start"),
        at("recordedEnd").alias("recorded_end"),
        at("eventAt").alias("event_at"),
        text("supersedesRevisionId").alias("supersedes"),
        at("recordedStart").alias("acquired_at"),
    )


def read_scenario(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Memberships of a lineage scenario; snapshots are in array order; confidence is 1 unless given."""
    raw = spark.read.json(path, multiLine=True).select(F.posexplode(f"lineageScenarios.{name}").alias("snapshot_index", "s"))
    fields = raw.schema["s"].dataType["communities"].dataType.elementType.names
    c = raw.select("snapshot_index", F.explode("s.communities").alias("c"))
    confidence = F.coalesce(F.col("c.confidence").cast("double"), F.lit(1.0)) if "confidence" in fields else F.lit(1.0)
    return c.select("snapshot_index", F.col("c.label").alias("label"), F.explode("c.members").alias("member"), confidence.alias("confidence"))


def unseen(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet, one per key; appending them twice adds nothing."""
    return new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def append_once(new: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append to a Parquet table what it does not hold."""
    spark = new.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as missing:  # no table yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        new.dropDuplicates(list(keys)).write.parquet(path)
        return
    unseen(new, stored, keys).write.mode("append").parquet(path)


def first_per_key(rows: DataFrame, keys: Sequence[str], order: str = "row_no") -> DataFrame:
    """The first row of each key in input order."""
    least = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(least)).filter("__n = 1").drop("__n")


NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def uuid5(kind: str, *keys: str, namespace: str = NAMESPACE) -> Column:
    """Name-based UUID (version 5) of a kind and key columns; null if a key is null or empty.

    The name is the kind, U+001E, and the keys joined by U+001F, doubled where it occurs in a key.
    """
    parts = [F.replace(F.col(k).cast("string"), F.lit("\u001f"), F.lit("\u001f\u001f")) for k in keys]
    name = F.concat(F.lit(kind + "\u001e"), F.array_join(F.array(*parts), "\u001f"))
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    text = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    usable = F.lit(True)
    for k in keys:
        usable = usable & (F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    return F.when(usable, text)


def stored_revisions(revisions: DataFrame) -> DataFrame:
    """Revisions as stored: observed events are points, uncertain ones unknown, all others asserted."""
    return revisions.withColumns(
        {"validity_kind": F.when(F.col("event_at").isNotNull(), "point").otherwise("range"), "status": F.when(F.col("status") == "uncertain", "unknown").otherwise("asserted")}
    )


def stable_json(*columns: str) -> Column:
    """JSON text with its fields in name order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))
