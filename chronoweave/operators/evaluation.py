"""Predictive evaluation: leakage, folds, gates, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import reasons, text_of

# Fixed values of the gates.
TIME_FIELDS = (
    ("event_time", "future event dependency"),
    ("known_at", "future known-at dependency"),
    ("label_known_at", "future label dependency"),
    ("scaler_fit_at", "future scaler fit"),
    ("feature_window_end", "future feature window"),
)
RED_TEAM = (
    ("legitimate-high-degree", 0.55),
    ("delayed-reports", 0.60),
    ("duplicated-entities", 0.58),
    ("missing-data", 0.62),
    ("smurfing", 0.65),
    ("circular-flows", 0.60),
    ("shared-infrastructure", 0.55),
)
GATES = {"precision_gain": 0.05, "calibration_error": 0.12, "hard_negative_rate": 0.2, "latency_ms": 150, "explanation_coverage": 0.85, "robustness": 0.65}
BLOCKED_CLAIMS = ("state of the art|sota", "pretrained", "production prediction|production model", "calibrated", "profitability")


def leakage(dependencies: DataFrame, cutoff: str) -> DataFrame:
    """``id, field, value, reason`` of each time after the cutoff or unreadable; an unreadable cutoff is a violation itself."""
    at = F.try_to_timestamp(F.lit(cutoff))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.lit(m).alias("late")) for f, m in TIME_FIELDS if f in dependencies.columns])
    rows = dependencies.select("id", F.inline(fields)).filter("value is not null and value <> ''").withColumn("ts", F.try_to_timestamp("value"))
    why = F.when(F.col("ts").isNull(), F.concat(F.lit("invalid "), F.col("field"), F.lit(" timestamp"))).when(F.col("ts") > at, F.col("late"))
    found = rows.withColumn("reason", why).filter("reason is not null").select("id", "field", "value", "reason")
    bad = dependencies.sparkSession.range(1).filter(at.isNull()).select(F.lit("prediction-time").alias("id"), F.lit("prediction_time").alias("field"), F.lit(cutoff).alias("value"), F.lit("invalid prediction time").alias("reason"))
    return found.unionByName(bad)


def temporal_folds(events: DataFrame, horizon: int, step: int, train: int) -> DataFrame:
    """``fold, train_until, validate_until, population`` (times in seconds, expanding population up to the cutoff).

    ``events``: ``id, s``. Cutoffs run from the first event plus ``train`` in steps, before the last event; the
    population is a running count over cutoffs, so events are bucketed once and never paired with folds.
    """
    span = events.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    cuts = span.filter(F.col("lo") + train < F.col("hi")).select(F.posexplode(F.expr(f"sequence(lo + {train}, hi - 1, cast({step} as bigint))")).alias("k", "train_until"))
    lo = F.broadcast(span.select("lo"))
    # The first cutoff at or after the event.
    k = F.greatest(F.lit(0), F.ceil((F.col("s") - F.col("lo") - train) / step)).cast("int")
    per = events.crossJoin(lo).groupBy(k.alias("k")).agg(F.count("*").alias("n"))  # one row
    run = Window.partitionBy(F.lit(0)).orderBy("k")
    every = cuts.join(per, "k", "left").withColumn("population", F.sum(F.coalesce("n", F.lit(0))).over(run))
    return every.select((F.col("k") + 1).alias("fold"), "train_until", (F.col("train_until") + horizon).alias("validate_until"), "population")


def red_team(scores: DataFrame, scenarios: DataFrame) -> DataFrame:
    """``candidate, scenario, observed, allowed, passed`` for every candidate and scenario; a missing score is 0."""
    every = scores.select("candidate").distinct().crossJoin(F.broadcast(scenarios))  # a fixed list
    seen = every.join(scores, ["candidate", "scenario"], "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    return seen.select("candidate", "scenario", "observed", "allowed", (F.col("observed") <= F.col("allowed")).alias("passed"))


def hard_negative_table(candidates: DataFrame) -> DataFrame:
    return candidates.select("candidate", F.round(F.col("random_precision") - F.col("precision"), 3).alias("gap"), (F.col("hard_negative_rate") <= GATES["hard_negative_rate"]).alias("passed"))


def baseline_lift(candidates: DataFrame) -> DataFrame:
    """Candidates with the best baseline's precision and their lift over it."""
    best = candidates.filter("family = 'deterministic baseline'").agg(F.max("precision").alias("baseline"))
    return candidates.crossJoin(F.broadcast(best)).withColumn("lift", F.round(F.col("precision") - F.col("baseline"), 3))  # one row


def gate_panel(candidates: DataFrame, leaks: DataFrame, red: DataFrame) -> DataFrame:
    """``candidate, failures, status``; nothing is enabled by passing."""
    leaky = leaks.select(F.col("id").alias("candidate")).distinct().withColumn("leaky", F.lit(True))
    failed = red.groupBy("candidate").agg((~F.bool_and("passed")).alias("red_failed"))
    c = baseline_lift(candidates).join(leaky, "candidate", "left").join(failed, "candidate", "left")
    col = F.col
    why = reasons(
        (col("leaky"), "leakage gate failed"),
        ((col("family") != "deterministic baseline") & (col("precision") < col("baseline") + GATES["precision_gain"]), "does not beat deterministic baseline enough"),
        (col("calibration_error") > GATES["calibration_error"], "calibration error too high"),
        (col("hard_negative_rate") > GATES["hard_negative_rate"], "hard-negative false positives too high"),
        (col("latency_ms") > GATES["latency_ms"], "latency budget exceeded"),
        (col("explanation_coverage") < GATES["explanation_coverage"], "explanation coverage too low"),
        (col("robustness") < GATES["robustness"], "robustness gate failed"),
        (~col("overreliance").eqNullSafe("passed"), "analyst overreliance gate not passed"),
        (col("red_failed"), "red-team scenario gate failed"),
        (col("hard_negative_rate") > GATES["hard_negative_rate"], "hard-negative benchmark failed"),
    )
    return c.select("candidate", text_of(why).alias("failures"), F.when(F.size(why) == 0, "eligible").otherwise("blocked").alias("status"), F.lit(False).alias("enabled"))


def calibration_curve(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin of the clamped score: count, mean score, rate, absolute gap (4 decimals). Rows without finite score and label are skipped."""
    ok = predictions.filter("score is not null and label is not null and not isnan(score) and not isnan(label) and abs(score) < double('Infinity')").withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    at = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int")
    rows = ok.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_score"), F.round(F.avg("label"), 4).alias("rate"), F.sum((F.col("p") - F.col("label")) ** 2).alias("squares"))
    return rows.withColumn("gap", F.round(F.abs(F.col("mean_score") - F.col("rate")), 4))


def calibration_summary(curve: DataFrame) -> DataFrame:
    """One row: total, expected calibration error, Brier score, passed."""
    s = curve.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.sum(F.col("n") * F.col("gap")).alias("g"), F.sum("squares").alias("q"))
    ece = F.coalesce(F.round(F.col("g") / F.col("total"), 4), F.lit(0.0))
    return s.select("total", ece.alias("calibration_error"), F.round(F.col("q") / F.col("total"), 4).alias("brier"), ((F.col("total") > 0) & (ece <= GATES["calibration_error"])).alias("passed"))


def promotion(manifests: DataFrame) -> DataFrame:
    """Failures of each artifact manifest: missing parts, leakage, calibration, red team, study, prohibited target."""
    required = ("artifact_hash", "training_data_hash")
    gap = F.lit(False)
    for c in required:
        gap = gap | F.col(c).isNull() | (F.col(c) == "")
    valid = ~gap & F.col("leakage_safe") & F.col("calibrated") & F.col("red_team_passed")
    why = reasons((~valid, "trained artifact validation failed"), (~F.col("study").eqNullSafe("passed"), "representative overreliance study not passed"), (F.contains("target", F.lit("person-level guilt")), "prohibited target"))
    return manifests.select("candidate", text_of(why).alias("failures"), F.when(F.size(why) == 0, "eligible-for-supervised-pilot-only").otherwise("blocked-production-display").alias("decision"))


def claim_gate(runs: DataFrame) -> DataFrame:
    """Failures of benchmark runs: source note, declarations, and claims by pattern in their text."""
    c = F.col
    rules = [
        (c("benchmark_derived") & (F.coalesce("source_note", F.lit("")) == ""), "benchmark-derived run requires source note"),
        (~c("calibrated").eqNullSafe(False), "benchmark/local run must declare calibrated: false"),
        (~c("production_enabled").eqNullSafe(False), "production predictions must remain disabled"),
        *[(c("text").rlike(f"(?i){p}"), f"blocked claim: {p}") for p in BLOCKED_CLAIMS],
    ]
    why = reasons(*rules)
    return runs.select("run_id", text_of(why).alias("failures"), (F.size(why) == 0).alias("passed"))


def study_rates(sessions: DataFrame, least: int = 10) -> DataFrame:
    """One row: five rates of a reliance study and the rules it fails."""
    flags = ("safe_comprehension", "provenance_first", "abstention_safe", "unsupported_conclusion", "automation_bias")
    sums = sessions.agg(F.count("*").alias("total"), *[F.count_if(f).alias(f) for f in flags])
    rate = lambda f, none: F.when(F.col("total") > 0, F.col(f) / F.col("total")).otherwise(none)
    r = {f: rate(f, 0.0 if i < 3 else 1.0) for i, f in enumerate(flags)}
    why = reasons(
        (F.col("total") < least, "minimum representative sessions not met"),
        (r["safe_comprehension"] < 0.9, "safe comprehension below threshold"),
        (r["provenance_first"] < 0.8, "provenance inspection below threshold"),
        (r["abstention_safe"] < 1, "abstention misinterpreted by at least one participant"),
        (F.col("unsupported_conclusion") > 0, "unsupported conclusion observed"),
        (F.col("automation_bias") > 0, "automation-bias event observed"),
    )
    return sums.select("total", *[F.round(v, 6).alias(k) for k, v in r.items()], text_of(why).alias("failures"))


def percentile(column: str, *ps: float) -> list[Column]:
    """Exact percentiles by linear interpolation, as aggregate columns."""
    return [F.percentile(column, F.lit(p)).alias(f"p{round(p * 100)}") for p in ps]
