"""Account indicators over transactions: they order work for review and are no findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import reasons, seconds, text_of
from ..functions.staging import dealt, staged

# Patterns that explain an account's flows, points and cut-offs of the two scores.
HARD_NEGATIVES = (
    ("payroll|salary|wage", "payroll or salary hub pattern"),
    ("payment processor|processor|merchant|omnibus", "legitimate payment processor indicator"),
    ("refund|chargeback|reversal", "refund or reversal pattern"),
    ("batch|bulk|settlement", "batch transfer context"),
)
ONLY_INFRASTRUCTURE = "login|device|ip|shared infrastructure|branch"
INDICATORS = ("multiple inbound origins", "fan-out to multiple destinations", "high pass-through ratio", "rapid outbound movement", "round or near-round amounts")
POINTS, PRIORITY, WATCH = 18, 70, 45
ANOMALY_PRIORITY, ANOMALY_WATCH, SUPPRESSED = 70, 40, 22
NO_PASS_THROUGH = 999.0


def sides(transactions: DataFrame, grain: Sequence[str] = ()) -> DataFrame:
    """Each transaction seen from both of its accounts: ``account, side`` (in/out), ``other`` and the row's columns."""
    keep = ["id", "at", "amount", "type", "description", *[c for c in ["row_no"] if c in transactions.columns], *grain]
    into = transactions.select(F.col("destination").alias("account"), F.lit("in").alias("side"), F.col("origin").alias("other"), *keep)
    return into.unionByName(transactions.select(F.col("origin").alias("account"), F.lit("out").alias("side"), F.col("destination").alias("other"), *keep))


def account_facts(transactions: DataFrame, grain: Sequence[str] = (), hours: bool = True, marks: Sequence[Column] = (), columns: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Per account (and ``grain``): counterparties, sums, round and context rows, ``fastest_hours`` unless ``hours`` is false, and ``marks``.

    Bit k of ``marks`` is set if the k-th condition holds for a row that touches the account; conditions read the columns of ``sides`` and further
    ``columns`` of ``transactions``. Both sides are dealt by account once; the window over times and the counts per counterparty keep that order.
    ``parts``: partitions to deal them over.
    """
    keys = ["account", *grain]
    rows = sides(transactions, [*grain, *columns])
    held = [F.when(m, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, m in enumerate(marks)]
    rows = rows.select(*keys, "other", "amount", (F.col("side") == "in").alias("into"), *([seconds("at").alias("s")] if hours else []), *([sum(held[1:], held[0]).alias("marks")] if marks else []))
    rows = dealt(rows, *keys, parts=parts)
    money, into = F.col("amount") > 0, F.col("into")
    more, whole = [], []
    if hours:
        order = Window.partitionBy(*keys).orderBy("s", "into").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumns({"last_in": F.max(F.when(money & into, F.col("s"))).over(order), "last_out": F.max(F.when(money & ~into, F.col("s"))).over(order)})
        more.append(F.min(F.when(money, F.col("s") - F.when(into, F.col("last_out")).otherwise(F.col("last_in")))).alias("gap"))
        known = F.lit(True)
        for key in keys:
            known &= F.col(key).isNotNull()
        whole.append(F.when(known, F.min("gap") / 3600.0).alias("fastest_hours"))
    if marks:
        more.append(F.bit_or("marks").alias("marks"))
        whole.append(F.bit_or("marks").alias("marks"))
    pairs = rows.groupBy(*keys, "other").agg(
        F.sum(F.when(money & into, F.col("amount"))).alias("inbound"),
        F.sum(F.when(money & ~into, F.col("amount"))).alias("outbound"),
        F.count_if(money).alias("money_rows"),
        F.count_if(money & (F.col("amount") % 50 == 0)).alias("round_rows"),
        F.count_if(F.col("amount") == 0).alias("context_rows"),
        *more,
    )
    named, other = F.col("other").isNotNull(), F.col("other") != F.col("account")
    out = pairs.groupBy(*keys).agg(
        F.count_if(named & F.col("inbound").isNotNull()).alias("origins"),
        F.count_if(named & F.col("outbound").isNotNull()).alias("destinations"),
        F.coalesce(F.sum("inbound"), F.lit(0.0)).alias("inbound"),
        F.coalesce(F.sum("outbound"), F.lit(0.0)).alias("outbound"),
        F.sum("money_rows").alias("money_rows"),
        F.sum("round_rows").alias("round_rows"),
        F.sum("context_rows").alias("context_rows"),
        F.count_if(other & (F.col("money_rows") > 0)).alias("counterparties"),
        *whole,
    )
    return out.withColumn("ratio", F.when(F.col("inbound") > 0, F.col("outbound") / F.col("inbound")).otherwise(0.0))


def flows(transactions: DataFrame, grain: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Per account (and ``grain``): counterparties, sums, ratio, round and context rows; only amounts above 0 are money."""
    return account_facts(transactions, grain, hours=False, parts=parts)


def fastest_pass_through(transactions: DataFrame, grain: Sequence[str] = ()) -> DataFrame:
    """Per account: least hours between an inbound and an outbound payment, whichever came first.

    In time order the nearest pair is always two neighbours of different sides, or one with the
    last of the other side before it, so a sorted window replaces the product of both sides.
    """
    rows = sides(transactions.filter("amount > 0"), grain).withColumn("s", seconds("at"))
    order = Window.partitionBy("account", *grain).orderBy("s", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda side: F.max(F.when(F.col("side") == side, F.col("s"))).over(order)
    gap = F.col("s") - F.when(F.col("side") == "in", last("out")).otherwise(last("in"))
    return rows.withColumn("gap", gap).groupBy("account", *grain).agg((F.min("gap") / 3600.0).alias("fastest_hours"))


def _explaining() -> list[Column]:
    """Marks of the hard negatives: one for each pattern, then rows that are infrastructure only and rows that are not."""
    t, d = F.lower(F.concat_ws(" ", "type", "description", "account", "other")), F.lower(F.concat_ws(" ", "type", "description"))
    only = (F.col("amount") == 0) | d.rlike(ONLY_INFRASTRUCTURE)
    return [*[t.rlike(p) for p, _ in HARD_NEGATIVES], only, ~only]


def _contrary() -> Column:
    """Reasons by ``marks`` of the hard negatives."""
    bit = lambda k: F.col("marks").bitwiseAND(1 << k) != 0
    n = len(HARD_NEGATIVES)
    return reasons(*[(bit(k), m) for k, (_, m) in enumerate(HARD_NEGATIVES)], (bit(n) & ~bit(n + 1), "shared infrastructure without money movement"))


def hard_negatives(transactions: DataFrame, grain: Sequence[str] = ()) -> DataFrame:
    """Per account: reasons that explain its flows, from the text of all rows that touch it."""
    held = [F.when(m, F.lit(1 << k)).otherwise(F.lit(0)) for k, m in enumerate(_explaining())]
    found = sides(transactions, grain).groupBy("account", *grain).agg(F.bit_or(sum(held[1:], held[0])).alias("marks"))
    return found.select("account", *grain, _contrary().alias("contrary"))


def _indicators(free: Column) -> Column:
    rules = (F.col("origins") >= 2, F.col("destinations") >= 2, F.col("ratio") >= 0.75, F.col("fastest_hours") <= 3, F.col("round_rows") > 0)
    return reasons(*[(free & r, m) for r, m in zip(rules, INDICATORS, strict=True)])


def status(score: str | Column, priority: int = PRIORITY, watch: int = WATCH) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= priority, "review-priority").when(score >= watch, "watch").otherwise("background")


def score_accounts(transactions: DataFrame, grain: Sequence[str] = (), points: int = POINTS, bonus: str | None = None, bonus_points: int = 20, parts: int | None = None) -> DataFrame:
    """Indicators, score (``points`` each, at most 100) and status per account; a hard negative silences all indicators.

    ``bonus``: a boolean column of ``transactions`` that adds ``bonus_points`` to the accounts it marks.
    """
    keys, marks = ["account", *grain], _explaining()
    table = account_facts(transactions, grain, marks=[*marks, F.col(bonus)] if bonus else marks, columns=[bonus] if bonus else [], parts=parts)
    table = table.dropna(subset=keys).withColumn("contrary", _contrary())
    table = table.withColumn("indicators", _indicators(F.size("contrary") == 0))
    extra = F.when(F.col("marks").bitwiseAND(1 << len(marks)) != 0, bonus_points).otherwise(0)
    return table.withColumn("score", F.least(F.lit(100), F.size("indicators") * points + extra)).withColumn("status", status("score")).drop("marks")


def dependencies(transactions: DataFrame) -> DataFrame:
    """Per account: inbound transaction ids, then outbound ones, each in row order, as text."""
    rows = sides(transactions.filter("amount > 0"))
    ids = F.array_sort(F.collect_list(F.struct("side", "row_no", "id")))
    return rows.groupBy("account").agg(text_of(F.transform(ids, lambda x: x["id"])).alias("dependencies"))


def top_accounts(scores: DataFrame, k: int) -> DataFrame:
    """The k accounts of highest score, by id among equals (a top-k report)."""
    return scores.orderBy(F.desc("score"), "account").limit(k)


def labelled(transactions: DataFrame) -> DataFrame:
    """``account, positive``: whether any row labels the account as one for review."""
    rows = transactions.filter("expected_account_id <> '' and expected_review_priority is not null")
    return rows.groupBy(F.col("expected_account_id").alias("account")).agg(F.bool_or("expected_review_priority").alias("positive"))


def benchmark(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: how the ordering does against labels within a review budget of 1 to 3 accounts.

    The abstention rate divides by labelled accounts and may exceed 1.
    """
    counts = labels.agg(F.count("*").alias("labelled"), F.count_if("positive").alias("positives"))
    n = labels.count()
    budget = max(1, min(3, n or 1))
    reviewed = top_accounts(scores, budget).select("account").withColumn("reviewed", F.lit(True))
    joined = scores.join(labels, "account", "left").join(F.broadcast(reviewed), "account", "left")
    silent = (F.size("indicators") == 0) & (F.size("contrary") > 0)
    told = (F.size("indicators") > 0) | (F.size("contrary") > 0)
    facts = joined.agg(
        (F.count_if(F.col("reviewed") & F.col("positive")) / F.greatest(F.count("reviewed"), F.lit(1))).alias("precision_at_budget"),
        F.count_if(F.col("reviewed") & ~F.col("positive")).alias("false_positives"),
        F.count_if(~F.col("positive") & (F.col("status") == "review-priority")).alias("flagged_hard_negatives"),
        (F.count_if(silent) / F.greatest(F.lit(n), F.lit(1))).alias("abstention_rate"),
        (F.count_if(told) / F.greatest(F.count("*"), F.lit(1))).alias("explanation_coverage"),
    )
    return facts.crossJoin(counts).withColumn("budget", F.lit(budget))  # one row by one row


def event_range(transactions: DataFrame) -> DataFrame:
    """One row: latest time (what the import knows), time of the first row, rows."""
    return transactions.agg(F.max("at").alias("known_at"), F.min_by("at", "row_no").alias("first_row_at"), F.count("*").alias("rows"))


def features(transactions: DataFrame, grain: Sequence[str] = (), infrastructure: bool = True, parts: int | None = None) -> DataFrame:
    """Seven features per account."""
    return features_of(account_facts(transactions, grain, parts=parts), ["account", *grain], infrastructure)


def features_of(facts: DataFrame, keep: Sequence[str], infrastructure: bool = True) -> DataFrame:
    """Seven features from ``account_facts`` or ``score_accounts``, beside the columns to ``keep``."""
    fast = F.coalesce("fastest_hours", F.lit(NO_PASS_THROUGH))
    return facts.select(
        *keep,
        F.col("origins").cast("double").alias("inbound_origins"),
        F.col("destinations").cast("double").alias("outbound_destinations"),
        F.least(F.lit(1.5), "ratio").alias("pass_through_ratio"),
        (fast <= 3).cast("double").alias("rapid_pass_through"),
        F.when(F.col("money_rows") > 0, F.col("round_rows") / F.col("money_rows")).otherwise(0.0).alias("round_amount_share"),
        (F.lit(infrastructure) & (F.col("context_rows") > 0)).cast("double").alias("infrastructure_touch"),
        F.col("counterparties").cast("double").alias("bridge_centrality"),
    )


FEATURES = ("inbound_origins", "outbound_destinations", "pass_through_ratio", "rapid_pass_through", "round_amount_share", "infrastructure_touch", "bridge_centrality")
ANOMALY_POINTS = (18, 18, 18, 18, 10, 10, 8)


def anomaly_scores(transactions: DataFrame, suppressors: Sequence[tuple[str, str]], grain: Sequence[str] = (), per_account: bool = False, parts: int | None = None) -> DataFrame:
    """Points per feature, less 22 for each suppressor found in the text of all transactions (or of the account's own)."""
    keys = ["account", *grain]
    marks = [F.lower(F.concat_ws(" ", "id", "type", "description")).rlike(p) for p, _ in suppressors]
    facts = account_facts(transactions, grain, marks=marks, parts=parts)
    f = features_of(facts, [*keys, F.bit_count("marks").alias("suppressors") if per_account else "marks"] if marks else [*keys, F.lit(0).alias("suppressors")])
    rules = (F.col("inbound_origins") >= 2, F.col("outbound_destinations") >= 2, F.col("pass_through_ratio") >= 0.75, F.col("rapid_pass_through") > 0, F.col("round_amount_share") >= 0.5, F.col("infrastructure_touch") > 0, F.col("bridge_centrality") >= 4)
    raw = sum((F.when(r, p).otherwise(0) for r, p in zip(rules, ANOMALY_POINTS, strict=True)), F.lit(0))
    if per_account:
        f = f.dropna(subset=keys)
    elif marks:
        f = staged(f)  # read twice
        f = f.drop("marks").crossJoin(F.broadcast(f.agg(F.bit_count(F.bit_or("marks")).alias("suppressors"))))  # one row
    score = F.greatest(F.lit(0), F.least(F.lit(100), raw - F.col("suppressors") * SUPPRESSED))
    return f.withColumn("raw", raw).withColumn("score", score).withColumn("status", status("score", ANOMALY_PRIORITY, ANOMALY_WATCH))


def standardized(table: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Columns less their mean over the population's standard deviation (1 where that is 0)."""
    stats = table.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    scaled = [((F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))).alias(c) for c in columns]
    return table.crossJoin(F.broadcast(stats)).select(*[c for c in table.columns if c not in columns], *scaled)  # one row


def review_model(table: DataFrame, label: str = "label", columns: Sequence[str] = FEATURES):
    """A logistic regression over standardized features; its fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(columns), outputCol="features").transform(standardized(table, columns))
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=0.01, maxIter=50).fit(rows)


def contributions(table: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Per row: weight times value of each feature, largest absolute value first, as ``feature:value`` texts."""
    parts = F.array(*[F.struct((-F.abs(F.col(c) * w)).alias("o"), F.lit(c).alias("f"), (F.col(c) * w).alias("v")) for c, w in weights.items()])
    shown = F.transform(F.array_sort(parts), lambda x: F.concat(x["f"], F.lit(":"), F.format_string("%.3f", x["v"])))
    return table.withColumn("contributions", text_of(shown))


def confusion(table: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall (0 where undefined)."""
    c = table.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return c.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))
