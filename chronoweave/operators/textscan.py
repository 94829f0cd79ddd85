"""Text scans, lexical retrieval and identity candidates; suggestions for review, never merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import reasons, text_of

# Patterns of the scans.
PROHIBITED = (
    (r"(?i)who\s+(is|are)\s+(guilty|criminal|the criminal)", "unsupported accusation"),
    (r"(?i)\b(arrest|detain|raid|surveil|freeze assets|enforcement action)\b", "operational enforcement prompt"),
    (r"(?i)\b(race|religion|ethnicity|nationality|protected attribute)\b", "protected-attribute inference"),
    (r"(?i)\bprove\b.*\b(crime|criminal|guilt|guilty)\b", "unsupported accusation"),
)
INJECTION = (
    r"(?i)ignore (all )?(previous|prior|above) instructions",
    r"(?i)reveal|print|exfiltrate.*(system|developer|prompt|secret)",
    r"(?i)hidden (node|edge|relationship|source|neighbor)",
    r"(?i)bypass|jailbreak|override.*policy",
    r"(?i)tool output|developer message|system message",
)
PRIVACY = (
    r"(?i)\b(race|religion|ethnicity|nationality|health|disability|sexual orientation)\b",
    r"(?i)\b(ssn|social security|passport|credential|password|api key|secret)\b",
    r"(?i)\b(arrest|detain|raid|freeze assets|surveil)\b",
)
RISKY = (
    (r"(?i)\bguilty|criminal|crime ring|money launderer|culprit\b", "Overclaims criminality or guilt."),
    (r"(?i)\bdefinitely|proves|certainly|without doubt\b", "Uses certainty language beyond the evidence."),
)
UNCERTAINTY = r"(?i)uncertain|limitation|contrary|review"
FACTUAL = r"(?i)\b(account|acct|graph|evidence|transaction|relationship|report|source|support|because)\b"
TELLING, CAUTION = "mule|bridge|consolidation|cash-out|pass-through|split|alias", "uncertain|caveat|refund|processor|shared|coverage|legitimate"


def importance(text: Column, telling: str = TELLING, caution: str = CAUTION) -> Column:
    t = F.lower(text)
    return F.when(t.rlike(telling), 2).otherwise(0) + F.when(t.rlike(caution), 1).otherwise(0)


def retrieve(rows: DataFrame, prompt: str, k: int = 5, telling: str = TELLING, caution: str = CAUTION) -> DataFrame:
    """The k rows of highest score (a top-k report): prompt tokens that ``text`` contains, each time they occur in the prompt, plus importance."""
    import re

    tokens = [t for t in re.split(r"\W+", prompt.lower()) if t]
    low = F.lower("text")
    score = sum((F.contains(low, F.lit(t)).cast("int") for t in tokens), F.lit(0)) + importance(F.col("text"), telling, caution)
    return rows.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k).select("id", "score")


def important(rows: DataFrame, k: int = 4, telling: str = TELLING, caution: str = CAUTION) -> DataFrame:
    """The k rows of highest importance (a top-k report)."""
    return rows.withColumn("importance", importance(F.col("text"), telling, caution)).orderBy(F.desc("importance"), "id").limit(k).select("id", "importance")


def classify(text: str = "text", rules: Sequence[tuple[str, str]] = PROHIBITED) -> Column:
    """The first rule's reason, or null."""
    out = None
    for pattern, why in rules:
        hit = F.col(text).rlike(pattern)
        out = F.when(hit, why) if out is None else out.when(hit, why)
    return out


def flags(patterns: Sequence[str], text: str = "text") -> Column:
    """Numbers (from 1) of the patterns that the text has."""
    return reasons(*[(F.col(text).rlike(p), str(i)) for i, p in enumerate(patterns, 1)])


def quarantine(sources: DataFrame, patterns: Sequence[str] = INJECTION) -> DataFrame:
    """Sources with ``flags`` and ``action``."""
    f = flags(patterns)
    return sources.withColumns({"flags": text_of(f), "action": F.when(F.size(f) > 0, "quarantine-source").otherwise("allow-source")})


def sentences(rows: DataFrame) -> DataFrame:
    """``id, n, sentence`` in order."""
    return rows.select("id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("n", "s")).select("id", "n", F.trim("s").alias("sentence")).filter("sentence <> ''")


def uncited(rows: DataFrame, citations: DataFrame, factual: str = FACTUAL) -> DataFrame:
    """``id, n, sentence`` of factual sentences that hold none of the row's citations ``[citation]``."""
    cited = citations.groupBy("id").agg(F.collect_set("citation").alias("c"))
    s = sentences(rows).filter(F.col("sentence").rlike(factual)).join(cited, "id", "left")
    has = F.exists(F.coalesce("c", F.expr("cast(array() as array<string>)")), lambda c: F.contains("sentence", F.concat(F.lit("["), c, F.lit("]"))))
    return s.filter(~has).select("id", "n", "sentence")


def risky_language(rows: DataFrame, citations: DataFrame, rules: Sequence[tuple[str, str]] = RISKY, uncertainty: str = UNCERTAINTY, factual: str = FACTUAL) -> DataFrame:
    """``id, flags``: five reviews of generated text."""
    cited = citations.select("id").distinct().withColumn("has", F.lit(True))
    bare = uncited(rows, citations, factual).select("id").distinct().withColumn("bare", F.lit(True))
    r = rows.join(cited, "id", "left").join(bare, "id", "left")
    why = reasons(
        *[(F.col("text").rlike(p), m) for p, m in rules],
        (F.col("has").isNull(), "No citations attached to the generated text."),
        (~F.col("text").rlike(uncertainty), "Does not foreground uncertainty or review-only status."),
        (F.col("bare"), "One or more factual sentences lack exact citations."),
    )
    return r.select("id", F.array_join(why, "|").alias("flags"))


def identity_candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``a, b, shared, connected``: nodes of one type that share a label token or an edge, never merged.

    Nodes meet by an equi-join on (type, token) and by edges; the pairs of a token that very many nodes
    have would be all their pairs, so nodes of equal token sets are first one class, and classes meet.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("label"), r"\W+"), lambda t: t != "")))
    w = nodes.select("node_id", "type", words.alias("words"))
    tokens = w.select("node_id", "type", F.explode("words").alias("token"))
    met = tokens.join(tokens.select(F.col("node_id").alias("b"), "type", "token"), ["type", "token"]).filter("node_id < b")
    shared = met.groupBy(F.col("node_id").alias("a"), "b").agg(F.array_join(F.array_sort(F.collect_set("token")), ",").alias("shared"))
    kind = nodes.select("node_id", "type")
    near = edges.select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).filter("a <> b").distinct()
    near = near.join(kind.select(F.col("node_id").alias("a"), F.col("type").alias("ta")), "a").join(kind.select(F.col("node_id").alias("b"), F.col("type").alias("tb")), "b").filter("ta = tb")
    out = shared.join(near.select("a", "b", F.lit(True).alias("connected")), ["a", "b"], "full_outer")
    return out.select("a", "b", F.coalesce("shared", F.lit("")).alias("shared"), F.coalesce("connected", F.lit(False)).alias("connected"))


def identity_classes(nodes: DataFrame) -> DataFrame:
    """``type, words, members, first``: nodes with the same type and label tokens as one class each, however many they are."""
    words = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.lower("label"), r"\W+"), lambda t: t != ""))), " ")
    return nodes.select("type", words.alias("words"), "node_id").groupBy("type", "words").agg(F.count("*").alias("members"), F.min("node_id").alias("first"))


def class_candidates(classes: DataFrame) -> DataFrame:
    """``type, a, b, shared``: pairs of classes that share a token; with the members of each class, all candidate pairs."""
    t = classes.select("type", "words", F.explode(F.split("words", " ")).alias("token"))
    met = t.join(t.select("type", F.col("words").alias("b"), "token"), ["type", "token"]).filter("words < b")
    return met.groupBy("type", F.col("words").alias("a"), "b").agg(F.array_join(F.array_sort(F.collect_set("token")), ",").alias("shared"))


# The rules' words, severities and texts.
WEAK, UNSURE, CANDID, BLOCKS = "(?i)uncertain|moderate", "(?i)moderate|low|uncertain", "(?i)contrary|limitation|uncertain|synthetic", "(?i)hard-negative|overreliance|calibration"
NO_ROWS = "high: No visible evidence rows in authorized projection."
WEAK_ROWS = "medium: Some visible relationships are uncertain or moderate confidence."
BY_HAND = " manual chart item(s) cannot support factual claims."
NOT_CANDID = "medium: Report text may understate uncertainty or contrary evidence."
OPEN_TASKS = "medium: Open review tasks remain before export."
NO_CANDIDATE = "Review hard-negative example"


def evidence_gaps(cases: DataFrame, edges: DataFrame, items: DataFrame, reports: DataFrame, tasks: DataFrame, group: str = "case_id") -> DataFrame:
    """``gaps, status`` of each of ``cases``: no visible row, weak rows, items made by hand, a report without caveats, open tasks.

    ``edges``: ``confidence`` and ``status`` as texts; ``items``: ``origin``; ``reports``: ``contrary_evidence, limitations``; ``tasks``: ``status``.
    Gaps are joined by a bar; a high one needs review.
    """
    weak = F.concat_ws(" ", F.col("confidence").cast("string"), "status").rlike(WEAK)
    candid = F.concat_ws(" ", "contrary_evidence", "limitations").rlike(CANDID)
    parts = (
        edges.groupBy(group).agg(F.count("*").alias("rows"), F.bool_or(weak).alias("weak")),
        items.groupBy(group).agg(F.count_if(F.col("origin") == "analyst").alias("manual")),
        reports.groupBy(group).agg(F.bool_or(~candid).alias("bare")),
        tasks.groupBy(group).agg(F.bool_or(F.col("status") != "done").alias("open")),
    )
    g = cases.select(group).distinct()
    for p in parts:
        g = g.join(p, group, "left")
    why = reasons(
        (F.coalesce("rows", F.lit(0)) == 0, NO_ROWS),
        (F.col("weak"), WEAK_ROWS),
        (F.col("manual") > 0, F.concat(F.lit("high: "), F.col("manual").cast("string"), F.lit(BY_HAND))),
        (F.col("bare"), NOT_CANDID),
        (F.col("open"), OPEN_TASKS),
    )
    text = F.array_join(why, "|")
    return g.select(group, text.alias("gaps"), F.when(F.exists(why, lambda x: x.startswith("high")), "needs-review").otherwise("reviewable").alias("status"))


def next_action(cases: DataFrame, tasks: DataFrame, edges: DataFrame, candidates: DataFrame, group: str = "case_id") -> DataFrame:
    """``action, label, target`` of each of ``cases``: the first that applies of an open task, uncertain evidence, a hard negative to label.

    ``tasks``: ``task_id, label, status``; ``edges``: ``edge_id, label`` and texts ``confidence, reasoning, caveat``; ``candidates``: ``candidate, label,
    failures``, the first of which that fails on hard negatives, overreliance or calibration is what to label. "First" is by id.
    """
    first = lambda rows, key, name: rows.groupBy(group).agg(F.min(F.struct(F.col(key).alias("id"), "label")).alias(name))
    unsure = F.concat_ws(" ", F.col("confidence").cast("string"), "reasoning", "caveat").rlike(UNSURE)
    blocked = candidates.filter(F.col("failures").rlike(BLOCKS)).agg(F.min(F.struct(F.col("candidate").alias("id"), "label")).alias("blocked"))  # one row
    rows = cases.select(group).distinct().join(first(tasks.filter("status <> 'done'"), "task_id", "task"), group, "left").join(first(edges.filter(unsure), "edge_id", "edge"), group, "left").crossJoin(F.broadcast(blocked))
    action = F.when(F.col("task").isNotNull(), "complete-open-task").when(F.col("edge").isNotNull(), "review-uncertain-evidence").otherwise("label-hard-negative")
    label = F.coalesce("task.label", "edge.label", "blocked.label", F.lit(NO_CANDIDATE))
    target = F.when(F.col("task").isNotNull(), F.col("task.id")).when(F.col("edge").isNotNull(), F.col("edge.id"))
    return rows.select(group, action.alias("action"), label.alias("label"), target.alias("target"))


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key in an explicit order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")
