"""Community lineage: links between snapshots, events, identities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import reasons, text_of
from ..functions.staging import ranked, staged


@dataclass(frozen=True)
class MatchConfig:
    """Thresholds of the matcher."""

    jaccard: float = 0.30
    overlap: float = 0.60
    jaccard_weight: float = 0.5
    resurgence_jaccard: float = 0.70
    resurgence_overlap: float = 0.85
    margin: float = 0.08
    uncertain: float = 0.70
    longest_gap: int = 3


ORDER = {"DEATH": 0, "BIRTH": 1, "RESURGENCE": 2, "CONTINUATION": 3, "SPLIT": 4, "MERGE": 5}


def observations(memberships: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Canonical communities: ``obs, snapshot_index, label, size, confidence, uncertain, rank``.

    Within a snapshot they rank by (sorted members, label), whatever their labels' order was.
    """
    sets = memberships.groupBy("snapshot_index", "label").agg(F.array_sort(F.collect_set("member")).alias("members"), F.min("confidence").alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("snapshot_index").orderBy(F.array_join("members", "\u0001"), "label"))
    rows = sets.withColumn("rank", rank)
    obs = F.format_string("s%04d:c%04d", F.col("snapshot_index"), F.col("rank"))
    return rows.select(obs.alias("obs"), "snapshot_index", "label", F.size("members").alias("size"), "confidence", (F.col("confidence") < config.uncertain).alias("uncertain"))


def restrict(memberships: DataFrame, allowed: DataFrame) -> DataFrame:
    """Members that the reader may see; communities left empty are gone."""
    return memberships.join(allowed.select("member").distinct(), "member", "left_semi")


def unauthorized_members(memberships: DataFrame, edges: DataFrame) -> DataFrame:
    """Members that no visible edge has at an end; must be empty."""
    ends = edges.select(F.col("subject").alias("member")).union(edges.select("object")).distinct()
    return memberships.select("member").distinct().join(ends, "member", "left_anti")


def jaccard(i: Column, a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 1.0).otherwise(i / (a + b - i))


def overlap(i: Column, a: Column, b: Column) -> Column:
    return F.when(F.least(a, b) == 0, F.when(a + b == 0, 1.0).otherwise(0.0)).otherwise(i / F.least(a, b))


def pair_counts(memberships: DataFrame, obs: DataFrame, gaps: tuple[int, int]) -> DataFrame:
    """``parent, child, gap, common`` and both sides' size and certainty, for pairs that share a member at an index distance in ``gaps``.

    Members meet by an equi-join on (member, index), so no pair without a common member is formed.
    """
    m = memberships.select("snapshot_index", "label", "member").distinct().join(obs, ["snapshot_index", "label"])
    child = m.select(F.col("obs").alias("child"), "member", F.col("snapshot_index").alias("child_index"), F.col("size").alias("child_size"), F.col("uncertain").alias("child_uncertain"))
    parent = m.select(F.col("obs").alias("parent"), "member", F.col("size").alias("parent_size"), F.col("uncertain").alias("parent_uncertain"), F.explode(F.sequence(F.col("snapshot_index") + gaps[0], F.col("snapshot_index") + gaps[1])).alias("child_index"), F.col("snapshot_index").alias("parent_index"))
    met = parent.join(child, ["member", "child_index"])
    keys = ["parent", "child", "parent_index", "child_index", "parent_size", "child_size", "parent_uncertain", "child_uncertain"]
    return met.groupBy(*keys).agg(F.count("*").alias("common"))


def scored(pairs: DataFrame, config: MatchConfig = MatchConfig(), resurgence: bool = False) -> DataFrame:
    """Candidate links with both scores, acceptance and reasons for low confidence."""
    j, o = jaccard(F.col("common"), F.col("parent_size"), F.col("child_size")), overlap(F.col("common"), F.col("parent_size"), F.col("child_size"))
    least_j, least_o = (config.resurgence_jaccard, config.resurgence_overlap) if resurgence else (config.jaccard, config.overlap)
    rows = pairs.withColumns({"jaccard": j, "overlap": o, "gap": F.col("child_index") - F.col("parent_index") - 1})
    rows = rows.withColumn("score", config.jaccard_weight * F.col("jaccard") + (1 - config.jaccard_weight) * F.col("overlap"))
    rows = rows.withColumn("accepted", (F.col("jaccard") >= least_j) | (F.col("overlap") >= least_o))
    near = F.greatest(F.col("jaccard") - least_j, F.col("overlap") - least_o) < config.margin
    why = reasons((F.col("parent_uncertain") | F.col("child_uncertain"), "uncertain_input"), (F.col("accepted") & near, "near_threshold"), (F.lit(resurgence), "observation_gap"))
    return rows.withColumn("reasons", why).withColumn("low_confidence", F.size("reasons") > 0)


def adjacent_links(memberships: DataFrame, obs: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Scored candidates between neighbouring snapshots that share a member."""
    return scored(pair_counts(memberships, obs, (1, 1)), config)


def link_events(obs: DataFrame, links: DataFrame) -> DataFrame:
    """Continuations, splits, merges, deaths and unparented communities from the accepted adjacent links.

    ``event, snapshot_index, parents, children, score, low_confidence, reasons`` (ids and reasons as sorted texts).
    Births and deaths have no score and are as certain as their community.
    A link continues if it is the only one on both sides; a parent of several children splits, a child of several parents merges.
    """
    ok = links.filter("accepted")
    ok = ok.withColumns({"__c": F.count("*").over(Window.partitionBy("parent")), "__p": F.count("*").over(Window.partitionBy("child"))})
    said = lambda c: text_of(F.array_sort(c))
    one = ok.filter("__c = 1 and __p = 1").select(F.lit("CONTINUATION").alias("event"), F.col("child_index").alias("snapshot_index"), F.col("parent").alias("parents"), F.col("child").alias("children"), "score", "low_confidence", said("reasons").alias("reasons"))

    def many(side: str, other: str, count: str, name: str) -> DataFrame:
        g = ok.filter(F.col(count) > 1).groupBy(side, F.col("child_index").alias("snapshot_index"))
        agg = g.agg(said(F.collect_list(other)).alias("o"), F.min("score").alias("score"), F.bool_or("low_confidence").alias("low_confidence"), said(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
        a, b = (F.col(side), F.col("o")) if side == "parent" else (F.col("o"), F.col(side))
        return agg.select(F.lit(name).alias("event"), "snapshot_index", a.alias("parents"), b.alias("children"), "score", "low_confidence", "reasons")

    last = obs.agg(F.max("snapshot_index").alias("__last"))
    gone = obs.crossJoin(F.broadcast(last)).filter("snapshot_index < __last").join(ok.select(F.col("parent").alias("obs")), "obs", "left_anti")  # one row
    unsure = F.coalesce("uncertain", F.lit(False))
    blank = [F.lit(None).cast("double").alias("score"), unsure.alias("low_confidence"), F.when(unsure, "uncertain_input").otherwise("").alias("reasons")]
    death = gone.select(F.lit("DEATH").alias("event"), (F.col("snapshot_index") + 1).alias("snapshot_index"), F.col("obs").alias("parents"), F.lit("").alias("children"), *blank)
    new = obs.join(ok.select(F.col("child").alias("obs")), "obs", "left_anti")
    birth = new.select(F.lit("BIRTH").alias("event"), "snapshot_index", F.lit("").alias("parents"), F.col("obs").alias("children"), *blank)
    return one.unionByName(many("parent", "child", "__c", "SPLIT")).unionByName(many("child", "parent", "__p", "MERGE")).unionByName(death).unionByName(birth)


def dormant_and_new(obs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``parent``: communities without an accepted child; ``child``: those without an accepted parent."""
    ok = links.filter("accepted")
    dead = obs.join(ok.select(F.col("parent").alias("obs")).distinct(), "obs", "left_anti").select(F.col("obs").alias("parent"))
    new = obs.join(ok.select(F.col("child").alias("obs")).distinct(), "obs", "left_anti").select(F.col("obs").alias("child"))
    return dead, new


def across_gaps(memberships: DataFrame, obs: DataFrame, links: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Scored pairs of a dormant community and an unparented one at an index distance of 2 to ``longest_gap + 1`` that share a member."""
    dead, new = dormant_and_new(obs, links)
    return scored(pair_counts(memberships, obs, (2, config.longest_gap + 1)), config, resurgence=True).join(dead, "parent").join(new, "child")


def resurgences(memberships: DataFrame, obs: DataFrame, links: DataFrame, config: MatchConfig = MatchConfig(), options: DataFrame | None = None) -> DataFrame:
    """Chosen matches of dormant communities with unparented later ones: ``parent, child, child_index, gap, score, reasons``.

    The rule takes options in order of snapshot, score, Jaccard, overlap, parent and child, each unless one of its sides is taken.
    As the order is total, an option that comes first of both its sides' options is taken whatever the others do; a round
    takes all such options and drops those that share a side with them, by minima and joins alone, until none is left.
    """
    options = staged((across_gaps(memberships, obs, links, config) if options is None else options).filter("accepted").select("parent", "child", "child_index", "gap", "jaccard", "overlap", "score", text_of("reasons").alias("reasons")))
    place = F.struct("child_index", (-F.col("score")).alias("s"), (-F.col("jaccard")).alias("j"), (-F.col("overlap")).alias("o"), "parent", "child")
    left = options.withColumn("place", place)
    chosen = options.limit(0)
    while not left.isEmpty():
        firsts = [left.groupBy(side).agg(F.min("place").alias(f"first_{side}")) for side in ("parent", "child")]
        now = staged(left.join(firsts[0], "parent").join(firsts[1], "child").filter("place = first_parent and place = first_child").select(options.columns))
        chosen = chosen.unionByName(now)
        left = staged(left.join(now.select("parent"), "parent", "left_anti").join(now.select("child"), "child", "left_anti"))
    # A match is contested by the best other option of its child whose parent no earlier match has taken.
    taken = staged(chosen.withColumn("place", place))
    used = taken.select(F.col("parent").alias("other"), F.col("place").alias("used_at"))
    rivals = taken.select("child", "parent", "place").join(options.select("child", F.col("parent").alias("other"), F.col("score").alias("rival")), "child").filter("other <> parent")
    rivals = rivals.join(used, "other", "left").filter("used_at is null or used_at > place").groupBy("child").agg(F.max("rival").alias("rival"))
    tied = F.coalesce(F.col("score") - F.col("rival") < config.margin, F.lit(False))
    why = F.concat_ws(",", F.nullif("reasons", F.lit("")), F.when(tied, "competing_match"))
    return taken.join(rivals, "child", "left").select("parent", "child", "child_index", "gap", "score", why.alias("reasons"))


def candidates(memberships: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """All scored candidates ``parent, child, gap, jaccard, overlap, score, accepted``: adjacent ones, then those across a gap.

    A community is dormant from its death to the snapshot that reclaims it, that one included; candidates across a gap are its pairs with
    unparented communities of that time, accepted only if chosen as a resurgence, whatever their score.
    """
    obs = staged(observations(memberships, config))
    links = staged(adjacent_links(memberships, obs, config))
    apart = staged(across_gaps(memberships, obs, links, config))
    closed = resurgences(memberships, obs, links, config, apart).select("parent", F.col("child").alias("back"), F.col("child_index").alias("until"))
    apart = apart.join(closed, "parent", "left").filter("until is null or child_index <= until").withColumn("accepted", F.coalesce(F.col("child") == F.col("back"), F.lit(False)))
    kept = ["parent", "child", "gap", "jaccard", "overlap", "score", "accepted"]
    return links.select(kept).unionByName(apart.select(kept))


def events(memberships: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """All lineage events with their ``position`` in order, with resurgence in place of the births it explains."""
    obs = staged(observations(memberships, config))
    links = staged(adjacent_links(memberships, obs, config))
    found = link_events(obs, links)
    back = staged(resurgences(memberships, obs, links, config))
    again = back.select(F.lit("RESURGENCE").alias("event"), F.col("child_index").alias("snapshot_index"), F.col("parent").alias("parents"), F.col("child").alias("children"), "score", F.lit(True).alias("low_confidence"), "reasons")
    born = found.join(back.select(F.lit("BIRTH").alias("event"), F.col("child").alias("children")), ["event", "children"], "left_anti")
    return ordered(born.unionByName(again))


def ordered(found: DataFrame) -> DataFrame:
    """``found`` with ``position`` from 1, by snapshot, then kind of event, then ids; rows come in that order."""
    kind = F.create_map(*[F.lit(x) for k, v in ORDER.items() for x in (k, v)])[F.col("event")]
    return ranked(found.withColumn("kind", kind), ["snapshot_index", "kind", "parents", "children"], rank="position").drop("kind").orderBy("position")


def identities(memberships: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """``obs, lineage``: a lineage runs along continuations and resurgences, and is numbered by its first community.

    First communities are numbered by snapshot, then those of splits (by the least parent that splits into them), merges and births, then id.
    """
    from .graph import connected_components

    obs = staged(observations(memberships, config))
    links = staged(adjacent_links(memberships, obs, config))
    ok = links.filter("accepted").withColumns({"__c": F.count("*").over(Window.partitionBy("parent")), "__p": F.count("*").over(Window.partitionBy("child"))})
    same = staged(ok.filter("__c = 1 and __p = 1").select("parent", "child").unionByName(resurgences(memberships, obs, links, config).select("parent", "child")))
    run = connected_components(obs.select(F.col("obs").alias("node_id")), same.select(F.col("parent").alias("subject"), F.col("child").alias("object")))
    born = ok.groupBy(F.col("child").alias("obs")).agg(F.min(F.when(F.col("__c") > 1, 0).when(F.col("__p") > 1, 1)).alias("k"), F.min(F.when(F.col("__c") > 1, F.col("parent"))).alias("of"))
    first = obs.select("obs", "snapshot_index").join(same.select(F.col("child").alias("obs")), "obs", "left_anti").join(born, "obs", "left")
    first = first.select("obs", "snapshot_index", F.coalesce("k", F.lit(2)).alias("k"), F.coalesce("of", F.lit("")).alias("of"))
    names = ranked(first, ["snapshot_index", "k", "of", "obs"], rank="number").select(F.col("obs").alias("component"), F.format_string("L%04d", F.col("number")).alias("lineage"))
    return run.join(names, "component").select(F.col("node_id").alias("obs"), "lineage")


def endpoints(found: DataFrame) -> DataFrame:
    """One row per event and community on either side: ``event, snapshot_index, role, obs, rank``."""
    side = lambda c, role: found.filter(F.col(c) != "").select("event", "snapshot_index", F.lit(role).alias("role"), F.posexplode(F.split(c, ",")).alias("rank", "obs"))
    return side("parents", "parent").unionByName(side("children", "child"))
