"""One query per corpus operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain
from .align import align_tokens
from .common import fresh_path, table
from .itq import near_vectors
from .line_dedup import drop_repeated_blocks
from .lm_score import cross_entropy_difference
from .minhash import near_duplicates
from .mixing import mixed, token_count
from .packing import pack_documents
from .site_tree import extract
from .repair import damaged, repair_conversations
from .substrings import remove_repeated_spans
from .token_files import read_token_files, write_token_files
from .winnow import compared_with_edit_and_next


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


#: The mix: sources fall into four domains by their number; weights of domains and languages, one for each source.
DOMAIN = "concat('domain', coalesce(cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4 as string), '-none'))"
MIX_LEVELS = ("domain", "lang", "source")
MIX_WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 4, "de": 3, "fr": 2, "es": 1}}
MIX_SEED = 11


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights from at most two epochs, for as many tokens as the corpus has."""
    docs = table(spark, sf_dir, "documents").withColumn("domain", F.expr(DOMAIN))
    out = mixed(docs, MIX_LEVELS, MIX_WEIGHTS, percent=100, epochs=2, seed=MIX_SEED)
    return out.select("doc_id", "domain", "lang", "source", "epoch", token_count("text").alias("n_tokens"))


def _case(column: str, weights: dict[str, int]) -> str:
    return "case " + column + "".join(f" when '{k}' then {w}" for k, w in weights.items()) + " else 1 end"


def _share(name: str, parent: list[str], own: str, nodes: str) -> str:
    """One level of the tree: what its parents are given, shared by weight within capacity."""
    by = "partition by " + ", ".join(parent) if parent else ""
    keys = ", ".join([*parent, own])
    return f"""{name}_a as (
        select *, coalesce(sum(cap) over ({by} order by cap / w, {own} rows between unbounded preceding and 1 preceding), 0) as before,
            sum(w) over ({by} order by cap / w, {own} rows between current row and unbounded following) as weight_left
        from ({nodes})),
    {name}_b as (select *, cap::hugeint * weight_left <= w::hugeint * (given - before) as is_full from {name}_a),
    {name}_c as (
        select *, coalesce(sum(case when is_full then cap end) over ({by}), 0) as full_cap, sum(case when not is_full then w end) over ({by}) as open_w
        from {name}_b),
    {name} as (select {keys}, (case when is_full then cap else w::hugeint * (given - full_cap)::hugeint // open_w end)::bigint as given from {name}_c)"""


MIX_SQL = f"""
with d as (
    select doc_id, lang, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as n_tokens, {DOMAIN} as domain
    from documents),
leaf as (select domain, lang, source, sum(n_tokens)::bigint as tokens, sum(n_tokens)::bigint * 2 as cap from d group by all having sum(n_tokens) > 0),
{_share("l1", [], "domain", f"select domain, sum(cap)::bigint as cap, {_case('domain', MIX_WEIGHTS['domain'])} as w, (select sum(tokens)::bigint from leaf) as given from leaf group by domain")},
{_share("l2", ["domain"], "lang", f"select domain, lang, sum(cap)::bigint as cap, {_case('lang', MIX_WEIGHTS['lang'])} as w, any_value(l1.given) as given from leaf join l1 using (domain) group by domain, lang")},
{_share("l3", ["domain", "lang"], "source", "select domain, lang, source, cap, 1 as w, l2.given from leaf join l2 using (domain, lang)")},
plan as (select domain, lang, source, given // tokens as full_epochs, given % tokens as rest from leaf join l3 using (domain, lang, source)),
drawn as (
    select d.*, plan.full_epochs, plan.rest, e.epoch, md5(concat('{MIX_SEED}-', e.epoch::varchar, '-', doc_id::varchar)) as draw
    from d join plan using (domain, lang, source) join (select unnest([0, 1, 2])::bigint as epoch) e on e.epoch <= plan.full_epochs),
run as (select *, sum(n_tokens) over (partition by domain, lang, source, epoch order by draw) as through from drawn)
select doc_id, domain, lang, source, epoch, n_tokens from run where epoch < full_epochs or through <= rest
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the blocks that an earlier document has."""
    return drop_repeated_blocks(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by both views and jointly."""
    docs = table(spark, sf_dir, "documents")
    model = cotrain.train(docs, table(spark, sf_dir, "labels"))
    return cotrain.score(docs, model).select("doc_id", "p_text", "p_meta", "score", "good")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written from all documents and read back."""
    folder = fresh_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=2)
    return read_token_files(spark, folder).drop("position")


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))


def op8_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by their loss under a model of good, harmless labelled documents against one of the rest."""
    labels = table(spark, sf_dir, "labels")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), labels.filter("quality = 1 and toxic = 0").select("doc_id"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likeness to these and to the next document."""
    return compared_with_edit_and_next(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, capacity=2048)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all conversations after the damage."""
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


def op12_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 35-word windows that stand anywhere else."""
    return remove_repeated_spans(table(spark, sf_dir, "documents")).drop("text")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by two vocabularies, linked by their bytes."""
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_itq, op2_minhash, op3_mixing, op4_line_dedup, op5_quality_cotraining, op6_token_files, op7_site_style_tree, op8_lm_difference, op9_winnowing, op10_packing, op11_conversation_repair, op12_debruijn_spans, op13_token_alignment)}
ORACLE: dict[str, str] = {"op3_mixing": MIX_SQL}
