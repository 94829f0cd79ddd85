"""Corpus pipeline: quality, repeated blocks, near duplicates, target mix, packing.

Each stage takes all documents that the one before it kept. Quality and near-duplicate stages drop
whole documents; the line stage shortens texts and drops those it leaves empty; the mix draws
documents to the target weights; packing places what is left into sequences of 2048 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import cotrain
from chronoweave.llm.common import ship, staged, table
from chronoweave.llm.line_dedup import drop_repeated_blocks
from chronoweave.llm.minhash import without_near_duplicates
from chronoweave.llm.mixing import mixed
from chronoweave.llm.packing import pack_documents
from chronoweave.llm.queries import DOMAIN, MIX_LEVELS, MIX_SEED, MIX_WEIGHTS, tokenizer_path

#: Share of the tokens that reach the mix which it keeps.
MIX_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that both views together judge good; all of them if there are no labels of two classes."""
    ship(spark)
    model = cotrain.train(docs, table(spark, sf_dir, "labels"))
    return cotrain.score(docs, model).filter("good").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without blocks that an earlier document has, their sizes counted anew; those left without a word go."""
    ship(spark)
    out = drop_repeated_blocks(docs).filter("n_removed = 0 or length(trim(text)) > 0")
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group linked at similarity 0.8 on five-word shingles.

    Wordless and null texts and null ids stay; of an id with several texts each is judged by itself; repeated rows stay or go together.
    """
    ship(spark)
    return without_near_duplicates(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch at most of each source, to the target weights."""
    ship(spark)
    named = docs.withColumn("__domain", F.expr(DOMAIN))
    levels = ["__domain", *MIX_LEVELS[1:]]
    weights = {"__domain": MIX_WEIGHTS["domain"], "lang": MIX_WEIGHTS["lang"]}
    return mixed(named, levels, weights, percent=MIX_PERCENT, epochs=1, seed=MIX_SEED, name="__taken").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    ship(spark)
    return pack_documents(docs, tokenizer_path(), end_id=1, capacity=2048)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", packing)]

#: The first stage trains a model, the second aligns texts: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
