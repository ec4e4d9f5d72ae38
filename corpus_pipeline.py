"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as the next one's
``docs``. All but the last return the columns of ``docs``:

toxicity       rows that the classifier chain, trained on ``labels``, rejects go
near_dedup     one document of each class of near-duplicates stays, that of the least doc_id
decontaminate  rows that hold a window of ``benchmark`` go
mixing         rows come as often as their source's budget takes them: sources at their target weights
token_ids      every row, in ascending doc_id order: doc_id, start, n_tokens, ids_crc32 from the files

Defined cases, beside those of the operators: null texts pass toxicity, near_dedup and decontaminate; mixing takes them as often as their source has whole
epochs. Rows equal in doc_id and text go or stay together, but near_dedup keeps one of them. Without labels nothing is toxic; without a
benchmark nothing is contaminated. Empty documents give an empty result. Extra columns are kept up to token_ids, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnhelm.llm import decontaminate, mixing, neardup, tokens, toxicity
from tarnhelm.llm.common import table, written


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the chain trained on ``labels`` rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return neardup.drop_near_duplicates(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of ``benchmark`` go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's budget takes them."""
    return mixing.mix(docs)


def stage_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the id files and gives what is read back."""
    return tokens.round_trip(docs).drop("ids")


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mixing", stage_mixing),
    ("token_ids", stage_token_ids),
]

#: Trained models, hash-random keys and a tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
