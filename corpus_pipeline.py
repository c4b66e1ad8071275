"""From raw documents to tokens: five stages, each one operator on all rows that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, minhash, mixing, pii, toxicity
from tidemark.llm.common import documents, small_batches, stored
from tidemark.llm.queries import BUDGET, TOKENIZER, domain, mixing_tree

#: SQL can't express a learnt score, near-duplicate components, hashed orders or BPE; the tests use brute force.
ORACLE_SQL = None


def clean_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5; the model is fitted on the labels of the documents given.

    Without labels of both kinds nothing is rejected; null and blank texts stay. Extra columns of any name pass.
    """
    small_batches(spark)
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    80 per cent, the general rule for stages; the 85 of the operator's own query is its contract. Rows with a null id stay.
    """
    small_batches(spark)
    gone = minhash.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind. Null texts stay null, repeated rows are alike."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the token budget buys by target weights; one that is needed for two epochs comes twice."""
    aside = {c: f"own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in mixing.ADDED}
    mixed = mixing.mixed(docs.withColumnsRenamed(aside), mixing_tree(docs), BUDGET, domain())
    return mixed.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, and whether they decode to the text again."""
    small_batches(spark)
    return bpe.encoded(docs, TOKENIZER)


STAGES = [
    ("toxicity", clean_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's are written to the shared folder and read again. An empty table gives none."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
