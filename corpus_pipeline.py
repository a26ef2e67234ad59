"""Training-text pipeline over ``documents``: each stage is written as Parquet and reread as the next one's input.

Toxic documents go, one document of each group of near copies stays, secrets are replaced by their kind, sources are
mixed to their target weights (a document may go or be repeated), and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitegauge.llm import bpe, mixing, secrets, simhash, toxicity
from sitegauge.llm.queries import table, tokenizer_path
from sitegauge.session import stage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of them and of the text decoded from them."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", one_of_each_copy),
    ("secrets", without_secrets),
    ("mix", mixed),
    ("encode", encoded),
]
#: The models, fingerprints and token ids have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
