"""The training-data pipeline: documents in, token ids out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpengine.llm import jaccard, mixing, pieces, pii, toxicity
from fpengine.llm.common import ARROW_BYTES, BATCH, stage
from fpengine.session import prepare_session
from fpengine.sources.tables import table


def ready(spark: SparkSession) -> None:
    """A stage's last plan runs when its result is written, so the bound on its Arrow batches has to hold in the session."""
    prepare_session(spark)
    spark.conf.set(ARROW_BYTES, BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field rejects go; all others stay."""
    ready(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id stays."""
    ready(spark)
    return jaccard.keep_one_per_group(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms of the same format; n_chars stays true as formats keep
    their length (it is counted anew for values whose length may change)."""
    ready(spark)
    out = pii.pseudonymise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their targets."""
    ready(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    ready(spark)
    return pieces.encode(docs, keep=["doc_id", "lang", "source"])


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_each_group), ("pii", pseudonymise),
          ("mixing", mix_sources), ("sentencepiece", encode)]

#: trained models and hashed fingerprints are beyond SQL; tests/llm compares run() with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare_session(spark)
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
