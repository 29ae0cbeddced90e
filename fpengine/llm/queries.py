"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpengine.llm import audit, embeddings, jaccard, mixing, mixing_lm, pages, pieces, pii, pivots, suffixes, toxicity, whitening, winnowing
from fpengine.llm.common import crc_mod, whole_text
from fpengine.sources.tables import table

QUERIES = {}
#: SQL for the queries that SQL can express over whole tables; see README for the others
ORACLE: dict[str, str] = {}


def _query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@_query("op1_toxicity_crf")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crf = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    s = toxicity.score(docs, crf)
    return s.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", "spans")


@_query("op2_context_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score_texts(table(spark, sf_dir, "documents"))


@_query("op3_sentencepiece_viterbi")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(whole_text()).cast("long").alias("n_chars"), "text")
    return pieces.encode(docs, check="round_trip")


@_query("op4_feistel_pseudonyms")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_values")


@_query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


@_query("op6_suffix_repeats")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@_query("op7_itq_near_duplicates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@_query("op8_page_differencing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


@_query("op9_entropy_balancing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents")).drop("_tie")


@_query("op10_winnowing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_edits(table(spark, sf_dir, "documents"))


@_query("op11_polarisation_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@_query("op12_filter_audit")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op13_pivot_top_k")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"))


ORACLE["op12_filter_audit"] = audit.AUDIT_SQL
ORACLE["op13_pivot_top_k"] = pivots.TOP_SQL


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
