"""Text -> vector encoders (VEC8, VEC9).

The original embeds text with a transformer model, one row per call. Here the default
encoder is a hashed, IDF-weighted bag of words with unit norm (pyspark.ml HashingTF + IDF),
applied to *distinct* texts only and joined back, so repeated texts cost nothing. Any other
encoder can be passed where an ``encoder`` argument exists (a pandas UDF is the place for a
model)."""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.scalar import chunk_text
from ..session import stage_table
from .vectormean import mean_vectors


def word_tokens(text_col) -> F.Column:
    t = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashed_text_vectors(df: DataFrame, key_col: str, text_col: str, dim: int = 256) -> DataFrame:
    """VEC8: (key, text) -> (key, vec) with vec a unit-norm hashed tf-idf of the words.
    Texts are de-duplicated before encoding (IDF is fitted on the distinct texts)."""
    distinct = df.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_tk"), F.col(text_col).alias("_t")) \
        .dropDuplicates(["_tk"]).withColumn("_w", word_tokens("_t"))
    # the fit and the weighting both read the counts: texts are made distinct and cut into words once
    tf = stage_table(HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim).transform(distinct).select("_tk", "_tf"), "text-counts")
    idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(tf).transform(tf)
    enc = idf.select("_tk", V.l2_normalize(vector_to_array("_tfidf")).alias("vec"))
    keyed = df.select(F.col(key_col), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_tk"))
    return keyed.join(enc, "_tk").drop("_tk")


def chunked_text_vectors(df: DataFrame, key_col: str, text_col: str, dim: int = 256,
                         max_length: int = 500, overlap: int = 50) -> DataFrame:
    """VEC9: split every whole text into overlapping chunks (FN5), encode the chunks, average
    them element-wise per text and re-normalise."""
    chunks = df.select(F.col(key_col), F.explode(chunk_text(text_col, max_length, overlap)).alias("_chunk"))
    enc = hashed_text_vectors(chunks, key_col, "_chunk", dim)
    return mean_vectors(enc, [key_col], "vec", "_m").select(key_col, V.l2_normalize("_m").alias("vec"))
