"""Feature construction (ML7-ML11, ML13, ML21) in long form ``(row_id, feature, value)``.

Sparse features stay long (one row per non-zero) so that vocabulary size never becomes a
column count; dense vectors are assembled only where an algorithm needs them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WS_TRIM = r"^\s+|\s+$"


def comma_tokens(text) -> Column:
    """FN3: split on ',', strip whitespace, drop blanks (text lower-cased first, as the
    vectoriser does before tokenising)."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.lower(F.coalesce(t.cast("string"), F.lit(""))), ",")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, _WS_TRIM, "")), lambda x: x != "")


def tfidf_fit(df: DataFrame, id_col: str, text_col: str, max_features: int) -> DataFrame:
    """ML7 fit: vocabulary = the ``max_features`` terms of largest corpus frequency
    (ties: term ascending); idf = ln((1+n)/(1+df)) + 1 over all n rows.
    Returns (term, idf, term_index). The vocabulary is bounded by ``max_features``."""
    n_docs = df.select(id_col).count()
    toks = df.select(F.col(id_col), F.explode(comma_tokens(text_col)).alias("term"))
    stats = toks.groupBy("term").agg(F.count(F.lit(1)).alias("ctf"), F.countDistinct(id_col).alias("df"))
    vocab = stats.orderBy(F.col("ctf").desc(), F.col("term").asc()).limit(max_features)
    w = Window.orderBy("term")  # at most max_features rows: a bounded single-task window
    return vocab.select("term", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"),
                        (F.row_number().over(w) - 1).alias("term_index"))


def tfidf_transform(df: DataFrame, id_col: str, text_col: str, vocab: DataFrame) -> DataFrame:
    """ML7 transform: sublinear tf (1 + ln tf) x idf, L2-normalised per row over the
    vocabulary; rows with no vocabulary term produce no entries.
    Output: id, term, term_index, tfidf."""
    toks = df.select(F.col(id_col), F.explode(comma_tokens(text_col)).alias("term"))
    tf = toks.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    j = tf.join(F.broadcast(vocab), "term")  # vocab size bounded by max_features
    raw = j.withColumn("_w", (F.lit(1.0) + F.log(F.col("tf"))) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", "term_index", (F.col("_w") / norm).alias("tfidf"))


def onehot_fit(df: DataFrame, col: str) -> DataFrame:
    """ML8 fit: sorted categories (null -> 'UNK')."""
    v = F.coalesce(F.col(col).cast("string"), F.lit("UNK"))
    return df.select(v.alias("category")).distinct()


def onehot_transform(df: DataFrame, id_col: str, col: str, categories: DataFrame) -> DataFrame:
    """ML8 transform: one row ``(id, feature='<col>_<value>', 1.0)`` per known category;
    an unseen category yields no entry (an all-zero block)."""
    v = F.coalesce(F.col(col).cast("string"), F.lit("UNK"))
    return (df.select(F.col(id_col), v.alias("category")).join(categories, "category")
            .select(id_col, F.concat(F.lit(f"{col}_"), F.col("category")).alias("feature"), F.lit(1.0).alias("value")))


def numeric_feature(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """FN21: numeric coercion with default 0."""
    return df.select(id_col, F.lit(col).alias("feature"),
                     F.coalesce(F.col(col).cast("string").try_cast("double"), F.lit(0.0)).alias("value"))


def max_abs_scale(long_df: DataFrame, feature_col: str = "feature", value_col: str = "value") -> DataFrame:
    """ML10: divide each feature by its largest absolute value (0 stays 0)."""
    m = long_df.groupBy(feature_col).agg(F.max(F.abs(value_col)).alias("_m"))
    return long_df.join(m, feature_col).withColumn(
        value_col, F.when(F.col("_m") > 0, F.col(value_col) / F.col("_m")).otherwise(F.col(value_col))).drop("_m")


def standard_scale_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ML21 fit: mean and *population* std per column (one row)."""
    return df.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}__std") for c in cols])


def standard_scale_apply(df: DataFrame, cols: Sequence[str], stats_row) -> DataFrame:
    """ML21 apply with fitted stats (std 0 -> 1, like the reference scaler)."""
    out = df
    for c in cols:
        mu = stats_row[f"{c}__mean"]
        sd = stats_row[f"{c}__std"] or 1.0
        out = out.withColumn(c, (F.col(c) - F.lit(mu)) / F.lit(sd))
    return out


def balanced_class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """ML13: weight n / (k * n_c) per class. n and k come from a window over the
    per-class table (one row per class)."""
    per = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    all_ = Window.partitionBy()
    return per.select(label_col, "n_c", (F.sum("n_c").over(all_) / (F.count(F.lit(1)).over(all_) * F.col("n_c"))).alias("class_weight"))
