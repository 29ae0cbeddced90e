"""Evaluation metrics (MET1-MET10) over (true, pred) DataFrames. The confusion table is
aggregated first (classes x classes rows), every metric is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normalize_label, normalize_vendor


def single_class_metrics(df: DataFrame, true_col: str, pred_col: str, by: str | None = None) -> DataFrame:
    """MET1: accuracy and the F1 of a one-class file where precision is 1: 2a/(1+a)."""
    acc = F.avg((F.col(true_col) == F.col(pred_col)).cast("double"))
    g = df.groupBy(by) if by else df.groupBy()
    return g.agg(acc.alias("accuracy"), F.count(F.lit(1)).alias("n")) \
        .withColumn("single_class_f1", 2 * F.col("accuracy") / (1 + F.col("accuracy")))


def confusion(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """AGG18: (true, pred, count)."""
    return df.groupBy(F.col(true_col).alias("true_label"), F.col(pred_col).alias("pred_label")) \
        .agg(F.count(F.lit(1)).alias("cnt"))


def per_class(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """MET2: per class (union of true and predicted labels) TP, FP, FN, TN, precision,
    recall, F1, support; zero division -> 0."""
    conf = confusion(df, true_col, pred_col)
    by_true = conf.groupBy(F.col("true_label").alias("label")).agg(
        F.sum("cnt").alias("support"), F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("cnt")).otherwise(0)).alias("tp"))
    by_pred = conf.groupBy(F.col("pred_label").alias("label")).agg(F.sum("cnt").alias("predicted"))
    j = by_true.join(by_pred, "label", "full").na.fill(0, ["support", "tp", "predicted"])
    j = j.withColumn("_n", F.sum("support").over(Window.partitionBy()))  # window over one row per class
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    out = j.select("label", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"),
                   (F.col("_n") - F.col("support") - F.col("predicted") + F.col("tp")).alias("tn"),
                   p.alias("precision"), r.alias("recall"), "support")
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return out.withColumn("f1", f1)


def summary(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """MET3: accuracy, macro precision/recall/F1 over the union of classes, micro F1,
    support-weighted F1 (AGG21)."""
    pc = per_class(df, true_col, pred_col)
    return pc.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        (F.sum("tp") / F.sum("support")).alias("micro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def topk_accuracy(df: DataFrame, truth_col: str, top_col: str) -> DataFrame:
    """MET4: top-1 and top-3 accuracy of normalised vendor names over labelled keys."""
    t = normalize_vendor(F.col(truth_col))
    tops = F.transform(F.col(top_col), lambda v: normalize_vendor(v))
    return df.agg(F.avg((F.element_at(tops, 1) == t).cast("double")).alias("top1"),
                  F.avg(F.array_contains(F.slice(tops, 1, 3), t).cast("double")).alias("top3"),
                  F.count(F.lit(1)).alias("n"))


def identification(df: DataFrame, pred_col: str, n_top: int = 5) -> tuple[DataFrame, DataFrame]:
    """MET5: identification rate (prediction not 'unknown') and the ``n_top`` most common
    predictions with their share among the identified."""
    norm = df.select(normalize_vendor(F.col(pred_col)).alias("p"))
    rate = norm.agg(F.avg((F.col("p") != "unknown").cast("double")).alias("identification_rate"), F.count(F.lit(1)).alias("n"))
    ident = norm.where(F.col("p") != "unknown")
    counts = ident.groupBy("p").agg(F.count(F.lit(1)).alias("cnt"))
    tot = ident.agg(F.count(F.lit(1)).alias("_t"))
    top = counts.orderBy(F.col("cnt").desc(), F.col("p")).limit(n_top)
    t = tot.first()["_t"]  # one number
    top = top.select(F.col("p").alias("vendor"), "cnt", (F.col("cnt") / F.lit(t)).alias("share"))
    return rate, top


def recognition(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """MET6 / MET7: per true class support, correct, misclassified, accuracy."""
    ok = (F.col(true_col) == F.col(pred_col)).cast("long")
    return df.groupBy(F.col(true_col).alias("label")).agg(
        F.count(F.lit(1)).alias("support"), F.sum(ok).alias("correct")) \
        .withColumn("misclassified", F.col("support") - F.col("correct")) \
        .withColumn("accuracy", F.col("correct") / F.col("support"))


def normalised_per_class(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """MET8: MET2 after normalising both label columns (FN2)."""
    n = df.select(normalize_label(F.col(true_col)).alias("t"), normalize_label(F.col(pred_col)).alias("p"))
    return per_class(n, "t", "p")


def hinge_loss(df: DataFrame, scores_col: str, label_idx_col: str) -> DataFrame:
    """MET9: mean of max(0, 1 - (s_y - max_{j != y} s_j)) over rows (label index 0-based)."""
    s = F.col(scores_col)
    y = F.col(label_idx_col)
    sy = F.element_at(s, (y + 1).cast("int"))
    others = F.array_max(F.filter(F.transform(s, lambda v, i: F.when(i != y, v)), lambda v: v.isNotNull()))
    return df.agg(F.avg(F.greatest(F.lit(0.0), 1 - (sy - others))).alias("hinge_loss"))
