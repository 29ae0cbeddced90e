"""Drift detection (ML16-ML21, AGG11, AGG12).

The autoencoder of the original is re-aimed as a linear reconstruction: PCA fitted on the
reference snapshot. For a row x (standardised with the reference statistics),
x_hat = mu + (x - mu) P P^T; the perspective score is the mean squared residual over the
perspective's features and the drift score is sum_p alpha_p * score_p. A later row drifts
when its score exceeds median + 3.5 * MAD of the reference scores (strictly).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DRIFT_ALPHA, DRIFT_ALPHA_DEFAULT, MAD_FLOOR, MAD_THRESHOLD
from .aggregate import median_mad
from .windows import distributed_row_number, seeded_order


def assemble_dense(long_df: DataFrame, id_col: str, feature_index: DataFrame, dim: int,
                   feature_col: str = "feature", value_col: str = "value") -> DataFrame:
    """ML9: long (id, feature, value) -> dense ``array<double>`` of length ``dim`` using a
    fitted feature index (feature -> idx, perspective). Missing features are 0."""
    j = long_df.join(F.broadcast(feature_index.select(feature_col, "idx")), feature_col)  # index bounded by dim
    packed = j.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("idx", value_col))).alias("_m"))
    return packed.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                             lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0))).alias("x"))


def fit_standardizer(ref: DataFrame, dim: int) -> tuple[list[float], list[float]]:
    """ML21 fit: per-dimension mean and population std on the reference rows (std 0 -> 1).
    Returns two vectors of length ``dim`` (driver-side, bounded by ``dim``)."""
    aggs = [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(dim)] + \
           [F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(dim)]
    row = ref.agg(*aggs).first()
    mu = [float(row[f"m{i}"] or 0.0) for i in range(dim)]
    sd = [float(row[f"s{i}"] or 0.0) or 1.0 for i in range(dim)]
    return mu, sd


def standardize(df: DataFrame, mu: Sequence[float], sd: Sequence[float]) -> DataFrame:
    m = F.array(*[F.lit(v) for v in mu])
    s = F.array(*[F.lit(v) for v in sd])
    return df.withColumn("x", F.zip_with(F.zip_with("x", m, lambda a, b: a - b), s, lambda a, b: a / b))


def fit_pca(ref: DataFrame, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal components of the reference rows via the distributed covariance
    (pyspark.ml RowMatrix-free: mean and Gram matrix are aggregated, dim x dim)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    mu = np.array(ref.agg(*[F.avg(F.col("x")[i]) for i in range(dim)]).first(), dtype=float)
    centred = ref.select(F.zip_with("x", F.array(*[F.lit(float(v)) for v in mu]), lambda a, b: a - b).alias("x"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(centred.select(array_to_vector("x").alias("v")))
    return mu, model.pc.toArray()


def perspective_scores(df: DataFrame, mu: np.ndarray, pcs: np.ndarray, groups: dict[str, list[int]],
                       alpha: dict | None = None, default_alpha: float = DRIFT_ALPHA_DEFAULT) -> DataFrame:
    """ML16: per-perspective mean squared residual of the linear reconstruction and the
    alpha-weighted total ``drift_score``. Projection matrix P P^T is a literal (dim x dim)."""
    alpha = alpha if alpha is not None else DRIFT_ALPHA
    proj = pcs @ pcs.T
    mu_l = F.array(*[F.lit(float(v)) for v in mu])
    c = F.zip_with("x", mu_l, lambda a, b: a - b)
    rows = [F.array(*[F.lit(float(v)) for v in proj[i]]) for i in range(proj.shape[0])]
    # residual_i = c_i - sum_j P_ij c_j
    resid = F.array(*[F.col("_c")[i] - F.aggregate(F.zip_with(rows[i], "_c", lambda a, b: a * b), F.lit(0.0),
                                                       lambda acc, v: acc + v) for i in range(proj.shape[0])])
    out = df.withColumn("_c", c).withColumn("_r", resid)
    total = None
    for name, idx in groups.items():
        sq = sum((F.col("_r")[i] * F.col("_r")[i] for i in idx), F.lit(0.0))
        out = out.withColumn(f"score_{name}", sq / F.lit(float(len(idx))))
        term = F.lit(float(alpha.get(name, default_alpha))) * F.col(f"score_{name}")
        total = term if total is None else total + term
    return out.withColumn("drift_score", total).drop("_c", "_r")


def detect(ref_scores: DataFrame, test_scores: DataFrame, score_col: str = "drift_score",
           thr: float = MAD_THRESHOLD, floor: float = MAD_FLOOR) -> tuple[DataFrame, DataFrame]:
    """ML17: is_drift = score > median + thr * max(MAD, floor) of the reference scores."""
    stats = median_mad(ref_scores, score_col).withColumn(
        "threshold", F.col("median") + F.lit(thr) * F.greatest("mad", F.lit(floor)))
    row = stats.first()  # one row of three numbers
    flagged = test_scores.withColumn("median", F.lit(row["median"])).withColumn("mad", F.lit(row["mad"])) \
        .withColumn("threshold", F.lit(row["threshold"])) \
        .withColumn("is_drift", F.col(score_col) > F.col("threshold"))
    return flagged, stats


def contrastive_pairs(df: DataFrame, id_col: str, label_col: str, seed: int = 42, same_share: int = 4) -> DataFrame:
    """ML19: one partner per row; a quarter of the rows (md5 bucket 0 of ``same_share``)
    take a partner of the same class, the others one of another class. Partners are found by
    equi-joins on (class, position) computed from seeded hashes, never by pairing rows."""
    numbered = distributed_row_number(df.select(id_col, label_col), [label_col], [seeded_order(id_col, seed), F.col(id_col)], out="_pos")
    sizes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    classes = sizes.orderBy(label_col).collect()  # one row per class: bounded by the class count
    labels = [r[label_col] for r in classes]
    ncls = len(labels)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|pair|"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("long")
    lab_arr = F.array(*[F.lit(v) for v in labels])
    own_idx = F.array_position(lab_arr, F.col(label_col)) - 1
    same = F.pmod(h, F.lit(same_share)) == 0
    other_idx = F.pmod(own_idx + 1 + F.pmod(F.floor(h / same_share), F.lit(max(ncls - 1, 1))), F.lit(ncls))
    base = numbered.join(sizes, label_col).withColumn("_same", same | F.lit(ncls < 2)) \
        .withColumn("_plabel", F.when(F.col("_same"), F.col(label_col)).otherwise(F.element_at(lab_arr, (other_idx + 1).cast("int"))))
    base = base.join(sizes.select(F.col(label_col).alias("_plabel"), F.col("_n").alias("_pn")), "_plabel") \
        .withColumn("_ppos", F.pmod(F.col("_pos") + F.floor(h / 7), F.col("_pn")) + 1)
    partners = numbered.select(F.col(label_col).alias("_plabel"), F.col("_pos").alias("_ppos"), F.col(id_col).alias("partner_id"))
    return base.join(partners, ["_plabel", "_ppos"]).select(id_col, label_col, "partner_id", F.col("_plabel").alias("partner_label"),
                                                           F.col("_same").alias("same_class"))


def contrastive_loss(pairs: DataFrame, resid: DataFrame, id_col: str, groups: dict[str, list[int]],
                     alpha: dict | None = None, margin: float = 1.0) -> DataFrame:
    """ML18: perspective-weighted residual distance of a pair,
    d = sum_p alpha_p * mean_{i in p} (r_a,i - r_b,i)^2; loss = d for same-class pairs and
    max(0, margin - d)^2 otherwise."""
    alpha = alpha if alpha is not None else DRIFT_ALPHA
    a = resid.select(F.col(id_col), F.col("r").alias("_ra"))
    b = resid.select(F.col(id_col).alias("partner_id"), F.col("r").alias("_rb"))
    j = pairs.join(a, id_col).join(b, "partner_id")
    d = None
    for name, idx in groups.items():
        sq = sum(((F.col("_ra")[i] - F.col("_rb")[i]) * (F.col("_ra")[i] - F.col("_rb")[i]) for i in idx), F.lit(0.0))
        term = F.lit(float(alpha.get(name, DRIFT_ALPHA_DEFAULT))) * sq / F.lit(float(len(idx)))
        d = term if d is None else d + term
    j = j.withColumn("distance", d)
    return j.withColumn("loss", F.when(F.col("same_class"), F.col("distance"))
                        .otherwise(F.pow(F.greatest(F.lit(0.0), F.lit(margin) - F.col("distance")), 2))) \
        .drop("_ra", "_rb")
