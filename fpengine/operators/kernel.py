"""Kernel classifier over a grid (ML12): least-squares support vectors on random Fourier features of the RBF kernel.

One pass gives the scale of the features, one pass the weighted sums Z'Z and Z'Y of every (gamma, fold), and one pass the held-out predictions of
the whole grid. A fold's training sums are the total less its own, and all costs C are solved from the same sums, so the grid needs no pass per point
and no iteration that could end early. A task sends a matrix per (gamma, fold), whose size follows from the number of features alone; the matrices
are added up in two levels.

Defined results: rows whose features are null, of another length or not finite, or whose label, weight or fold is null, take no part in the fit and are
not predicted; equal scores go to the smaller label; an empty training set raises.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 64  # of the first level of adding up
ROWS = 4_096  # rows expanded at once


def _good(df: DataFrame, x: str, dim: int | None, *needed: str) -> DataFrame:
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    out = df.where(F.col(x).isNotNull() & (F.size(x) > 0) & ~bad)
    for c in needed:
        out = out.where(F.col(c).isNotNull())
    return out if dim is None else out.where(F.size(x) == dim)


def _sum_up(parts: DataFrame, *keys: str) -> DataFrame:
    """Sums of equally long binary arrays of doubles per key: (keys, sum), first within buckets, then over them."""
    def add(key, pdf):
        total = np.sum([np.frombuffer(b) for b in pdf["sum"]], axis=0)
        return pd.DataFrame([[*key, total.tobytes()]])

    kinds = [(k, dict(parts.dtypes)[k]) for k in (*keys, "bucket")]
    for level in (kinds, kinds[:-1]):
        parts = parts.groupBy(*[k for k, _ in level]).applyInPandas(add, ", ".join(f"{k} {t}" for k, t in level) + ", sum binary")
    return parts


class KernelClassifier:
    """Fitted by ``fit_grid``: ``grid`` (gamma, c, cv_macro_f1 as a list of rows), the best point, and ``predict``."""

    def __init__(self, spark, mean, scale, base, gamma, coef, labels):
        self.spark, self.gamma, self.coef, self.labels = spark, gamma, coef, labels
        self.mean, self.scale, self.base = mean, scale, base

    def predict(self, df: DataFrame, x_col: str = "x") -> DataFrame:
        """``df`` with ``prediction`` (a label) and ``margin`` (its score); rows without usable features go."""
        held = self.spark.sparkContext.broadcast((self.mean, self.scale, self.base, self.gamma, self.coef, np.array(self.labels, dtype=np.float64)))

        @F.pandas_udf("prediction double, margin double")
        def score(x: pd.Series) -> pd.DataFrame:
            mean, scale, base, gamma, coef, labels = held.value
            out = [fourier((np.vstack(x.iloc[i:i + ROWS].to_numpy()) - mean) / scale, base, gamma) @ coef for i in range(0, len(x), ROWS)]
            s = np.vstack(out) if out else np.empty((0, len(labels)))
            return pd.DataFrame({"prediction": labels[s.argmax(axis=1)], "margin": s.max(axis=1)})

        good = _good(df, x_col, len(self.mean)).withColumn("_s", score(F.col(x_col)))
        return good.select(*df.columns, F.col("_s.prediction").alias("prediction"), F.col("_s.margin").alias("margin"))


def fourier(x: np.ndarray, base: np.ndarray, gamma: float) -> np.ndarray:
    """Columns whose inner products approach exp(-gamma |x - y|^2), and a column of ones."""
    p = np.sqrt(2.0 * gamma) * (x @ base)
    return np.hstack([np.cos(p) / np.sqrt(base.shape[1]), np.sin(p) / np.sqrt(base.shape[1]), np.ones((len(x), 1))])


def solve(a: np.ndarray, b: np.ndarray, cost: float) -> np.ndarray:
    """Coefficients of the least squares with a penalty of 1 / cost on all but the constant."""
    penalty = np.full(len(a), 1.0 / cost)
    penalty[-1] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), b)


def fit_grid(train: DataFrame, *, gammas=(0.25, 1.0, 4.0), costs=(0.1, 1.0, 10.0), features: int = 256, seed: int = 7,
             x_col: str = "x", label_col: str = "label", fold_col: str = "fold", weight_col: str = "weight") -> KernelClassifier:
    """Fit every (gamma, c) on all folds but one, choose by the mean macro-F1 over the folds (ties: first in the grid), fit the best on all rows.
    ``gammas`` are in units of 1 / dimensions of the standardised features; ``features`` is the number of Fourier columns."""
    spark = train.sparkSession
    first = _good(train, x_col, None).groupBy(F.size(x_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if first is None:
        raise ValueError("no usable training rows")
    dim = first["d"]
    rows = _good(train, x_col, dim, label_col, fold_col, weight_col).select(
        F.col(x_col).alias("x"), F.col(label_col).cast("double").alias("label"), F.col(fold_col).cast("int").alias("fold"),
        F.col(weight_col).cast("double").alias("weight"))
    task = F.pmod(F.spark_partition_id(), F.lit(BUCKETS)).alias("bucket")
    rows = rows.select("*", task)
    labels = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]  # the classes
    folds = [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    at = {v: i for i, v in enumerate(labels)}

    def moments(batches):
        total, bucket = np.zeros(2 * dim + 1), 0
        for b in batches:
            if len(b):
                x = np.vstack(b["x"].to_numpy())
                total += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
                bucket = int(b["bucket"].iloc[0])
        yield pd.DataFrame({"bucket": np.array([bucket], dtype=np.int32), "one": np.int32(0), "sum": [total.tobytes()]})

    got = np.frombuffer(_sum_up(rows.mapInPandas(moments, "bucket int, one int, sum binary"), "one").first()["sum"])
    n = got[-1]
    mean = got[:dim] / n
    var = np.maximum(got[dim:2 * dim] / n - mean * mean, 0.0)
    scale = np.where(var > 1e-12, np.sqrt(var), 1.0)
    base = np.random.default_rng(seed).normal(size=(dim, features // 2))
    scaled = [g / dim for g in gammas]
    held = spark.sparkContext.broadcast((mean, scale, base))
    wide, k = 2 * (features // 2) + 1, len(labels)

    def sums(batches):
        mean, scale, base = held.value
        acc, bucket = {}, 0
        for b in batches:
            for i in range(0, len(b), ROWS):
                part = b.iloc[i:i + ROWS]
                bucket = int(part["bucket"].iloc[0])
                x = (np.vstack(part["x"].to_numpy()) - mean) / scale
                w, fold = part["weight"].to_numpy(), part["fold"].to_numpy()
                y = np.full((len(x), k), -1.0)
                y[np.arange(len(x)), [at[v] for v in part["label"]]] = 1.0
                for g, gamma in enumerate(scaled):
                    z = fourier(x, base, gamma)
                    for f in np.unique(fold):
                        m = fold == f
                        zw = z[m] * w[m, None]
                        s = np.hstack([zw.T @ z[m], zw.T @ y[m]])
                        acc[g, f] = acc[g, f] + s if (g, f) in acc else s
        for (g, f), s in acc.items():
            yield pd.DataFrame({"bucket": np.array([bucket], dtype=np.int32), "g": np.int32(g), "fold": np.int32(f), "sum": [s.tobytes()]})

    found = _sum_up(rows.mapInPandas(sums, "bucket int, g int, fold int, sum binary"), "g", "fold").collect()  # gammas x folds matrices
    part = {(r["g"], r["fold"]): np.frombuffer(r["sum"]).reshape(wide, wide + k) for r in found}
    total = {g: sum(part[g, f] for f in folds) for g in range(len(scaled))}
    coefs = {(g, c, f): solve(*np.split(total[g] - part[g, f], [wide], axis=1), cost)
             for g in range(len(scaled)) for c, cost in enumerate(costs) for f in folds}
    models = spark.sparkContext.broadcast(coefs)

    def judge(batches):
        mean, scale, base = held.value
        counts: dict[tuple, int] = {}
        for b in batches:
            for i in range(0, len(b), ROWS):
                piece = b.iloc[i:i + ROWS]
                x = (np.vstack(piece["x"].to_numpy()) - mean) / scale
                fold, true = piece["fold"].to_numpy(), np.array([at[v] for v in piece["label"]])
                for g, gamma in enumerate(scaled):
                    z = fourier(x, base, gamma)
                    for f in np.unique(fold):
                        m = fold == f
                        for c in range(len(costs)):
                            cell = true[m] * k + (z[m] @ models.value[g, c, int(f)]).argmax(axis=1)
                            for v, many in zip(*np.unique(cell, return_counts=True)):
                                key = (g, c, int(f), int(v) // k, int(v) % k)
                                counts[key] = counts.get(key, 0) + int(many)
        if counts:
            yield pd.DataFrame([(*key, v) for key, v in counts.items()], columns=["g", "c", "fold", "t", "p", "n"])

    cells = rows.mapInPandas(judge, "g int, c int, fold int, t int, p int, n long").groupBy("g", "c", "fold", "t", "p").agg(F.sum("n").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    point = ["g", "c", "fold"]
    sides = cells.select(*point, F.col("t").alias("k"), F.col("n"), hit.alias("hit")).unionByName(
        cells.select(*point, F.col("p").alias("k"), F.col("n"), F.lit(0).alias("hit")))
    f1 = sides.groupBy(*point, "k").agg((2 * F.sum("hit") / F.sum("n")).alias("f1"))  # 2 TP / (2 TP + FP + FN)
    score = f1.groupBy(*point).agg(F.avg("f1").alias("f1")).groupBy("g", "c").agg(F.avg("f1").alias("f1")).orderBy("g", "c").collect()
    best = max(score, key=lambda r: (r["f1"], -r["g"], -r["c"]))
    a, b = np.split(total[best["g"]], [wide], axis=1)
    model = KernelClassifier(spark, mean, scale, base, scaled[best["g"]], solve(a, b, costs[best["c"]]), labels)
    model.grid = [(float(gammas[r["g"]]), float(costs[r["c"]]), float(r["f1"])) for r in score]
    model.best = (float(gammas[best["g"]]), float(costs[best["c"]]))
    return model
