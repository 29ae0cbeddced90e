"""Aggregations (AGG1-AGG24). All grouping uses partial (map-side) aggregation; nothing
collects a whole group into one list."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .windows import _null_safe_join


def unpivot(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str], name: str = "feature",
            value: str = "value") -> DataFrame:
    """Wide -> long with values as text (null kept)."""
    return df.select(*id_cols, F.inline(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in value_cols])))


def value_distribution(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG1: per column and value: count, with the column's total and number of distinct values."""
    long = unpivot(df, [], cols)
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    per_col = counts.groupBy("feature").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("n_unique"))
    return counts.join(per_col, "feature")


def combination_distribution(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG2: counts of value combinations, grouped on the columns themselves."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("cnt"))


@F.pandas_udf(T.LongType())
def _ordered_bits(x: pd.Series) -> pd.Series:
    """Longs that sort as the doubles do (-0.0 as 0.0, NaN last)."""
    v = x.to_numpy(dtype=np.float64) + 0.0
    b = np.where(np.isnan(v), np.nan, v).view(np.int64)
    return pd.Series(b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


@F.pandas_udf(T.DoubleType())
def _from_bits(k: pd.Series) -> pd.Series:
    b = k.to_numpy(dtype=np.int64)
    return pd.Series((b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def exact_quantile(df: DataFrame, value_col: str, by: Sequence[str] = (), q: float = 0.5, out: str = "median") -> DataFrame:
    """Exact linear-interpolated quantile per group by radix selection: values are counted by the leading 16 bits of their order (map-side, at most
    65536 counts per group), the wanted ranks fall into one count each, and only values with that prefix are looked at for the
    next 16 bits. No value is sorted or moved; after 32 bits the few that are left are kept as counts. Nulls are left out, NaN sorts last."""
    grp = list(by)
    keyed = df.where(F.col(value_col).isNotNull()).select(*by, _ordered_bits(F.col(value_col).cast("double")).alias("_k"), F.lit(1).cast("long").alias("_c"))
    at = Window.partitionBy(*grp, "_w") if grp else Window.partitionBy("_w")
    hist = keyed.groupBy(*grp, F.shiftright("_k", 48).alias("_p")).agg(F.sum("_c").alias("_c")).withColumn("_w", F.lit(0))
    n = F.sum("_c").over(at)
    pos = (n - 1) * F.lit(q)
    hist = hist.withColumn("_n", n).withColumn("_ranks", F.array(F.floor(pos), F.ceil(pos)))
    hist = hist.withColumn("_upto", F.sum("_c").over(at.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
    state = hist.select(*grp, "_p", "_n", "_c", "_upto", F.posexplode("_ranks").alias("_w", "_r"))

    def pick(h: DataFrame) -> DataFrame:
        """The counts that hold the wanted ranks; ``_r`` becomes the rank inside. Two rows per group."""
        inside = h.where((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_c")))
        return inside.select(*grp, "_w", "_p", (F.col("_r") - (F.col("_upto") - F.col("_c"))).alias("_r"), "_n")

    state = cut_lineage(pick(state))
    kept = None
    for shift in (32, 16, 0):
        same = F.shiftright("_k", shift + 16) == F.col("_p")
        if kept is not None:
            met = _null_safe_join(kept.drop("_r", "_n"), state, [*grp, "_w"]).where(same)
        elif grp:
            met = _null_safe_join(keyed, state, grp).where(same)
        else:
            met = keyed.join(F.broadcast(state), same)  # two rows
        if shift == 16:  # what shares 32 bits with a wanted rank, as counts per value
            met = kept = cut_lineage(met.groupBy(*grp, "_w", "_k").agg(F.sum("_c").alias("_c"), F.first("_r").alias("_r"), F.first("_n").alias("_n")))
        h = met.groupBy(*grp, "_w", F.shiftright("_k", shift).alias("_p")).agg(F.sum("_c").alias("_c"), F.first("_r").alias("_r"), F.first("_n").alias("_n"))
        h = h.withColumn("_upto", F.sum("_c").over(at.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
        state = cut_lineage(pick(h))
    val = state.withColumn("_x", _from_bits("_p"))
    agg = [F.max(F.when(F.col("_w") == w, F.col("_x"))).alias(c) for w, c in ((0, "_lo"), (1, "_hi"))]
    res = val.groupBy(*grp).agg(*agg, F.first("_n").alias("_n"))
    frac = ((F.col("_n") - 1) * F.lit(q)) - F.floor((F.col("_n") - 1) * F.lit(q))
    return res.select(*grp, F.when(frac == 0, F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias(out))


def median_mad(df: DataFrame, value_col: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG11: exact median and raw (unscaled) MAD = median(|x - median|)."""
    med = exact_quantile(df, value_col, by, 0.5, "median")
    if by:
        dev = df.join(med, list(by)).select(*by, F.abs(F.col(value_col) - F.col("median")).alias("_d"))
        mad = exact_quantile(dev, "_d", by, 0.5, "mad")
        return med.join(mad, list(by))
    # global: the median is one number; it enters the next step as a literal (no join)
    m = med.first()["median"]
    dev = df.select(F.abs(F.col(value_col).cast("double") - F.lit(m)).alias("_d"))
    mad = exact_quantile(dev, "_d", (), 0.5, "mad").first()["mad"]
    spark = df.sparkSession
    return spark.createDataFrame([(m, mad)], "median double, mad double")


def entropy_importance(single: DataFrame, overall: DataFrame, *, type_col: str = "device_type",
                       id_col: str = "ip", threshold: float = 0.1) -> DataFrame:
    """AGG8 + AGG9. ``single``: (ip, device_type, perspective, cluster) single-perspective
    clusters; ``overall``: (ip, device_type, overall_cluster) the related devices of each
    overall cluster. Per (overall cluster, perspective): weights w_c = n_c / sum n over the
    non-noise single clusters of its members, H = -sum w ln w, normalised by ln M where M is
    the number of distinct single clusters of the type *including* noise (H/ln M = 0 when
    M <= 1); importance = 1 - H/ln M, L1-normalised over the perspectives of the overall
    cluster; is_important = H/ln M < threshold."""
    m = single.groupBy(type_col, "perspective").agg(F.countDistinct("cluster").alias("M"))
    j = overall.join(single, [id_col, type_col]).where(F.col("cluster") != -1)
    counts = j.groupBy(type_col, "overall_cluster", "perspective", "cluster").agg(F.count(F.lit(1)).alias("n_c"))
    tot = Window.partitionBy(type_col, "overall_cluster", "perspective")
    w = counts.withColumn("w", F.col("n_c") / F.sum("n_c").over(tot))
    ent = w.groupBy(type_col, "overall_cluster", "perspective").agg(
        F.sum(F.when(F.col("w") > 0, -F.col("w") * F.log(F.col("w"))).otherwise(F.lit(0.0))).alias("entropy"),
        F.count(F.lit(1)).alias("n_single_clusters"))
    ent = ent.join(m, [type_col, "perspective"])
    norm = F.when(F.col("M") > 1, F.col("entropy") / F.log(F.col("M").cast("double"))).otherwise(F.lit(0.0))
    ent = ent.withColumn("norm_entropy", norm).withColumn("raw_importance", 1 - F.col("norm_entropy"))
    per = Window.partitionBy(type_col, "overall_cluster")
    s = F.sum("raw_importance").over(per)
    return ent.withColumn("importance", F.when(s > 0, F.col("raw_importance") / s).otherwise(F.col("raw_importance"))) \
        .withColumn("is_important", F.col("norm_entropy") < threshold)


def cluster_weights(single: DataFrame, overall: DataFrame, *, type_col: str = "device_type", id_col: str = "ip") -> DataFrame:
    """The per single-cluster weights w_c used by AGG8/AGG10."""
    j = overall.join(single, [id_col, type_col]).where(F.col("cluster") != -1)
    counts = j.groupBy(type_col, "overall_cluster", "perspective", "cluster").agg(F.count(F.lit(1)).alias("n_c"))
    tot = Window.partitionBy(type_col, "overall_cluster", "perspective")
    return counts.withColumn("w", F.col("n_c") / F.sum("n_c").over(tot))


def mode_per_group(df: DataFrame, group_col: str, value_col: str, out: str = "canonical") -> DataFrame:
    """AGG14: most frequent value per group; ties -> smallest value."""
    c = df.groupBy(group_col, value_col).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(group_col).agg(F.min_by(value_col, F.struct((-F.col("_n")).alias("a"), F.col(value_col).alias("b"))).alias(out),
                                 F.max("_n").alias("count"))


def first_hits_stats(hits: DataFrame, query_col: str, rank_col: str, label_col: str, n: int = 5) -> DataFrame:
    """AGG15: among the first ``n`` hits: most common label (ties: smallest), its share and
    the number of distinct labels."""
    top = hits.where(F.col(rank_col) <= n)
    c = top.groupBy(query_col, label_col).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(query_col).agg(
        F.min_by(label_col, F.struct((-F.col("_n")).alias("a"), F.col(label_col).alias("b"))).alias("most_common"),
        (F.max("_n") / F.sum("_n")).alias("ratio"),
        F.count(F.lit(1)).alias("diversity"))


def positive_similarity_stats(sims: DataFrame, key_col: str, flag_col: str, sim_col: str) -> DataFrame:
    """AGG16: mean and min of the positive similarities, split by a key/non-key flag
    (0 when there is none)."""
    pos = F.col(sim_col) > 0
    key = F.col(flag_col)
    return sims.groupBy(key_col).agg(
        F.coalesce(F.avg(F.when(pos & key, F.col(sim_col))), F.lit(0.0)).alias("key_mean"),
        F.coalesce(F.min(F.when(pos & key, F.col(sim_col))), F.lit(0.0)).alias("key_min"),
        F.coalesce(F.avg(F.when(pos & ~key, F.col(sim_col))), F.lit(0.0)).alias("other_mean"),
        F.coalesce(F.min(F.when(pos & ~key, F.col(sim_col))), F.lit(0.0)).alias("other_min"))


def f1_buckets(df: DataFrame, f1_col: str, support_col: str, bounds: Sequence[float]) -> DataFrame:
    """AGG20: half-open buckets [b_i, b_{i+1}) (last bucket closed), count and support."""
    expr = None
    for i in range(len(bounds) - 1):
        lo, hi = bounds[i], bounds[i + 1]
        last = i == len(bounds) - 2
        cond = (F.col(f1_col) >= lo) & ((F.col(f1_col) <= hi) if last else (F.col(f1_col) < hi))
        label = f"[{lo}, {hi}]" if last else f"[{lo}, {hi})"
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return df.withColumn("bucket", expr).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_classes"), F.sum(support_col).alias("support"))


def weighted_mean(df: DataFrame, value_col: str, weight_col: str) -> Column:
    """AGG21 expression: sum(v*w)/sum(w)."""
    return F.sum(F.col(value_col) * F.col(weight_col)) / F.sum(F.col(weight_col))


def drift_explanation(ref: DataFrame, test: DataFrame, persp_col: str, value_col: str, alpha: dict,
                      default_alpha: float = 0.5, thr: float = 3.5, floor: float = 1e-10) -> DataFrame:
    """AGG12: per perspective, z = |x - median_ref| / max(MAD_ref, floor) on the later set;
    mean z, share of z > thr, alpha * mean z; ordered by the weighted score."""
    stats = median_mad(ref, value_col, [persp_col])
    a = F.coalesce(F.element_at(F.create_map(*[x for k, v in alpha.items() for x in (F.lit(k), F.lit(float(v)))]),
                                F.col(persp_col)), F.lit(default_alpha))
    z = test.join(stats, persp_col).withColumn(
        "z", F.abs(F.col(value_col) - F.col("median")) / F.greatest(F.col("mad"), F.lit(floor)))
    return z.groupBy(persp_col).agg(F.avg("z").alias("mean_z"), F.avg((F.col("z") > thr).cast("double")).alias("share_over"),
                                    F.first(a).alias("alpha")) \
        .withColumn("weighted", F.col("alpha") * F.col("mean_z"))
