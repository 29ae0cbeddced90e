"""Clustering (ML1-ML6, VEC10, AGG4).

ML1 re-aims the single-machine hierarchical density clusterer as distributed DBSCAN*:
a point is *core* when at least ``min_samples`` points (itself included) lie within
``eps``; clusters are the connected components of the core-core neighbour graph; a
non-core point with a core neighbour joins the component of its smallest-labelled core
neighbour; components smaller than ``min_cluster_size`` become noise (-1); when every
point is noise the whole set is one cluster 0. Cluster ids are dense, ordered by the
smallest member id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .knn import exact_range_pairs
from .vectormean import mean_vectors
from .windows import distributed_row_number


def connected_components(vertices: DataFrame, edges: DataFrame, *, id_col: str = "id",
                         src: str = "src", dst: str = "dst") -> DataFrame:
    """Label = smallest vertex id of the component. Min-label propagation with pointer
    jumping (label <- label of label), each round cut by a reliable checkpoint; stops when
    no label changes. Output: id, component."""
    und = edges.select(F.col(src).alias("_a"), F.col(dst).alias("_b")) \
        .unionByName(edges.select(F.col(dst).alias("_a"), F.col(src).alias("_b"))).distinct()
    und = cut_lineage(und)
    labels = cut_lineage(vertices.select(F.col(id_col).alias("_id")).distinct()
                         .withColumn("_l", F.col("_id")))
    while True:
        nb = und.join(labels.select(F.col("_id").alias("_a"), "_l"), "_a") \
            .groupBy("_b").agg(F.min("_l").alias("_nl"))
        step = labels.join(nb.withColumnRenamed("_b", "_id"), "_id", "left") \
            .select("_id", F.col("_l").alias("_old"), F.least("_l", F.coalesce("_nl", "_l")).alias("_l"))
        for _jump in range(2):  # pointer jumping: label <- label of label
            parent = step.select(F.col("_id").alias("_p"), F.col("_l").alias("_pl"))
            step = step.join(parent, step["_l"] == parent["_p"], "left") \
                .select("_id", "_old", F.least("_l", F.coalesce("_pl", "_l")).alias("_l"))
        new = cut_lineage(step.withColumn("_changed", F.col("_l") != F.col("_old")))
        changed = new.where("_changed").limit(1).count()
        labels = new.select("_id", "_l")
        if changed == 0:
            break
    return labels.select(F.col("_id").alias(id_col), F.col("_l").alias("component"))


def dbscan(points: DataFrame, *, eps: float, min_samples: int = 5, min_cluster_size: int = 20,
           id_col: str = "id", vec_col: str = "vec", metric: str = "euclidean") -> DataFrame:
    """ML1. Output: id, cluster (int, -1 = noise), is_core."""
    ids = points.select(F.col(id_col).cast("long").alias("id"))
    pairs = cut_lineage(exact_range_pairs(points, eps, id_col=id_col, vec_col=vec_col, metric=metric))
    deg = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("_deg"))
    core = ids.join(deg.withColumnRenamed("src", "id"), "id", "left") \
        .withColumn("is_core", (F.coalesce("_deg", F.lit(0)) + 1) >= min_samples).select("id", "is_core")
    core_ids = core.where("is_core").select("id")
    cc_edges = pairs.join(core_ids.withColumnRenamed("id", "src"), "src").join(core_ids.withColumnRenamed("id", "dst"), "dst")
    comp = connected_components(core_ids, cc_edges)
    border = (pairs.join(core.where(~F.col("is_core")).select(F.col("id").alias("src")), "src")
              .join(comp.select(F.col("id").alias("dst"), "component"), "dst")
              .groupBy("src").agg(F.min("component").alias("component"))
              .withColumnRenamed("src", "id"))
    member = comp.unionByName(border)
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    kept = sizes.where(F.col("_n") >= min_cluster_size).select("component")
    dense = distributed_row_number(kept.withColumn("_all", F.lit(0)), ["_all"], ["component"], out="_rk") \
        .select("component", (F.col("_rk") - 1).cast("int").alias("cluster"))
    labelled = ids.join(member, "id", "left").join(dense, "component", "left") \
        .join(core, "id").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "is_core")
    any_cluster = labelled.where(F.col("cluster") >= 0).limit(1).count() > 0
    if not any_cluster:
        labelled = labelled.withColumn("cluster", F.lit(0))
    return labelled


def cluster_stats(assign: DataFrame, group_cols=("device_type",)) -> DataFrame:
    """AGG4: clusters excluding noise, noise count, members."""
    return assign.groupBy(*group_cols).agg(
        F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"),
        F.count(F.when(F.col("cluster") == -1, 1)).alias("n_noise"),
        F.count(F.lit(1)).alias("n_points"))


def centroids(df: DataFrame, group_col: str, vec_col: str) -> DataFrame:
    """ML6 / AGG23: element-wise mean vector per group."""
    return mean_vectors(df, [group_col], vec_col, "centroid")


def nearest_centroid(points: DataFrame, cents: DataFrame, id_col: str, vec_col: str, group_col: str,
                     max_centroids: int = 4096) -> DataFrame:
    """ML6 assignment: nearest centroid by euclidean distance (ties: first centroid in
    group order). The centroid table has one row per cluster; after checking its size it
    is inlined as a literal, so each point is scored in a single projection (no join)."""
    rows = cents.orderBy(group_col).limit(max_centroids + 1).collect()
    if len(rows) > max_centroids:
        raise ValueError(f"more than {max_centroids} centroids; assign with a join on a cell id instead")
    labels = F.array(*[F.lit(r[group_col]) for r in rows])
    mat = F.array(*[F.array(*[F.lit(float(x)) for x in r["centroid"]]) for r in rows])
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    dists = F.transform(mat, lambda c: F.sqrt(F.aggregate(F.zip_with(c, v, lambda a, b: (a - b) * (a - b)),
                                                          F.lit(0.0), lambda acc, x: acc + x)))
    scored = points.select(id_col, dists.alias("_d"))
    best = F.array_position(F.col("_d"), F.array_min("_d"))
    return scored.select(id_col, F.element_at(labels, best.cast("int")).alias("nearest"),
                         F.array_min("_d").alias("distance"))


def kmeans_codes(df: DataFrame, id_col: str, code_cols, k: int, seed: int = 42) -> DataFrame:
    """ML2: k-means on factorised codes, k = min(max(k,1), rows); k <= 1 -> all 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    n = df.count()
    kk = min(max(k, 1), n)
    if kk <= 1:
        return df.select(id_col, F.lit(0).alias("cluster"))
    feats = VectorAssembler(inputCols=list(code_cols), outputCol="_features").transform(df)
    model = KMeans(k=kk, seed=seed, featuresCol="_features", predictionCol="cluster").fit(feats)
    return model.transform(feats).select(id_col, F.col("cluster").cast("int"))


def pca_project(df: DataFrame, id_col: str, vec_col: str, k: int) -> tuple[DataFrame, object]:
    """VEC10: centre, then project on the top-k principal components (pyspark.ml PCA does
    not centre by itself). Returns (id, pca array<double>) and the fitted model."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    mean = centroids(df.withColumn("_g", F.lit(0)), "_g", vec_col).first()["centroid"]
    centred = df.select(id_col, F.zip_with(F.transform(vec_col, lambda x: x.cast("double")),
                                           F.array(*[F.lit(float(m)) for m in mean]),
                                           lambda x, m: x - m).alias("_c"))
    vec = centred.select(id_col, array_to_vector("_c").alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    return model.transform(vec).select(id_col, vector_to_array("_p").alias("pca")), model
