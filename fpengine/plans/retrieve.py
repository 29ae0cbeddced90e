"""Retrieval plans: local vector retrieval (RT1) and the kNN vote (RT5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EMBEDDING_LAYOUT, VectorLayout
from ..functions import vectors as V
from ..operators.knn import exact_topk
from ..operators.vectormean import mean_vectors


def prepare_corpus(df: DataFrame, id_col: str, vec_col: str, layout: VectorLayout = EMBEDDING_LAYOUT,
                   extra: tuple[str, ...] = ()) -> DataFrame:
    """VEC2: block-weighted, unit-norm corpus vectors."""
    return df.select(F.col(id_col), V.block_weighted_normalize(vec_col, layout).alias("vec"), *extra)


def prepare_queries(df: DataFrame, id_col: str, vec_col: str, layout: VectorLayout = EMBEDDING_LAYOUT,
                    exponent: float = 2.0) -> DataFrame:
    """FLT5 + VEC3: visibility mask, effective weights, confidence and the query vector."""
    mask = V.block_mask(vec_col, layout)
    staged = df.select(F.col(id_col), F.col(vec_col), mask.alias("mask"))
    eff, conf = V.masked_query_weights(F.col("mask"), layout, exponent)
    staged = staged.select(id_col, vec_col, "mask", eff.alias("eff_weights"), conf.alias("confidence"))
    missing = F.filter(F.transform(F.col("mask"), lambda m, i: F.when(m == 0, F.element_at(
        F.array(*[F.lit(n) for n in layout.names]), (i + 1).cast("int")))), lambda x: x.isNotNull())
    return staged.select(
        id_col, "confidence", missing.alias("missing_perspectives"),
        V.masked_query_vector(vec_col, F.col("mask"), F.col("eff_weights"), layout).alias("qvec"))


def local_retrieval(queries: DataFrame, corpus: DataFrame, *, query_id: str, corpus_id: str,
                    vec_col: str = "embedding", k: int = 5, layout: VectorLayout = EMBEDDING_LAYOUT,
                    payload: tuple[str, ...] = (), exclude_self: bool = False) -> DataFrame:
    """RT1 for a batch of queries: exact top-k by inner product of the masked, weighted
    query vector with the weighted corpus vectors, scaled by the query's confidence.

    Output: query_id, rank, neighbor_id, raw_score, similarity_score, confidence_score,
    source (+ payload of the neighbour)."""
    q = prepare_queries(queries, query_id, vec_col, layout).withColumnRenamed(query_id, "query_id")
    c = prepare_corpus(corpus, corpus_id, vec_col, layout, payload).withColumnRenamed(corpus_id, "neighbor_id")
    hits = exact_topk(q.select("query_id", "qvec"), c, k, query_id="query_id", query_vec="qvec",
                      corpus_id="neighbor_id", corpus_vec="vec", payload=payload,
                      exclude_same_id=exclude_self)
    conf = q.select("query_id", "confidence")
    return (hits.join(conf, "query_id")
            .select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id",
                    F.col("score").alias("raw_score"),
                    (F.col("score") * F.col("confidence")).alias("similarity_score"),
                    F.col("confidence").alias("confidence_score"),
                    F.lit("vector_search").alias("source"), *payload))


def knn_vote(hits: DataFrame, label_col: str, *, query_id: str = "query_id",
             score_col: str = "similarity_score") -> DataFrame:
    """RT5 (kNN part): the label with the largest summed similarity among a query's hits;
    ties by hit count, then label ascending. ``vote_share`` = winner's sum / total sum."""
    per = hits.groupBy(query_id, label_col).agg(F.sum(score_col).alias("vote_score"),
                                                F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy(query_id).orderBy(F.col("vote_score").desc(), F.col("votes").desc(),
                                             F.col(label_col).asc())
    tot = Window.partitionBy(query_id)
    return (per.withColumn("_r", F.row_number().over(w))
            .withColumn("_t", F.sum("vote_score").over(tot))
            .where(F.col("_r") == 1)
            .select(query_id, F.col(label_col).alias("pred_label"), "vote_score", "votes",
                    F.when(F.col("_t") > 0, F.col("vote_score") / F.col("_t")).otherwise(F.lit(0.0))
                    .alias("vote_share")))


# ---------------------------------------------------------------- RT2 / RT3 / RT6

def block_of(vec_col: str, layout: VectorLayout, names_col: str = "perspective") -> Column:
    """The block of a vector that belongs to the perspective named in ``names_col``."""
    idx = F.array_position(F.array(*[F.lit(n) for n in layout.names]), F.col(names_col)).cast("int")
    return F.slice(F.col(vec_col), (idx - 1) * layout.block_dim + 1, layout.block_dim)


def single_cluster_centroids(vectors: DataFrame, single: DataFrame, id_col: str, vec_col: str,
                             layout: VectorLayout = EMBEDDING_LAYOUT) -> DataFrame:
    """Representative vector of each single-perspective cluster: the mean of the
    perspective's block over the cluster's members (noise excluded).
    Output: perspective, cluster, rep (array<double>)."""
    j = single.where(F.col("cluster") != -1).join(vectors.select(F.col(id_col).cast("string").alias("ip"), vec_col), "ip")
    return mean_vectors(j, ["perspective", "cluster"], block_of(vec_col, layout), "rep")


def community_retrieval(hits: DataFrame, queries: DataFrame, assign: DataFrame, centroids: DataFrame,
                        reports: DataFrame | None = None, *, query_vec: str = "embedding") -> DataFrame:
    """RT2 with JN9, JN10 and VEC6. ``hits``: query_id, neighbor_id (top-k, so the related
    list of a cluster holds at most k ids); ``assign``: neighbor_id, device_type, cluster;
    ``centroids``: device_type, cluster, centroid; ``queries``: query_id, <query_vec>.
    Output per (query, cluster): related_ips, n_related, similarity (cosine of the query and
    the cluster centroid), report (default 'No report available'), rank by similarity."""
    rel = (hits.select("query_id", "neighbor_id").join(assign, "neighbor_id")
           .groupBy("query_id", "device_type", "cluster")
           .agg(F.array_sort(F.collect_list("neighbor_id")).alias("related_ips"), F.count(F.lit(1)).alias("n_related")))
    j = rel.join(queries.select("query_id", query_vec), "query_id").join(centroids, ["device_type", "cluster"])
    out = j.select("query_id", "device_type", "cluster", "related_ips", "n_related",
                   V.cosine(query_vec, "centroid").alias("similarity"))
    if reports is not None:
        out = out.join(reports, ["device_type", "cluster"], "left")
    else:
        out = out.withColumn("report", F.lit(None).cast("string"))
    out = out.withColumn("report", F.coalesce("report", F.lit("No report available")))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("cluster"))
    return out.withColumn("rank", F.row_number().over(w))


def reasoning_paths(hits: DataFrame, queries: DataFrame, overall: DataFrame, single: DataFrame, reps: DataFrame,
                    *, query_vec: str = "embedding", layout: VectorLayout = EMBEDDING_LAYOUT,
                    threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """RT3 (AGG8-AGG10 per query; JN11 joins the overall cluster of the related devices with
    their single-perspective clusters). For each query and each overall cluster holding some of
    its similar devices: entropy importance of every perspective over those related
    devices' single clusters (noise excluded; M = distinct single clusters of the type incl.
    noise), L1-normalised; on the important perspectives the feature score
    sum_c w_c * cos(query block, representative of c), and the path score
    sum_f S_f * feature score. Clusters without an important perspective are dropped.
    Returns (paths: query_id, overall_cluster, path_score, n_important, rank;
             details: query_id, overall_cluster, perspective, cluster, w, similarity, importance, is_important)."""
    m = single.groupBy("perspective").agg(F.countDistinct("cluster").alias("M"))
    rel = hits.select("query_id", F.col("neighbor_id").cast("string").alias("ip")).join(overall, "ip")
    cnt = (rel.join(single, "ip").where(F.col("cluster") != -1)
           .groupBy("query_id", "overall_cluster", "perspective", "cluster").agg(F.count(F.lit(1)).alias("n_c")))
    grp = Window.partitionBy("query_id", "overall_cluster", "perspective")
    w = cnt.withColumn("w", F.col("n_c") / F.sum("n_c").over(grp))
    ent = w.groupBy("query_id", "overall_cluster", "perspective").agg(
        F.sum(F.when(F.col("w") > 0, -F.col("w") * F.log("w")).otherwise(F.lit(0.0))).alias("H")).join(m, "perspective")
    ent = ent.withColumn("norm", F.when(F.col("M") > 1, F.col("H") / F.log(F.col("M").cast("double"))).otherwise(F.lit(0.0))) \
        .withColumn("raw", 1 - F.col("norm"))
    per = Window.partitionBy("query_id", "overall_cluster")
    ent = ent.withColumn("importance", F.when(F.sum("raw").over(per) > 0, F.col("raw") / F.sum("raw").over(per))
                         .otherwise(F.col("raw"))).withColumn("is_important", F.col("norm") < threshold)
    qb = queries.select("query_id", query_vec)
    details = (w.join(ent.select("query_id", "overall_cluster", "perspective", "importance", "is_important"),
                      ["query_id", "overall_cluster", "perspective"])
               .join(reps, ["perspective", "cluster"])
               .join(qb, "query_id")
               .select("query_id", "overall_cluster", "perspective", "cluster", "w", "importance", "is_important",
                       V.cosine(block_of(query_vec, layout), "rep").alias("similarity")))
    feat = (details.where("is_important").groupBy("query_id", "overall_cluster", "perspective")
            .agg(F.sum(F.col("w") * F.col("similarity")).alias("feature_score"), F.first("importance").alias("S")))
    paths = feat.groupBy("query_id", "overall_cluster").agg(
        F.sum(F.col("S") * F.col("feature_score")).alias("path_score"), F.count(F.lit(1)).alias("n_important"))
    # sums of doubles differ in their last bits with the partitioning: equal scores must stay equal
    rw = Window.partitionBy("query_id").orderBy(F.round("path_score", 9).desc(), F.col("overall_cluster"))
    return paths.withColumn("rank", F.row_number().over(rw)), details


def unseen_indicators(hits: DataFrame, paths: DataFrame, details: DataFrame, label_col: str = "label",
                      threshold: float = 0.5) -> DataFrame:
    """RT6 statistical part (WIN5, WIN6, AGG15, AGG16, FN16): best / second path score and gap (WIN6), top similarity and
    dominant label among the first 5 hits (AGG15), best similarity per key (important)
    perspective across clusters (WIN5) with positive mean / min (AGG16), and the heuristic
    unseen score 1 - (.4 path + .4 key + .2 local) (FN16); is_unseen = score >= threshold."""
    from ..functions.scalar import unseen_score
    from ..operators.aggregate import first_hits_stats
    best = paths.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("path_score"))).alias("best_path_score"),
        F.max(F.when(F.col("rank") == 2, F.col("path_score"))).alias("second_path_score"),
        F.count(F.lit(1)).alias("num_clusters_analyzed"))
    best = best.withColumn("score_gap", F.col("best_path_score") - F.col("second_path_score"))
    local = hits.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("similarity_score"))).alias("top_similarity"))
    dom = first_hits_stats(hits, "query_id", "rank", label_col, 5)
    persp = details.groupBy("query_id", "perspective").agg(
        F.max("similarity").alias("best_sim"), F.max(F.col("is_important").cast("int")).alias("key"))
    keys = persp.groupBy("query_id").agg(
        F.coalesce(F.avg(F.when((F.col("key") == 1) & (F.col("best_sim") > 0), F.col("best_sim"))), F.lit(0.0)).alias("key_avg_similarity"),
        F.coalesce(F.min(F.when((F.col("key") == 1) & (F.col("best_sim") > 0), F.col("best_sim"))), F.lit(0.0)).alias("key_min_similarity"),
        F.coalesce(F.avg(F.when((F.col("key") == 0) & (F.col("best_sim") > 0), F.col("best_sim"))), F.lit(0.0)).alias("nonkey_avg_similarity"),
        F.sum("key").alias("num_key_perspectives"))
    q = local.join(dom, "query_id", "left").join(best, "query_id", "left").join(keys, "query_id", "left")
    q = q.na.fill({"best_path_score": 0.0, "key_avg_similarity": 0.0, "key_min_similarity": 0.0,
                   "nonkey_avg_similarity": 0.0, "num_clusters_analyzed": 0, "num_key_perspectives": 0})
    score = unseen_score("best_path_score", "key_avg_similarity", "top_similarity")
    return q.withColumn("heuristic_unseen_score", score).withColumn("is_unseen", F.col("heuristic_unseen_score") >= threshold)
