"""Registered retrieval queries over ``embeddings`` (RT1, RT5, VEC*, TOP2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EMBEDDING_LAYOUT
from ..functions import vectors as V
from ..operators.vectormean import mean_vectors
from ..session import stage_table
from ..sources.tables import table
from .registry import register
from .retrieve import knn_vote, local_retrieval

K = 5

# DuckDB twin of VEC2/VEC3 on the 4 x 16 layout of `embeddings` (weights .11 .13 .15 .16)
_W = "[0.11::DOUBLE, 0.13::DOUBLE, 0.15::DOUBLE, 0.16::DOUBLE]"
_PREP_SQL = f"""
v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), m AS (
  SELECT vec_id, label, e,
    [CASE WHEN len(list_filter(e[1:16], lambda x: x IS NOT NULL AND x <> 0)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END,
     CASE WHEN len(list_filter(e[17:32], lambda x: x IS NOT NULL AND x <> 0)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END,
     CASE WHEN len(list_filter(e[33:48], lambda x: x IS NOT NULL AND x <> 0)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END,
     CASE WHEN len(list_filter(e[49:64], lambda x: x IS NOT NULL AND x <> 0)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    ] AS mask
  FROM v
), wa AS (
  SELECT *, 0.11::DOUBLE * mask[1] + 0.13::DOUBLE * mask[2] + 0.15::DOUBLE * mask[3] + 0.16::DOUBLE * mask[4] AS w_a FROM m
), qraw AS (
  SELECT vec_id, label, CASE WHEN w_a > 0 THEN w_a * w_a ELSE 0.0::DOUBLE END AS conf,
    list_transform(e, lambda x, i: x * mask[(i - 1) // 16 + 1] *
      CASE WHEN w_a > 0 THEN {_W}[(i - 1) // 16 + 1] * mask[(i - 1) // 16 + 1] / w_a
           ELSE {_W}[(i - 1) // 16 + 1] / 0.55::DOUBLE END) AS r,
    list_transform(e, lambda x, i: x * {_W}[(i - 1) // 16 + 1]) AS c
  FROM wa
), qn AS (
  SELECT vec_id, label, conf,
    sqrt(list_sum(list_transform(r, lambda x: x * x))) AS rn,
    sqrt(list_sum(list_transform(c, lambda x: x * x))) AS cn, r, c
  FROM qraw
), vecs AS (
  SELECT vec_id, label, conf,
    CASE WHEN rn > 0 THEN list_transform(r, lambda x: x / rn) ELSE r END AS qv,
    list_transform(c, lambda x: x / (CASE WHEN cn > 0 THEN cn ELSE 1.0 END)) AS cv
  FROM qn
), scored AS (
  SELECT q.vec_id AS query_id, q.label AS true_label, q.conf, n.vec_id AS neighbor_id, n.label AS neighbor_label,
         list_inner_product(q.qv, n.cv) AS raw_score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.qv, n.cv) DESC, n.vec_id) AS rk
  FROM vecs q JOIN vecs n ON q.vec_id <> n.vec_id
), hits AS (
  SELECT * FROM scored WHERE rk <= {K}
)"""


def _rt1(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    hits = local_retrieval(emb, emb, query_id="vec_id", corpus_id="vec_id", k=K,
                           payload=("label",), exclude_self=True)
    return hits.select(
        F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("long").alias("rank"),
        F.col("neighbor_id").cast("long").alias("neighbor_id"),
        F.col("label").cast("int").alias("neighbor_label"),
        F.round("similarity_score", 6).alias("similarity_score"),
        F.round("confidence_score", 6).alias("confidence_score"), "source")


register("RT1_local_retrieval", f"""
WITH {_PREP_SQL}
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rk AS BIGINT) AS rank, CAST(neighbor_id AS BIGINT) AS neighbor_id,
       CAST(neighbor_label AS INTEGER) AS neighbor_label,
       round(raw_score * conf, 6) AS similarity_score, round(conf, 6) AS confidence_score,
       'vector_search' AS source
FROM hits
""")(_rt1)


def _rt5(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    hits = local_retrieval(emb, emb, query_id="vec_id", corpus_id="vec_id", k=K,
                           payload=("label",), exclude_self=True)
    vote = knn_vote(hits, "label")
    truth = emb.select(F.col("vec_id").alias("query_id"), F.col("label").alias("true_label"))
    return vote.join(truth, "query_id").select(
        F.col("query_id").cast("long").alias("query_id"), F.col("true_label").cast("int").alias("true_label"),
        F.col("pred_label").cast("int").alias("pred_label"), F.round("vote_score", 6).alias("vote_score"),
        F.col("votes").cast("long").alias("votes"), F.round("vote_share", 6).alias("vote_share"))


register("RT5_knn_vote", f"""
WITH {_PREP_SQL},
per AS (
  SELECT query_id, true_label, neighbor_label, sum(raw_score * conf) AS vote_score, count(*) AS votes
  FROM hits GROUP BY query_id, true_label, neighbor_label
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vote_score DESC, votes DESC, neighbor_label) AS r,
         sum(vote_score) OVER (PARTITION BY query_id) AS t
  FROM per
)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(true_label AS INTEGER) AS true_label,
       CAST(neighbor_label AS INTEGER) AS pred_label, round(vote_score, 6) AS vote_score,
       CAST(votes AS BIGINT) AS votes, round(CASE WHEN t > 0 THEN vote_score / t ELSE 0.0 END, 6) AS vote_share
FROM ranked WHERE r = 1
""")(_rt5)


def _vec_distances(spark, sf_dir):
    """VEC6/VEC7: cosine, euclidean, manhattan, minkowski-3 of each vector to its class
    centroid (ML6 centroids)."""
    emb = table(spark, sf_dir, "embeddings")
    dim = EMBEDDING_LAYOUT.dim
    cent = mean_vectors(emb, ["label"], "embedding", "centroid")
    j = emb.join(cent, "label")
    return j.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
        F.round(V.cosine("embedding", "centroid"), 6).alias("cosine"),
        F.round(V.euclidean("embedding", "centroid"), 6).alias("euclidean"),
        F.round(V.manhattan("embedding", "centroid"), 6).alias("manhattan"),
        F.round(V.minkowski("embedding", "centroid", 3.0), 6).alias("minkowski3"),
        F.size("centroid").cast("int").alias("dim")).where(F.lit(dim) > 0)


register("VEC7_centroid_distances", """
WITH x AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT label, i, avg(e[i]) AS m FROM x, range(1, 65) r(i) GROUP BY label, i
), c AS (
  SELECT label, list(m ORDER BY i) AS centroid FROM u GROUP BY label
), j AS (
  SELECT x.vec_id, x.label, x.e, c.centroid FROM x JOIN c USING (label)
)
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS INTEGER) AS label,
  round(CASE WHEN sqrt(list_sum(list_transform(e, lambda a: a*a))) * sqrt(list_sum(list_transform(centroid, lambda a: a*a))) > 0
        THEN list_inner_product(e, centroid) / (sqrt(list_sum(list_transform(e, lambda a: a*a))) * sqrt(list_sum(list_transform(centroid, lambda a: a*a))))
        ELSE 0.0 END, 6) AS cosine,
  round(sqrt(list_sum(list_transform(e, lambda a, i: (a - centroid[i]) * (a - centroid[i])))), 6) AS euclidean,
  round(list_sum(list_transform(e, lambda a, i: abs(a - centroid[i]))), 6) AS manhattan,
  round(pow(list_sum(list_transform(e, lambda a, i: pow(abs(a - centroid[i]), 3.0))), 1.0 / 3.0), 6) AS minkowski3,
  CAST(len(centroid) AS INTEGER) AS dim
FROM j
""")(_vec_distances)


# ---------------------------------------------------------------- RT2 / RT3 / RT6 / SET7
from ..operators import cluster as CL  # noqa: E402
from ..operators import graph as G  # noqa: E402
from .reg_aggregate import SINGLE_SQL, overall_clusters, single_clusters  # noqa: E402
from .retrieve import community_retrieval, reasoning_paths, single_cluster_centroids, unseen_indicators  # noqa: E402


def _hits(spark, sf_dir):
    """The vectors and their hits. What follows reads the hits more than once, so they are searched once and staged."""
    emb = table(spark, sf_dir, "embeddings")
    hits = local_retrieval(emb, emb, query_id="vec_id", corpus_id="vec_id", k=K, payload=("label",), exclude_self=True)
    return emb, stage_table(hits, "rt-hits")


def _reports(emb):
    """Cluster report stand-in: clusters with at least 50 members carry a summary text."""
    return emb.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 50).select(
        F.lit("embeddings").alias("device_type"), F.col("label").alias("cluster"),
        F.concat(F.lit("cluster "), F.col("label").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" devices")).alias("report"))


_CENT_SQL = """
xv AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
cu AS (SELECT label, i, avg(e[i]) AS m FROM xv, range(1, 65) r(i) GROUP BY label, i),
cents AS (SELECT label AS cluster, list(m ORDER BY i) AS centroid FROM cu GROUP BY label)"""


@register("RT2_community_retrieval", f"""
WITH {_PREP_SQL}, {_CENT_SQL},
rel AS (SELECT query_id, neighbor_label AS cluster, list(neighbor_id ORDER BY neighbor_id) AS ips, count(*) AS n FROM hits GROUP BY 1, 2),
rep AS (SELECT label AS cluster, 'cluster ' || CAST(label AS VARCHAR) || ': ' || CAST(count(*) AS VARCHAR) || ' devices' AS report
        FROM embeddings GROUP BY label HAVING count(*) >= 50),
j AS (SELECT rel.query_id, rel.cluster, rel.ips, rel.n, list_cosine_similarity(xv.e, cents.centroid) AS similarity,
             coalesce(rep.report, 'No report available') AS report
      FROM rel JOIN xv ON xv.vec_id = rel.query_id JOIN cents USING (cluster) LEFT JOIN rep USING (cluster))
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(cluster AS INTEGER) AS cluster,
       array_to_string(list_transform(ips, lambda v: CAST(v AS VARCHAR)), ',') AS related_ips, CAST(n AS BIGINT) AS n_related,
       round(similarity, 6) AS similarity, report,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cluster) AS BIGINT) AS rank
FROM j
""")
def rt2(spark, sf_dir):
    emb, hits = _hits(spark, sf_dir)
    assign = emb.select(F.col("vec_id").alias("neighbor_id"), F.lit("embeddings").alias("device_type"),
                        F.col("label").alias("cluster"))
    cents = CL.centroids(emb, "label", "embedding").select(F.lit("embeddings").alias("device_type"),
                                                           F.col("label").alias("cluster"), "centroid")
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    r = community_retrieval(hits, q, assign, cents, _reports(emb))
    return r.select(F.col("query_id").cast("long"), F.col("cluster").cast("int"),
                    F.array_join(F.transform("related_ips", lambda v: v.cast("string")), ",").alias("related_ips"),
                    F.col("n_related").cast("long"), F.round("similarity", 6).alias("similarity"), "report",
                    F.col("rank").cast("long"))


_PATH_SQL = f"""
single AS ({SINGLE_SQL}),
mcount AS (SELECT perspective, count(DISTINCT cluster) AS M FROM single GROUP BY 1),
rel AS (SELECT query_id, CAST(neighbor_id AS VARCHAR) AS ip, neighbor_label AS overall_cluster FROM hits),
cnt AS (SELECT r.query_id, r.overall_cluster, s.perspective, s.cluster, count(*) AS n_c
        FROM rel r JOIN single s USING (ip) WHERE s.cluster <> -1 GROUP BY 1, 2, 3, 4),
w AS (SELECT *, n_c / sum(n_c) OVER (PARTITION BY query_id, overall_cluster, perspective) AS w FROM cnt),
ent AS (SELECT query_id, overall_cluster, perspective, sum(CASE WHEN w > 0 THEN -w * ln(w) ELSE 0 END) AS H FROM w GROUP BY 1, 2, 3),
en AS (SELECT e.*, CASE WHEN mc.M > 1 THEN H / ln(mc.M) ELSE 0.0 END AS norm FROM ent e JOIN mcount mc USING (perspective)),
imp AS (SELECT *, CASE WHEN sum(1 - norm) OVER (PARTITION BY query_id, overall_cluster) > 0
                       THEN (1 - norm) / sum(1 - norm) OVER (PARTITION BY query_id, overall_cluster) ELSE 1 - norm END AS importance,
               norm < 0.1 AS is_important FROM en),
xv AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
pofs AS (SELECT * FROM (VALUES ('sw', 0), ('hw', 16), ('hfavicons', 32), ('certificate', 48)) t(perspective, off)),
mem AS (SELECT s.perspective, s.cluster, p.off, xv.e FROM single s JOIN pofs p USING (perspective)
        JOIN xv ON CAST(xv.vec_id AS VARCHAR) = s.ip WHERE s.cluster <> -1),
repu AS (SELECT perspective, cluster, i, avg(e[off + i]) AS mm FROM mem, range(1, 17) r(i) GROUP BY 1, 2, 3),
reps AS (SELECT perspective, cluster, list(mm ORDER BY i) AS rep FROM repu GROUP BY 1, 2),
det AS (SELECT w.query_id, w.overall_cluster, w.perspective, w.cluster, w.w, imp.importance, imp.is_important,
               list_cosine_similarity(xq.e[p.off + 1:p.off + 16], reps.rep) AS sim
        FROM w JOIN imp USING (query_id, overall_cluster, perspective) JOIN reps USING (perspective, cluster)
        JOIN pofs p USING (perspective) JOIN xv xq ON xq.vec_id = w.query_id),
feat AS (SELECT query_id, overall_cluster, perspective, sum(w * sim) AS fs, any_value(importance) AS S
         FROM det WHERE is_important GROUP BY 1, 2, 3),
paths AS (SELECT query_id, overall_cluster, sum(S * fs) AS path_score, count(*) AS n_important FROM feat GROUP BY 1, 2),
rpaths AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(path_score, 9) DESC, overall_cluster) AS rank FROM paths)"""


def _paths(spark, sf_dir):
    emb, hits = _hits(spark, sf_dir)
    single = single_clusters(spark, sf_dir)
    overall = overall_clusters(spark, sf_dir).select("ip", "overall_cluster")
    reps = single_cluster_centroids(emb, single, "vec_id", "embedding")
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    paths, details = reasoning_paths(hits, q, overall, single.drop("device_type"), reps)
    return hits, paths, details


@register("RT3_reasoning_paths", f"""
WITH {_PREP_SQL}, {_PATH_SQL}
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(overall_cluster AS INTEGER) AS overall_cluster,
       round(path_score, 6) AS path_score, CAST(n_important AS BIGINT) AS n_important, CAST(rank AS BIGINT) AS rank
FROM rpaths
""")
def rt3(spark, sf_dir):
    _, paths, _ = _paths(spark, sf_dir)
    return paths.select(F.col("query_id").cast("long"), F.col("overall_cluster").cast("int"),
                        F.round("path_score", 6).alias("path_score"), F.col("n_important").cast("long"), F.col("rank").cast("long"))


def _r4(x: str) -> str:
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE)"


@register("RT6_unseen_indicators", f"""
WITH {_PREP_SQL}, {_PATH_SQL},
best AS (SELECT query_id, max(CASE WHEN rank = 1 THEN path_score END) AS bp, max(CASE WHEN rank = 2 THEN path_score END) AS sp,
                count(*) AS nca FROM rpaths GROUP BY 1),
loc AS (SELECT query_id, max(CASE WHEN rk = 1 THEN raw_score * conf END) AS top_sim FROM hits GROUP BY 1),
dom AS (SELECT query_id, arg_min(neighbor_label, (-n, neighbor_label)) AS most_common, max(n) / sum(n) AS ratio, count(*) AS diversity
        FROM (SELECT query_id, neighbor_label, count(*) AS n FROM hits WHERE rk <= 5 GROUP BY 1, 2) GROUP BY 1),
persp AS (SELECT query_id, perspective, max(sim) AS best_sim, max(CAST(is_important AS INTEGER)) AS key FROM det GROUP BY 1, 2),
keys AS (SELECT query_id, coalesce(avg(best_sim) FILTER (WHERE key = 1 AND best_sim > 0), 0.0) AS kavg,
                coalesce(min(best_sim) FILTER (WHERE key = 1 AND best_sim > 0), 0.0) AS kmin FROM persp GROUP BY 1),
a AS (SELECT loc.query_id, loc.top_sim, dom.most_common, dom.ratio, dom.diversity, coalesce(best.bp, 0.0) AS bp, best.sp,
             coalesce(keys.kavg, 0.0) AS kavg, coalesce(keys.kmin, 0.0) AS kmin
      FROM loc LEFT JOIN dom USING (query_id) LEFT JOIN best USING (query_id) LEFT JOIN keys USING (query_id))
SELECT CAST(query_id AS BIGINT) AS query_id, round(bp, 6) AS best_path_score, round(sp, 6) AS second_path_score,
       round(top_sim, 6) AS top_similarity, CAST(most_common AS INTEGER) AS dominant_label, round(ratio, 6) AS dominant_ratio,
       CAST(diversity AS BIGINT) AS diversity, round(kavg, 6) AS key_avg_similarity, round(kmin, 6) AS key_min_similarity,
       {_r4('1.0 - (0.4 * bp + 0.4 * kavg + 0.2 * top_sim)')} AS heuristic_unseen_score,
       {_r4('1.0 - (0.4 * bp + 0.4 * kavg + 0.2 * top_sim)')} >= 0.5 AS is_unseen
FROM a
""")
def rt6(spark, sf_dir):
    hits, paths, details = _paths(spark, sf_dir)
    u = unseen_indicators(hits, paths, details, "label")
    return u.select(F.col("query_id").cast("long"), F.round("best_path_score", 6).alias("best_path_score"),
                    F.round("second_path_score", 6).alias("second_path_score"), F.round("top_similarity", 6).alias("top_similarity"),
                    F.col("most_common").cast("int").alias("dominant_label"), F.round("ratio", 6).alias("dominant_ratio"),
                    F.col("diversity").cast("long"), F.round("key_avg_similarity", 6).alias("key_avg_similarity"),
                    F.round("key_min_similarity", 6).alias("key_min_similarity"), "heuristic_unseen_score", "is_unseen")


@register("RT1_SET7_graph_neighbors", f"""
WITH {_PREP_SQL},
single AS ({SINGLE_SQL}),
f AS (SELECT CAST(ip AS BIGINT) AS id, max(CASE WHEN perspective = 'sw' THEN cluster END) AS f1,
             max(CASE WHEN perspective = 'hw' THEN cluster END) AS f2, max(CASE WHEN perspective = 'hfavicons' THEN cluster END) AS f3,
             max(CASE WHEN perspective = 'certificate' THEN cluster END) AS f4 FROM single GROUP BY ip),
seeds AS (SELECT query_id, neighbor_id AS seed_id FROM hits),
pairs AS (SELECT s.query_id, b.id AS neighbor_id,
                 CAST(a.f1 = b.f1 AS INTEGER) + CAST(a.f2 = b.f2 AS INTEGER) + CAST(a.f3 = b.f3 AS INTEGER) + CAST(a.f4 = b.f4 AS INTEGER) AS shared
          FROM seeds s JOIN f a ON a.id = s.seed_id JOIN f b ON b.id <> a.id),
best AS (SELECT query_id, neighbor_id, max(shared) AS shared_count FROM pairs WHERE shared > 1 GROUP BY 1, 2),
ns AS (SELECT * FROM best WHERE neighbor_id <> query_id
       AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = best.query_id AND s.seed_id = best.neighbor_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared_count DESC, neighbor_id) AS r FROM ns)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(neighbor_id AS BIGINT) AS neighbor_id, 'vector_search' AS source,
       round(raw_score * conf, 6) AS similarity_score, CAST(NULL AS BIGINT) AS shared_count FROM hits
UNION ALL
SELECT CAST(query_id AS BIGINT), CAST(neighbor_id AS BIGINT), 'graph_neighbor', 0.0, CAST(shared_count AS BIGINT) FROM g WHERE r <= {K}
""")
def rt1_graph(spark, sf_dir):
    """RT1 with graph-neighbour expansion: JN8 over the layer-1 graph whose feature nodes
    are each vector's single-perspective clusters, seeded by the vector hits, merged with
    them (SET7; at most 2k rows per query)."""
    emb, hits = _hits(spark, sf_dir)
    single = single_clusters(spark, sf_dir)
    wide = single.groupBy("ip").pivot("perspective", list(EMBEDDING_LAYOUT.names)).agg(F.first("cluster")) \
        .withColumn("id", F.col("ip").cast("long"))
    seeds = hits.select("query_id", F.col("neighbor_id").alias("seed_id"))
    self_excl = emb.select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("neighbor_id"))
    nb = G.shared_feature_neighbors(wide, "id", list(EMBEDDING_LAYOUT.names), seeds, q=1, k=K, exclude=self_excl)
    vec = hits.select(F.col("query_id").cast("long"), F.col("neighbor_id").cast("long"), F.col("source"),
                      F.round("similarity_score", 6).alias("similarity_score"), F.lit(None).cast("long").alias("shared_count"))
    graph = nb.select(F.col("query_id").cast("long"), F.col("neighbor_id").cast("long"), F.lit("graph_neighbor").alias("source"),
                      F.lit(0.0).alias("similarity_score"), F.col("shared_count").cast("long"))
    return vec.unionByName(graph)


# ---------------------------------------------------------------- RT4 / RT7 / RT8 / RT9 / PRJ21
from ..operators import relational as RL  # noqa: E402
from ..operators import resultstore as RS  # noqa: E402
from ..sources import io as IO  # noqa: E402


def cascade_queries(vectors: DataFrame, version: str) -> DataFrame:
    """query_id and embedding with the hash of every kind's inputs: the vector, the depth and the version of the corpus; each kind
    rests on the one before."""
    local = F.xxhash64("embedding", F.lit(K), F.lit(version))
    return vectors.select(F.col("vec_id").cast("long").alias("query_id"), "embedding", local.alias("h_local")) \
        .withColumn("h_community", F.xxhash64("h_local", F.lit("community"))) \
        .withColumn("h_reasoning", F.xxhash64("h_local", F.lit("reasoning")))


def cascade_stages(spark, sf_dir, run: int):
    """RT1, RT2 and RT3 as stages of the cascade; a row says which run computed it."""
    emb = table(spark, sf_dir, "embeddings")

    def local(todo, rows):
        q = todo.select(F.col("query_id").alias("vec_id"), "embedding")
        hits = local_retrieval(q, emb, query_id="vec_id", corpus_id="vec_id", k=K, payload=("label",), exclude_self=True)
        return hits.select(F.col("query_id").cast("long"), "neighbor_id", "label", "rank", "similarity_score", F.lit(run).alias("run"))

    def community(todo, rows):
        assign = emb.select(F.col("vec_id").alias("neighbor_id"), F.lit("embeddings").alias("device_type"), F.col("label").alias("cluster"))
        cents = CL.centroids(emb, "label", "embedding").select(F.lit("embeddings").alias("device_type"), F.col("label").alias("cluster"), "centroid")
        r = community_retrieval(rows("local"), todo.select("query_id", "embedding"), assign, cents, _reports(emb))
        return r.select("query_id", "cluster", "related_ips", "similarity", "report", "rank", F.lit(run).alias("run"))

    def reasoning(todo, rows):
        single = single_clusters(spark, sf_dir)
        overall = overall_clusters(spark, sf_dir).select("ip", "overall_cluster")
        reps = single_cluster_centroids(emb, single, "vec_id", "embedding")
        paths, _ = reasoning_paths(rows("local"), todo.select("query_id", "embedding"), overall, single.drop("device_type"), reps)
        return paths.withColumn("run", F.lit(run))

    return [("local", "h_local", local), ("community", "h_community", community), ("reasoning", "h_reasoning", reasoning)]


@register("RT4_cascade_with_reuse", f"""
WITH {_PREP_SQL}, {_PATH_SQL},
kinds AS (SELECT 'local' AS kind, query_id FROM hits UNION ALL SELECT 'community', query_id FROM hits UNION ALL SELECT 'reasoning', query_id FROM rpaths),
n AS (SELECT kind, count(DISTINCT query_id) AS n FROM kinds GROUP BY 1)
SELECT kind, CAST(n AS BIGINT) AS n_queries,
       CAST((SELECT count(*) FROM (SELECT query_id FROM kinds GROUP BY 1 HAVING count(DISTINCT kind) = 3)) AS BIGINT) AS n_complete FROM n
""")
def rt4(spark, sf_dir):
    """Retrieval cascade that reuses stored partial results: an earlier run stored the local results alone; this one reads
    them and computes the other two kinds. FLT9 then reports the queries that hold every kind."""
    emb = table(spark, sf_dir, "embeddings")
    store = RS.ResultStore(spark, IO.scratch_path(spark, "rt4"))
    q = cascade_queries(emb, RS.table_version(emb))
    RS.cascade(store, q, cascade_stages(spark, sf_dir, 1)[:1])
    stages = cascade_stages(spark, sf_dir, 2)
    RS.cascade(store, q, stages)
    every = None
    for kind, _, _ in stages:
        d = RS.current_rows(store, q, stages, kind).select("query_id", F.lit(kind).alias("kind"))
        every = d if every is None else every.unionByName(d)
    complete = RL.complete_keys(every, "query_id", "kind", [k for k, _, _ in stages]).count()
    return every.groupBy("kind").agg(F.countDistinct("query_id").cast("long").alias("n_queries")) \
        .withColumn("n_complete", F.lit(complete).cast("long"))


@register("RT4_changed_queries", f"""
WITH {_PREP_SQL}, {_CENT_SQL},
sc AS (SELECT q.vec_id AS query_id, q.label AS ql, q.conf, n.vec_id AS neighbor_id, n.label AS neighbor_label,
              list_inner_product(q.qv, n.cv) * CASE WHEN q.label = 3 THEN -1 ELSE 1 END AS raw
       FROM vecs q JOIN vecs n ON q.vec_id <> n.vec_id),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, neighbor_id) AS rk FROM sc) WHERE rk <= {K}),
j AS (SELECT DISTINCT h.query_id, h.ql, h.neighbor_label AS cluster,
             list_cosine_similarity(xv.e, cents.centroid) * CASE WHEN h.ql = 3 THEN -1 ELSE 1 END AS similarity
      FROM h JOIN xv ON xv.vec_id = h.query_id JOIN cents ON cents.cluster = h.neighbor_label)
SELECT 'local' AS kind, CAST(query_id AS BIGINT) AS query_id, CAST(neighbor_id AS BIGINT) AS item, CAST(rk AS BIGINT) AS rank,
       round(raw * conf, 6) AS score, CAST(CASE WHEN ql = 3 THEN 3 ELSE 1 END AS INTEGER) AS run FROM h
UNION ALL
SELECT 'community', CAST(query_id AS BIGINT), CAST(cluster AS BIGINT),
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cluster) AS BIGINT),
       round(similarity, 6), CAST(CASE WHEN ql = 3 THEN 3 ELSE 1 END AS INTEGER) FROM j
""")
def rt4_changed(spark, sf_dir):
    """Three runs of the cascade: all queries, the same again, and with the vectors of one class turned round. Only the turned
    queries and what rests on them come from the third run; the second one computes nothing."""
    emb = table(spark, sf_dir, "embeddings")
    store = RS.ResultStore(spark, IO.scratch_path(spark, "rt4v"))
    version = RS.table_version(emb)
    turned = emb.withColumn("embedding", F.when(F.col("label") == 3, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")))
    for run, vectors in ((1, emb), (2, emb), (3, turned)):
        q = cascade_queries(vectors, version)
        stages = cascade_stages(spark, sf_dir, run)[:2]
        RS.cascade(store, q, stages)
    hits = RS.current_rows(store, q, stages, "local")
    com = RS.current_rows(store, q, stages, "community")
    return hits.select(F.lit("local").alias("kind"), "query_id", F.col("neighbor_id").cast("long").alias("item"), F.col("rank").cast("long"),
                       F.round("similarity_score", 6).alias("score"), F.col("run").cast("int")) \
        .unionByName(com.select(F.lit("community").alias("kind"), "query_id", F.col("cluster").cast("long").alias("item"), F.col("rank").cast("long"),
                                F.round("similarity", 6).alias("score"), F.col("run").cast("int")))


@register("RT7_known_unknown_split", """
WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT label, i, avg(e[i]) AS m FROM x, range(1, 65) r(i) GROUP BY label, i),
c AS (SELECT label AS nearest, list(m ORDER BY i) AS centroid FROM u GROUP BY label),
d AS (SELECT x.vec_id, x.label, c.nearest, sqrt(list_sum(list_transform(x.e, lambda a, i: (a - c.centroid[i]) * (a - c.centroid[i])))) AS distance
      FROM x, c),
p AS (SELECT vec_id, label, nearest FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) AS rk FROM d) WHERE rk = 1)
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS INTEGER) AS true_label, CAST(nearest AS INTEGER) AS pred_label,
       label IN (0, 1, 2, 3, 4, 5, 6, 7) AS is_known FROM p
""")
def rt7(spark, sf_dir):
    """Predictions split into known classes (catalogue 0-7) and unknown ones, merged back
    with a flag (two semi/anti joins against the catalogue)."""
    from .reg_metrics import _pred
    pred = _pred(spark, sf_dir)
    cat = spark.range(0, 8).select(F.col("id").cast("int").alias("true_label"))
    known = pred.join(F.broadcast(cat), "true_label", "left_semi").withColumn("is_known", F.lit(True))
    unknown = pred.join(F.broadcast(cat), "true_label", "left_anti").withColumn("is_known", F.lit(False))
    return known.unionByName(unknown).select(F.col("vec_id").cast("long"), F.col("true_label").cast("int"),
                                             F.col("pred_label").cast("int"), "is_known")


@register("RT8_test_set_build", """
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, d.source AS vendor, CAST(l.quality AS INTEGER) AS quality
FROM documents d JOIN labels l USING (doc_id) WHERE upper(trim(d.source)) <> 'UNKNOWN'
""")
def rt8(spark, sf_dir):
    """Match the keys of the evaluation set (semi-join), attach labels, drop unknown vendors."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    m = d.join(lab.select("doc_id"), "doc_id", "left_semi").join(lab, "doc_id")
    return m.where(F.upper(F.trim("source")) != "UNKNOWN").select(F.col("doc_id").cast("long"), F.col("source").alias("vendor"),
                                                                  F.col("quality").cast("int"))


@register("RT9_vendor_dataset_stage", """
SELECT c_mktsegment AS vendor, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey
WHERE upper(trim(c_mktsegment)) <> 'UNKNOWN' GROUP BY 1
""")
def rt9(spark, sf_dir):
    """Join, drop unknown vendors, write the dataset as CSV and read it back."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    ds = o.join(c, o.o_custkey == c.c_custkey).where(F.upper(F.trim("c_mktsegment")) != "UNKNOWN") \
        .select("o_orderkey", F.col("c_mktsegment").alias("vendor"))
    path = IO.scratch_path(spark, "rt9")
    IO.write_csv(ds, path)
    back = IO.read_csv(spark, path, ["o_orderkey", "vendor"])
    return back.groupBy("vendor").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("PRJ21_comparison_text")
def prj21(spark, sf_dir):
    """PRJ21 with TOP4: comparison text of each query against its best path cluster:
    important perspectives by importance (desc), each with its three most similar single
    clusters (top-3 similarities per perspective)."""
    _, paths, details = _paths(spark, sf_dir)
    best = paths.where(F.col("rank") == 1).select("query_id", "overall_cluster")
    d = details.join(best, ["query_id", "overall_cluster"]).where("is_important")
    from pyspark.sql import Window
    w = Window.partitionBy("query_id", "perspective").orderBy(F.col("similarity").desc(), "cluster")
    top3 = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 3)
    per = top3.groupBy("query_id", "perspective").agg(
        F.first("importance").alias("importance"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "cluster", "similarity"))),
                                 lambda s: F.concat(F.lit("cluster "), s["cluster"].cast("string"), F.lit(" sim "),
                                                    F.format_number(s["similarity"], 3))), "; ").alias("txt"))
    lines = per.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("k"), "perspective", "txt"))).alias("_l"))
    return lines.select(F.col("query_id").cast("long"), F.array_join(F.transform("_l", lambda s: F.concat(
        s["perspective"], F.lit(": "), s["txt"])), "\n").alias("comparison"))
