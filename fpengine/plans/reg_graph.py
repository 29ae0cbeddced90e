"""Registered graph queries over ``part`` (devices), ``lineitem`` (seed lists)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EMBEDDING_LAYOUT
from ..operators import graph as G
from ..sources.tables import table
from .registry import register

# `part` read as devices: id p_partkey, type p_type, features p_name, p_brand, p_size
FEATURES = ("p_name", "p_brand", "p_size")

_DEV_SQL = """
dev AS (
  SELECT p_partkey AS id, CAST(p_type AS VARCHAR) AS device_type,
         coalesce(CAST(p_name AS VARCHAR), '') AS p_name, coalesce(CAST(p_brand AS VARCHAR), '') AS p_brand,
         coalesce(CAST(p_size AS VARCHAR), '') AS p_size
  FROM part
), longf AS (
  SELECT CAST(id AS VARCHAR) AS ip, 'p_name' AS feature_name, p_name AS value FROM dev
  UNION ALL SELECT CAST(id AS VARCHAR), 'p_brand', p_brand FROM dev
  UNION ALL SELECT CAST(id AS VARCHAR), 'p_size', p_size FROM dev
)"""


def _layer1(spark, sf_dir):
    return G.layer1(table(spark, sf_dir, "part"), "p_partkey", "p_type", FEATURES)


@register("GR1_device_nodes", f"""
WITH {_DEV_SQL}
SELECT DISTINCT CAST(id AS VARCHAR) AS ip, device_type FROM dev
""")
def gr1_devices(spark, sf_dir):
    return _layer1(spark, sf_dir)[0]


@register("GR1_feature_nodes", f"""
WITH {_DEV_SQL}
SELECT md5(feature_name || '=' || value) AS feature_id, feature_name, value, count(DISTINCT ip) AS degree
FROM longf GROUP BY feature_name, value
""")
def gr1_features(spark, sf_dir):
    _, features, edges = _layer1(spark, sf_dir)
    return features.join(G.feature_degree(edges), "feature_id") \
        .select("feature_id", "feature_name", "value", F.col("degree").cast("long").alias("degree"))


@register("GR1_edges", f"""
WITH {_DEV_SQL}
SELECT DISTINCT ip, md5(feature_name || '=' || value) AS feature_id,
       'Has_' || translate(feature_name, '-.', '__') AS rel_type
FROM longf
""")
def gr1_edges(spark, sf_dir):
    return _layer1(spark, sf_dir)[2]


@register("AGG13_feature_degree", f"""
WITH {_DEV_SQL}
SELECT feature_name, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(d) AS BIGINT) AS n_edges, CAST(max(d) AS BIGINT) AS max_degree
FROM (SELECT feature_name, value, count(DISTINCT ip) AS d FROM longf GROUP BY 1, 2) GROUP BY 1
""")
def agg13(spark, sf_dir):
    _, features, edges = _layer1(spark, sf_dir)
    deg = G.feature_degree(edges).join(features, "feature_id")
    return deg.groupBy("feature_name").agg(F.count(F.lit(1)).alias("n_features"),
                                           F.sum("degree").cast("long").alias("n_edges"),
                                           F.max("degree").cast("long").alias("max_degree"))


JN8_SQL = f"""
WITH {_DEV_SQL},
seeds AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS seed_id FROM lineitem),
sf AS (SELECT s.query_id, s.seed_id, d.p_name, d.p_brand, d.p_size FROM seeds s JOIN dev d ON d.id = s.seed_id),
cand AS (
  SELECT sf.query_id, sf.seed_id, b.id AS neighbor_id FROM sf JOIN dev b ON sf.p_name = b.p_name AND sf.p_brand = b.p_brand
  UNION SELECT sf.query_id, sf.seed_id, b.id FROM sf JOIN dev b ON sf.p_name = b.p_name AND sf.p_size = b.p_size
  UNION SELECT sf.query_id, sf.seed_id, b.id FROM sf JOIN dev b ON sf.p_brand = b.p_brand AND sf.p_size = b.p_size
), scored AS (
  SELECT c.query_id, c.neighbor_id, b.device_type,
         CAST(s.p_name = b.p_name AS INTEGER) + CAST(s.p_brand = b.p_brand AS INTEGER) + CAST(s.p_size = b.p_size AS INTEGER) AS shared_count
  FROM cand c JOIN dev s ON s.id = c.seed_id JOIN dev b ON b.id = c.neighbor_id
  WHERE c.neighbor_id <> c.seed_id
), best AS (
  SELECT query_id, neighbor_id, max(device_type) AS device_type, max(shared_count) AS shared_count
  FROM scored WHERE shared_count > 1 GROUP BY query_id, neighbor_id
), ns AS (
  SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = best.query_id AND s.seed_id = best.neighbor_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared_count DESC, neighbor_id) AS rank FROM ns
)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(neighbor_id AS BIGINT) AS neighbor_id, device_type,
       CAST(shared_count AS BIGINT) AS shared_count, CAST(rank AS BIGINT) AS rank
FROM ranked WHERE rank <= 5
"""


@register("JN8_shared_feature_neighbors", JN8_SQL)
def jn8(spark, sf_dir):
    """Each order is a query whose seeds are its parts; neighbours share > 1 of the
    part features with a seed."""
    part = table(spark, sf_dir, "part")
    seeds = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"),
                                                     F.col("l_partkey").alias("seed_id"))
    res = G.shared_feature_neighbors(part, "p_partkey", FEATURES, seeds, q=1, k=5, type_col="p_type")
    return res.select(F.col("query_id").cast("long"), F.col("neighbor_id").cast("long"), "device_type",
                      F.col("shared_count").cast("long"), F.col("rank").cast("long"))


# ---------------------------------------------------------------- layers 2/3, merges, index, propagation
from ..functions import vectors as V  # noqa: E402
from .reg_aggregate import SINGLE_SQL, single_clusters  # noqa: E402


@register("GR2_single_communities", f"""
WITH single AS ({SINGLE_SQL})
SELECT perspective, 'embeddings' AS device_type, CAST(cluster AS INTEGER) AS cluster, CAST(count(*) AS BIGINT) AS n_members,
       md5(perspective || '=' || 'embeddings' || '=' || CAST(cluster AS VARCHAR)) AS community_id
FROM single WHERE cluster <> -1 GROUP BY perspective, cluster
""")
def gr2(spark, sf_dir):
    """Layer 2: one community node per (perspective, type, single cluster), noise excluded,
    with IN_COMMUNITY edges from the devices of layer 1."""
    emb = table(spark, sf_dir, "embeddings")
    devices = emb.select(F.col("vec_id").cast("string").alias("ip"))
    nodes, edges = G.community_layer(single_clusters(spark, sf_dir), devices)
    sizes = edges.groupBy("community_id").agg(F.count(F.lit(1)).cast("long").alias("n_members"))
    return nodes.join(sizes, "community_id").select("perspective", "device_type", F.col("cluster").cast("int"),
                                                    "n_members", "community_id")


@register("GR3_overall_communities", """
SELECT 'overall' AS perspective, p_type AS device_type, CAST(p_size AS INTEGER) AS cluster, CAST(count(*) AS BIGINT) AS n_members
FROM part GROUP BY p_type, p_size
""")
def gr3(spark, sf_dir):
    """Layer 3 over `part`: overall cluster = size class within the type."""
    p = table(spark, sf_dir, "part")
    assign = p.select(F.col("p_partkey").cast("string").alias("ip"), F.col("p_type").alias("device_type"),
                      F.col("p_size").cast("int").alias("cluster"))
    devices, _, _ = G.layer1(p, "p_partkey", "p_type", FEATURES)
    nodes, edges = G.community_layer(assign, devices, perspective="overall")
    sizes = edges.groupBy("community_id").agg(F.count(F.lit(1)).cast("long").alias("n_members"))
    return nodes.join(sizes, "community_id").select("perspective", "device_type", F.col("cluster").cast("int"), "n_members")


@register("GR4_merge_or_create", f"""
WITH {_DEV_SQL},
existing AS (SELECT DISTINCT d.p_brand AS value FROM dev d WHERE CAST(d.p_size AS INTEGER) <= 25),
incoming AS (SELECT DISTINCT p_brand AS value FROM dev)
SELECT value, value NOT IN (SELECT value FROM existing) AS was_created FROM incoming
""")
def gr4(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    existing = p.where(F.col("p_size") <= 25).select(G.feature_value("p_brand").alias("value")).distinct()
    incoming = p.select(G.feature_value("p_brand").alias("value")).distinct()
    return G.merge_or_create(existing, incoming, ["value"])


@register("GR5_merge_nodes", f"""
WITH {_DEV_SQL},
nodes AS (SELECT DISTINCT p_name AS node_id FROM dev),
amap AS (SELECT node_id, min(node_id) OVER (PARTITION BY split_part(node_id, ' ', 2)) AS survivor FROM nodes),
edges AS (SELECT CAST(id AS VARCHAR) AS src, p_name AS dst FROM dev)
SELECT (SELECT CAST(count(DISTINCT survivor) AS BIGINT) FROM amap) AS n_nodes,
       CAST(count(*) AS BIGINT) AS n_edges
FROM (SELECT DISTINCT e.src, a.survivor AS dst FROM edges e JOIN amap a ON e.dst = a.node_id)
""")
def gr5(spark, sf_dir):
    """Name nodes that share their last word are merged into the smallest one; edges are
    repointed and de-duplicated."""
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_name").alias("node_id")).distinct().withColumn("word", F.split("node_id", " ")[1])
    surv = nodes.groupBy("word").agg(F.min("node_id").alias("survivor"))
    amap = nodes.join(surv, "word").select("node_id", "survivor")
    edges = p.select(F.col("p_partkey").cast("string").alias("src"), F.col("p_name").alias("dst"))
    merged, e2 = G.merge_nodes(nodes, edges, amap)
    n_edges = e2.count()
    return merged.agg(F.count(F.lit(1)).cast("long").alias("n_nodes")).withColumn("n_edges", F.lit(n_edges).cast("long"))


@register("GR6_bipartite_index", f"""
WITH {_DEV_SQL},
e AS (SELECT DISTINCT ip, md5(feature_name || '=' || value) AS feature_id FROM longf),
si AS (SELECT ip, dense_rank() OVER (ORDER BY ip) - 1 AS src_idx FROM (SELECT DISTINCT ip FROM e)),
di AS (SELECT feature_id, dense_rank() OVER (ORDER BY feature_id) - 1 AS dst_idx FROM (SELECT DISTINCT feature_id FROM e))
SELECT CAST(src_idx AS BIGINT) AS from_idx, CAST(dst_idx AS BIGINT) AS to_idx, 'fwd' AS direction FROM e JOIN si USING (ip) JOIN di USING (feature_id)
UNION ALL
SELECT CAST(dst_idx AS BIGINT), CAST(src_idx AS BIGINT), 'rev' FROM e JOIN si USING (ip) JOIN di USING (feature_id)
""")
def gr6(spark, sf_dir):
    _, _, edges = G.layer1(table(spark, sf_dir, "part"), "p_partkey", "p_type", FEATURES)
    _, _, idx = G.bipartite_index(edges.select("ip", "feature_id"))
    return idx.select(F.col("from_idx").cast("long"), F.col("to_idx").cast("long"), "direction")


@register("VEC11_degree_penalty", f"""
WITH {_DEV_SQL}
SELECT md5(feature_name || '=' || value) AS feature_id, CAST(count(DISTINCT ip) AS BIGINT) AS degree,
       round(CASE WHEN count(DISTINCT ip) > 1 THEN 1.0 / ln(count(DISTINCT ip)) ELSE 1.0 END, 6) AS penalty
FROM longf GROUP BY feature_name, value
""")
def vec11(spark, sf_dir):
    _, _, edges = G.layer1(table(spark, sf_dir, "part"), "p_partkey", "p_type", FEATURES)
    deg = G.feature_degree(edges)
    return deg.select("feature_id", F.col("degree").cast("long"), F.round(V.degree_penalty("degree"), 6).alias("penalty"))


@register("VEC12_message_passing")
def vec12(spark, sf_dir):
    """Two rounds of degree-weighted neighbour averaging between the embedding vectors and
    their single-cluster feature nodes (both directions, residual, unit norm)."""
    emb = table(spark, sf_dir, "embeddings")
    single = single_clusters(spark, sf_dir)
    edges = single.select("ip", G.feature_id(F.col("perspective"), F.col("cluster").cast("string")).alias("feature_id"))
    nodes = emb.select(F.col("vec_id").cast("string").alias("node"), F.col("embedding").alias("vec"))
    out = G.propagate(nodes, edges, rounds=2)
    return out.select("node", F.size("vec").alias("dim"), F.round(V.l2_norm("vec"), 6).alias("norm"))


#: weights of the relations of one typed round, by perspective
RELATION_WEIGHTS = dict(zip(EMBEDDING_LAYOUT.names, EMBEDDING_LAYOUT.weights, strict=True))


@register("VEC12_typed_round", f"""
WITH single AS ({SINGLE_SQL}),
e AS (SELECT ip, md5(perspective || '=' || CAST(cluster AS VARCHAR)) AS fid, CASE perspective {
    " ".join(f"WHEN '{n}' THEN {w}::DOUBLE" for n, w in RELATION_WEIGHTS.items())} END AS w FROM single),
x AS (SELECT CAST(vec_id AS VARCHAR) AS node, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
d AS (SELECT ip AS node, count(*) AS d FROM e GROUP BY 1),
m AS (SELECT e.fid AS node, x.i, avg(x.v * e.w * CASE WHEN d.d > 1 THEN 1 / ln(d.d) ELSE 1.0 END) AS v
      FROM e JOIN x ON x.node = e.ip JOIN d ON d.node = e.ip GROUP BY 1, 2),
a AS (SELECT * FROM x UNION ALL SELECT * FROM m),
s AS (SELECT node, avg(v) AS mu, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0) + 1e-5) AS sd FROM a GROUP BY 1)
SELECT a.node, CAST(a.i AS INTEGER) AS pos, round((a.v - s.mu) / s.sd, 6) AS value FROM a JOIN s USING (node)
""")
def vec12_typed(spark, sf_dir):
    """One round with a weight per relation (perspective) and layer norm, every element of every node. Feature nodes
    start without a vector, so they take their messages and the devices keep their own vectors, normalised."""
    emb = table(spark, sf_dir, "embeddings")
    edges = single_clusters(spark, sf_dir).select("ip", "perspective", G.feature_id(F.col("perspective"), F.col("cluster").cast("string")).alias("feature_id"))
    nodes = emb.select(F.col("vec_id").cast("string").alias("node"), F.col("embedding").alias("vec"))
    out = G.propagate(nodes, edges, rounds=1, relation="perspective", relation_weights=RELATION_WEIGHTS, norm="layer")
    return out.select("node", F.posexplode("vec").alias("pos", "value")) \
        .select("node", (F.col("pos") + 1).cast("int").alias("pos"), F.round("value", 6).alias("value"))
