"""Device / feature / community graph as node and edge DataFrames (GR1-GR6, JN8, AGG13,
VEC11, VEC12). Joins replace a graph database; no graph library is needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut_lineage, drop_tables, stage_table
from .sharing import shared_feature_neighbors  # noqa: F401  (JN8, part of the graph's interface)
from .vectormean import layer_norm, mean_vectors


def feature_value(c: str) -> Column:
    """Feature value as text; null becomes '' and *is* a feature node."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def feature_id(name: Column, value: Column) -> Column:
    """Stable id of a (feature_name, value) node; names never contain '='."""
    return F.md5(F.concat(name, F.lit("="), value))


def rel_type(name: Column) -> Column:
    """PRJ20: relationship type ``Has_<name>`` with '-' and '.' replaced by '_'."""
    return F.concat(F.lit("Has_"), F.translate(name, "-.", "__"))


def layer1(df: DataFrame, id_col: str, type_col: str, feature_cols: Sequence[str]
           ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """GR1: (device nodes, feature nodes, Has_* edges).

    device nodes: ip, device_type (distinct); feature nodes: feature_id, feature_name,
    value (distinct); edges: ip, feature_id, rel_type (distinct)."""
    base = df.select(F.col(id_col).cast("string").alias("ip"), F.col(type_col).cast("string").alias("device_type"),
                     *[feature_value(c).alias(c) for c in feature_cols])
    devices = base.select("ip", "device_type").dropDuplicates(["ip"])
    long = base.select("ip", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature_name"), F.col(c).alias("value")) for c in feature_cols])))
    long = long.withColumn("feature_id", feature_id(F.col("feature_name"), F.col("value")))
    features = long.select("feature_id", "feature_name", "value").distinct()
    edges = long.select("ip", "feature_id", rel_type(F.col("feature_name")).alias("rel_type")).distinct()
    return devices, features, edges


def feature_degree(edges: DataFrame) -> DataFrame:
    """AGG13: number of devices per feature node (map-side partial count)."""
    return edges.groupBy("feature_id").agg(F.count(F.lit(1)).alias("degree"))


def community_layer(assign: DataFrame, devices: DataFrame, *, perspective: str | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """GR2/GR3: community nodes per (perspective, device_type, cluster) without noise
    (cluster -1, FLT2), and IN_COMMUNITY edges for devices that exist in layer 1.
    ``assign``: ip, device_type, cluster (+ perspective unless given)."""
    a = assign if perspective is None else assign.withColumn("perspective", F.lit(perspective))
    a = a.where(F.col("cluster") != -1)
    nodes = a.select("perspective", "device_type", "cluster").distinct() \
        .withColumn("community_id", F.md5(F.concat_ws("=", "perspective", "device_type", F.col("cluster").cast("string"))))
    edges = (a.join(devices.select("ip"), "ip")
             .select("ip", F.md5(F.concat_ws("=", "perspective", "device_type", F.col("cluster").cast("string")))
                     .alias("community_id"), F.lit("IN_COMMUNITY").alias("rel_type"),
                     "perspective", "device_type", "cluster").distinct())
    return nodes, edges


def merge_or_create(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """GR4: each incoming node with ``was_created`` = it did not exist before."""
    marker = existing.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return incoming.join(marker, list(keys), "left").withColumn("was_created", F.col("_hit").isNull()).drop("_hit")


def merge_nodes(nodes: DataFrame, edges: DataFrame, alias_map: DataFrame, *, node_key: str = "node_id",
                src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """GR5: merge nodes into survivors. ``alias_map``: (node_id, survivor). Properties of
    merged nodes are combined per property as the sorted set of distinct values; edges are
    repointed to survivors and de-duplicated."""
    amap = alias_map.select(F.col(node_key).alias("_n"), F.col("survivor").alias("_s"))
    props = [c for c in nodes.columns if c != node_key]
    n2 = nodes.join(amap, nodes[node_key] == amap["_n"], "left") \
        .withColumn("_surv", F.coalesce(F.col("_s"), F.col(node_key)))
    merged = n2.groupBy("_surv").agg(*[F.array_sort(F.collect_set(F.col(p).cast("string"))).alias(p) for p in props]) \
        .withColumnRenamed("_surv", node_key)

    def repoint(df, col):
        m = amap.withColumnRenamed("_n", f"_n_{col}").withColumnRenamed("_s", f"_s_{col}")
        return df.join(m, df[col] == m[f"_n_{col}"], "left") \
            .withColumn(col, F.coalesce(F.col(f"_s_{col}"), F.col(col))).drop(f"_n_{col}", f"_s_{col}")

    e2 = repoint(repoint(edges, src), dst).distinct()
    return merged, e2


def bipartite_index(edges: DataFrame, src: str = "ip", dst: str = "feature_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """GR6: dense ids for both node types and an edge list in both directions."""
    from .windows import dense_codes
    _, src_ids = dense_codes(edges.select(src), src, out="src_idx")
    _, dst_ids = dense_codes(edges.select(dst), dst, out="dst_idx")
    e = edges.join(src_ids, src).join(dst_ids, dst)
    fwd = e.select(F.col("src_idx").alias("from_idx"), F.col("dst_idx").alias("to_idx"), F.lit("fwd").alias("direction"))
    rev = e.select(F.col("dst_idx").alias("from_idx"), F.col("src_idx").alias("to_idx"), F.lit("rev").alias("direction"))
    return src_ids, dst_ids, fwd.unionByName(rev)


def spread_hubs(edges: DataFrame, degree: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Cut the edges of very large senders into slices. ``edges``: _from, _to, ...; ``degree``: _node, _d.

    A sender is a hub if it has more than a quarter of a partition's share of all edges, so there are at most
    4 * ``parts`` hubs whatever the graph, and their list may be broadcast. Returns the edges with ``_slice``, and
    (_from, _d, _slice), one row per sender and slice: at most 8 * ``parts`` rows more than senders."""
    share = degree.agg(F.sum("_d").alias("t")).first()["t"] or 0
    limit = max(1, share // (4 * parts))
    cuts = F.ceil(F.col("_d") / limit).cast("int")
    hubs = degree.where(F.col("_d") > limit).select(F.col("_node").alias("_from"), cuts.alias("_cuts"))
    cut = edges.join(F.broadcast(hubs), "_from", "left") \
        .withColumn("_slice", F.pmod(F.xxhash64("_to"), F.coalesce("_cuts", F.lit(1))).cast("int")).drop("_cuts")
    slices = degree.select(F.col("_node").alias("_from"), "_d", F.explode(F.sequence(F.lit(0), F.greatest(cuts, F.lit(1)) - 1)).alias("_slice"))
    return cut, slices


def propagate(node_vecs: DataFrame, edges: DataFrame, *, rounds: int = 2, src: str = "ip", dst: str = "feature_id",
              node_col: str = "node", vec_col: str = "vec", relation: str | None = None,
              relation_weights: dict[str, float] | None = None, norm: str = "l2") -> DataFrame:
    """VEC12 (re-aimed, untrained): ``rounds`` of degree-weighted neighbour averaging on the
    bipartite graph in both directions, residual add and normalisation (``norm``: "l2" or
    "layer"); the state of a round is a reliable checkpoint.

    A message is the sender's vector times its degree penalty (VEC11) times the weight of the edge's
    ``relation`` (1 if not named). A node's aggregate is the mean of its messages, from one partial sum per task,
    so a hub's neighbourhood is gathered nowhere; the edges of a sending hub lie in slices (``spread_hubs``). A node
    without a vector sends nothing and takes its first aggregate alone; one without messages keeps its vector, normalised."""
    spark = edges.sparkSession
    weight = F.lit(1.0)
    for name, w in (relation_weights or {}).items():
        weight = F.when(F.col(relation) == name, F.lit(float(w))).otherwise(weight)
    deg_src = edges.groupBy(src).agg(F.count(F.lit(1)).alias("_d")).withColumnRenamed(src, "_node")
    deg_dst = edges.groupBy(dst).agg(F.count(F.lit(1)).alias("_d")).withColumnRenamed(dst, "_node")
    degree = stage_table(deg_src.unionByName(deg_dst), "vec12-degree")
    both = edges.select(F.col(src).alias("_from"), F.col(dst).alias("_to"), weight.alias("_w")) \
        .unionByName(edges.select(F.col(dst).alias("_from"), F.col(src).alias("_to"), weight.alias("_w")))
    cut, slices = spread_hubs(both, degree, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = stage_table(cut, "vec12-edges")
    normed = layer_norm if norm == "layer" else V.l2_normalize
    cur = node_vecs.select(F.col(node_col).alias("_node"), F.col(vec_col).alias("_v"))
    for _ in range(rounds):
        sender = cur.withColumnRenamed("_node", "_from").join(slices, "_from") \
            .select("_from", "_slice", V.scale("_v", V.degree_penalty("_d")).alias("_mv"))
        msgs = cut.join(sender, ["_from", "_slice"]).select(F.col("_to").alias("_node"), V.scale("_mv", F.col("_w")).alias("_mv"))
        agg = mean_vectors(msgs, ["_node"], "_mv", "_agg")
        summed = cur.join(agg, "_node", "full").select(
            "_node", F.when(F.col("_agg").isNull(), V.as_double("_v")).when(F.col("_v").isNull(), F.col("_agg"))
            .otherwise(F.zip_with(V.as_double("_v"), "_agg", lambda a, b: a + b)).alias("_s"))
        cur = cut_lineage(summed.select("_node", normed(F.col("_s")).alias("_v")))
    drop_tables(cut, degree)
    return cur.select(F.col("_node").alias(node_col), F.col("_v").alias(vec_col))
